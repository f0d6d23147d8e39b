"""Property checks (hypothesis) and hand-worked cases of row-level rules: line
counting, the count step's tokens, the header vote.  Each batch of generated texts is checked in one Spark job."""

import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.functions.text import stopwords, token_array
from tabulon.operators.tablize import count_lines

ALPHABET = st.sampled_from(list("ab ZéèçßñÜ\n\r,;.-_1") + ["Ça", "les", "données"])
texts = st.lists(st.lists(ALPHABET, max_size=40).map("".join), min_size=1, max_size=30)


def _py_tokens(s, stop):
    s = unicodedata.normalize("NFKD", s.lower())
    s = "".join(c for c in s if not unicodedata.combining(c))
    return [t for t in re.findall(r"\b[a-zA-Z]{3,}\b", s) if t not in stop]


def test_count_lines_by_hand(spark):
    cases = {"a": 1, "a\n": 1, "a\nb": 2, "a\nb\n": 2, "\n\n": 2, "é\nç\n\nñ": 4}
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    got = {r["text"]: r["n"] for r in df.select("text", count_lines(F.col("text")).alias("n")).collect()}
    assert got == cases


@settings(max_examples=10, deadline=None)
@given(texts)
def test_one_more_line_counts_one_more(spark, batch):
    batch = [t.replace("\r", "") + "x" for t in batch]
    df = spark.createDataFrame([(t, t + "\ny") for t in batch], "a string, b string")
    assert df.where(count_lines(F.col("b")) - count_lines(F.col("a")) != 1).count() == 0


@settings(max_examples=15, deadline=None)
@given(texts)
def test_tokens_match_python(spark, batch):
    stop = stopwords()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "id int, text string")
    got = {r["id"]: r["t"] for r in df.select("id", token_array(F.col("text"), stop).alias("t")).collect()}
    assert got == {i: _py_tokens(t, set(stop)) for i, t in enumerate(batch)}


def _scores(spark, grids):
    from tabulon.operators.tablize import header_vote

    rows = [(name, g, g, ";".join(cells), ";", width) for name, (width, grid) in grids.items()
            for g, cells in enumerate(grid)]
    content = spark.createDataFrame(rows, "file_id string, gidx long, line_no long, line string, "
                                          "delimiter string, n_col int")
    return {(r["file_id"], r["r"]): r["score"] for r in header_vote(content).collect()}


def test_header_vote_by_hand(spark):
    numbers = [["1", "2.5"], ["3", "4.5"], ["5", "6.5"]]
    got = _scores(spark, {
        "named": (2, [["id", "price"], *numbers]),       # a word over whole numbers, a word over fractions
        "unnamed": (2, [["7", "8.5"], *numbers]),        # numbers over numbers speak against a header
        "narrow": (3, [["id", "price"], *numbers]),      # width differs from the file's
    })
    assert got["named", 0] == 2 and got["unnamed", 0] == -1 and got["narrow", 0] == -1


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 99), min_size=3, max_size=8))
def test_a_word_above_numbers_scores_more_than_a_number(spark, values):
    column = [[str(v), "x"] for v in values]
    got = _scores(spark, {"word": (2, [["name", "x"], *column]), "number": (2, [["12", "x"], *column])})
    assert got["word", 0] > got["number", 0]
