"""Byte-level BPE against the tiktoken library, whole texts, appends and edits."""

import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.llm import byte_bpe

PATTERN = byte_bpe.default_pattern()


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.Coder(byte_bpe.Vocabulary(byte_bpe.read_ranks(byte_bpe.default_path())), PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, special_tokens={},
                             mergeable_ranks=byte_bpe.read_ranks(byte_bpe.default_path()))


ODD = ["", " ", "a", "'ll", "don't we'll 'LL '", "a" * 500, "-" * 700, " " * 300 + "x", "é" * 90, "\n\n \t x", "日本語テキスト",
       "🙂🙃" * 40, "<|endoftext|>", "ab" * 333, "0123456789" * 30, "naïve Straße ﬁ", "\u0000\u0001", "ÃÂ" * 100]


def test_odd_texts(coder, library):
    for text in ODD:
        assert list(coder.encode(text)) == library.encode_ordinary(text)
        data = text.encode()
        assert list(coder.tokens(data, np.array(coder.prefixes(text), np.int32))) == library.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("ab'l \n.", max_size=80), st.text("aeinorst", max_size=60)))
def test_any_text(coder, library, text):
    assert list(coder.encode(text)) == library.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text("ab'l \n.é-1", max_size=60), st.text("ab'l \n.é-1", max_size=8), st.integers(0, 60), st.integers(0, 9))
def test_any_edit(coder, library, text, added, at, removed):
    at = min(at, len(text))
    table = np.array(coder.prefixes(text), np.int32)
    new, made, _ = coder.edit(text, table, at, removed, added)
    assert new == text[:at] + added + text[at + removed:]
    assert made == coder.prefixes(new)
    assert list(coder.tokens(new.encode(), np.frombuffer(made, np.int32))) == library.encode_ordinary(new)


def test_edit_in_one_long_word(coder):
    rng = random.Random(5)
    text = "".join(rng.choice("etaoinshr") for _ in range(20_000))
    table = np.array(coder.prefixes(text), np.int32)
    new, made, _ = coder.edit(text, table, 10_000, 3, "qu")
    assert made == coder.prefixes(new)


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = byte_bpe.round_trip(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert list(r.tokens) == library.encode_ordinary(r.text) and bytes(r.decoded).decode() == r.text


def test_edges(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "word " * 30_000, None), (None, "a b", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    out = byte_bpe.round_trip(docs)
    assert out.columns == ["doc_id", "text", "tokens", "decoded"]
    got = sorted((str(r.doc_id), len(r.tokens), len(r.decoded)) for r in out.collect())
    assert got == [("1", 0, 0), ("2", 0, 0), ("2", 0, 0), ("3", len(library.encode_ordinary("word " * 30_000)), 150_000),
                   ("None", 2, 3)]
    assert byte_bpe.round_trip(docs.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, [60_000])], "doc_id long, tokens array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_bpe.decode(bad).collect()


def test_edits_as_a_table(spark, library):
    rows = [(1, "the quick brown fox " * 200, 2000, 5, "slow"), (2, "append", None, None, "ed 'l"), (3, None, 9, 9, "new"),
            (4, "gone", 0, 4, None), (5, "x " * 500, 400, 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spot long, cut long, more string")
    out = byte_bpe.edit(byte_bpe.prefix_tokens(docs), F.col("spot"), F.col("cut"), F.col("more"))
    for r, (_, text, at, cut, more) in zip(out.orderBy("doc_id").collect(), rows):
        text = text or ""
        at = len(text) if at is None else min(at, len(text))
        new = text[:at] + (more or "") + text[at + (cut or 0):]
        assert r.text == new and list(r.tokens) == library.encode_ordinary(new)
        assert r.recoded <= 40
    again = byte_bpe.prefix_tokens(out.select("doc_id", "text"), out="fresh")
    assert out.join(again, "doc_id").where("prefixes <> fresh").count() == 0
    appended = byte_bpe.edit(byte_bpe.prefix_tokens(docs), None, F.lit(0), F.lit("!"))
    assert {r.text[-1] for r in appended.collect()} == {"!"}
