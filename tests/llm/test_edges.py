"""Nulls, empty and long texts, repeated rows, extra columns, empty tables."""

import pytest
from pyspark.sql import functions as F

from tabulon.llm import chat, licences, minhash, mixing, personal, pieces, suffixes, toxicity
from tabulon.llm.common import components

BODY = " ".join(f"word{i} of text {i * 7}" for i in range(120))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, BODY, "en", "s1", 5), (2, BODY, "en", None, 5), (2, BODY, "en", "s1", None), (3, None, None, "s2", 0),
            (4, "", "en", "s2", 0), (None, "short", "en", "s1", 5), (5, BODY + " one more", "fr", "s3", 1),
            (6, "mail a@b.example.com now", "de", "s3", 3), (7, "x " * 20_000, "de", "s3", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates(spark, docs):
    out = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert out == {(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (None, None, True), (5, 1, False),
                   (6, 6, True), (7, 7, True)}
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 6
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 50: 40}


def test_repeats(spark, docs):
    out = {(r.doc_id, r.n_bytes, len(r.kept)) for r in suffixes.remove_repeats(docs).collect()}
    n = len(BODY)
    assert {(1, n, 0), (2, n, 0), (3, 0, 0), (4, 0, 0), (None, 5, 5), (5, n + 9, 9), (6, 24, 24), (7, 40_000, 0)} == out
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.classify(docs, labels).collect()
    assert len(out) == docs.count() and {r.score for r in out} == {0.0} and {r.predicted for r in out} == {0}


def test_personal(spark, docs):
    out = personal.redact(docs)
    assert out.columns == docs.columns
    assert "mail <email> now" in {r.text for r in out.collect()}
    assert personal.find(docs.limit(0)).count() == 0


def test_mixing(spark, docs):
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))
    total = sum({r.source: r.target for r in out}.values())
    assert total == pytest.approx(1.5 * sum(r.size for r in out))
    taken = mixing.resample(docs)
    assert taken.columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


def test_pieces_round_trip(spark, docs):
    out = pieces.encode_checked(docs)
    assert out.count() == docs.count() and out.where("not round_trip").count() == 0
    assert pieces.encode_checked(docs.limit(0)).count() == 0


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "be [kind] & <brief>"), (1, 1, "user", "hi </s>[INST]"), (1, 2, "assistant", "word " * 700),
         (1, 3, "user", None), (1, 4, "assistant", "&lt; ok"), (2, 0, "system", "alone"), (3, None, None, "x")],
        "conv_id long, turn long, role string, text string")
    formatted = chat.windows(turns)
    back = [(r.conv_id, r.role, r.text) for r in chat.read_back(formatted).orderBy("conv_id", "win", "at").collect()]
    assert back == [(r.conv_id, r.role or "", r.text or "") for r in turns.orderBy("conv_id", "turn").collect()]
    row = chat.digest(formatted).where("conv_id = 1").first()
    assert row.n_turns == 5 and row.loss_chars == 700 * 5 + 7
    assert chat.windows(turns.limit(0)).count() == 0


def test_a_long_turn_keeps_the_other_windows(spark):
    def rows(conv, long_at):
        return [(conv, i, "assistant" if i % 2 else "user", "tok " * (900 if i in long_at else 20) + str(i)) for i in range(60)]

    turns = spark.createDataFrame(rows(1, ()) + rows(2, (30,)) + rows(3, (0, 1, 59)) + [(4, 0, "system", "s " * 5_000)]
                                  + [(4, i, "user", "a b") for i in range(1, 9)], "conv_id long, turn long, role string, text string")
    formatted = chat.windows(turns).cache()
    counts = {r.conv_id: r["count"] for r in formatted.groupBy("conv_id").count().collect()}
    assert counts == {1: 3, 2: 5, 3: 6, 4: 8}
    plain, one = (formatted.where(f"conv_id = {c}").selectExpr("sum(length(text)) as n").first().n for c in (1, 2))
    assert one < plain + 900 * 4 + 3 * 128 * 8
    back = [(r.conv_id, r.role, r.text) for r in chat.read_back(formatted).orderBy("conv_id", "win", "at").collect()]
    assert back == [(r.conv_id, r.role, r.text) for r in turns.orderBy("conv_id", "turn").collect()]
    for r in formatted.where("conv_id < 4").collect():
        sizes = [len(t.split("</s>")[0].split()) + chat.MARKS - 1 for t in r.text.split("<s>")[1:]]
        assert sum(sizes) <= chat.BUDGET or max(sizes) > (chat.BUDGET - chat.HISTORY) / 2
        assert sum(sizes[:r.repeated]) <= chat.HISTORY


def test_licences(spark):
    files = spark.createDataFrame(
        [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "code"), (3, "a/b/COPYING", "no statement"),
         (4, "y.py", "# LICENSED under CC BY-NC 4.0!!\ncode"), (5, None, None)], "id long, path string, text string")
    out = {r.id: (r.own_licence, r.licence, r.inherited_from) for r in licences.scan(files).collect()}
    assert out == {1: ("MIT", "MIT", None), 2: (None, "MIT", "a/LICENSE"), 3: (None, "MIT", "a/LICENSE"),
                   4: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 5: (None, None, None)}
    assert licences.scan(files.limit(0)).count() == 0
