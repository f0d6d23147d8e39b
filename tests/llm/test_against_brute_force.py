"""Registered operators through Spark against plain Python: exact scores of
any size, words near their targets, a trained model, round trips."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.llm import bitslices, mixing, pieces, q_mix, toxicity

SF = "/root/testdata/sf0.01"


def test_top_k_of_wide_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1, 6).tolist()) for i in range(300)]
    rows += [(300 + i, (rng.normal(0, 1, 6) * 10.0 ** rng.integers(3, 13)).tolist()) for i in range(40)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, []), (405, [1e300] * 6),
             (7, rows[7][1]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as query_id")
    asked = df.where("vec_id % 20 = 0 or vec_id = 405")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in bitslices.top_k(df, asked).collect()]
    able = [(i, [min(max(int(np.floor(256 * x)), -2**63), 2**63 - 1) if abs(x) < 1e15 else 2**63 - 1 for x in v])
            for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, w in able:
        if q % 20 and q != 405:
            continue
        scores = [(-min(max(sum(a * b for a, b in zip(v, w)), -2**63), 2**63 - 1), i) for i, v in able if i != q]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(sorted(scores)[:5], 1)]
    assert sorted(got) == sorted(want)
    assert bitslices.top_k(df.limit(0), asked).count() == 0 and bitslices.top_k(df, asked.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.floats(0.01, 0.99)), min_size=1, max_size=9))
def test_landing_is_the_nearest_choice(pairs):
    size, chance = np.array([float(s) for s, _ in pairs]), np.array([c for _, c in pairs])
    picked = mixing.land(size, chance)
    choices = (np.arange(2 ** len(size))[:, None] >> np.arange(len(size))) & 1
    words, docs = np.abs(choices @ size - (chance * size).sum()), np.abs(choices.sum(axis=1) - chance.sum())
    off = abs(picked @ size - (chance * size).sum())
    assert off == pytest.approx(words.min())
    assert abs(picked.sum() - chance.sum()) <= docs[words < words.min() + 1e-9].min() + 1e-9


def test_landing_of_long_documents():
    size = np.array([5e6, 4e6, 3.7e6, 1.0, 2.0, 900.0])
    picked = mixing.land(size, np.full(6, 0.5))
    assert abs(picked @ size - size.sum() / 2) <= 1.4e6


def test_mix_is_near_its_targets(spark):
    rows = q_mix.op7_mixing(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").selectExpr(
        "doc_id", "size(filter(split(text, '[ \\t-\\r]+'), w -> w <> '')) as size", "source").collect()}
    assert len(rows) == len(docs) and all(docs[r.doc_id].size == r.size for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert {r.source_size for r in own} == {sum(r.size for r in own)} and len({r.target for r in own}) == 1
        off = abs(sum(r.taken for r in own) - own[0].target)
        assert off <= max(0.005 * own[0].target, min(r.size for r in own if r.size)), source
        assert all(r.taken in (r.size * k for k in range(3)) for r in own)


def test_words_of_few_documents_are_learned(spark):
    rng = np.random.default_rng(11)
    plain = [f"w{i}" for i in range(400)]
    rude = ["grobvix", "zquaddle", "fnorkel", "hyptum", "jelkbog", "murvisch", "brantzok", "klewpid"]  # each in some 10 documents
    rows, labels = [], []
    for i in range(400):
        words = rng.choice(plain, 30).tolist()
        if i % 4 == 0:
            words[5] = rude[i // 4 % 8]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(3, "a second text of one id"), (1000, ""), (1001, None), (1002, "w1 " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as toxic")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.classify(df, marks).collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, toxicity.classify(df, marks).collect()))
    held = [(r.score, labels[r.doc_id][1]) for r in out if r.held_out and r.doc_id < 400 and r.doc_id != 3]
    good, bad = [s for s, t in held if not t], [s for s, t in held if t]
    assert np.mean([b > g for b in bad for g in good]) > 0.75
    few = toxicity.classify(df, marks.where("doc_id < 16")).collect()
    assert len({r.score for r in few}) > 2


def test_tokens_of_one_long_word(spark):
    rows = [(1, "x" * 30_000), (2, "ab" * 20_000 + " ▁ end"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as tokens", "2 as decoded")
    out = pieces.encode_checked(df).collect()
    assert len(out) == 3 and all(r.round_trip for r in out)
