"""Filter audit and phrases against plain Python, edge cases, summaries."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.llm import audit, collocations, q_corpus
from tabulon.plans.compare import compare, duck_views

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(130))


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    by_text = defaultdict(list)
    for i, text, *_ in docs:
        if i is not None:
            by_text[text or ""].append(i)
    rows = []
    for i, text, lang, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 bool(re.search(r"[#$%&*|]", t)), i is not None and min(by_text[t]) < i]
        rows.append((lang or "", {f for f, x in zip("ABCDE", fails) if x}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, total = [r[1:] for r in rows if r[0] == part], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                left = [r for r in own if not r[0] & set(order[:k])]
                gone = [r for r in left if f in r[0]]
                total[f] += len(gone)
                out[part, order, k + 1] = [f, len(left) - len(gone), len(gone), sum(f in r[0] for r in own) - len(gone),
                                           sum(r[0] == {f} for r in own), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(total[out[key][0]])
    return {k: tuple(v) for k, v in out.items()}


def rows_by_key(df):
    return {(r.part, r.filter_order, r.step): (r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost,
                                               r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_of_edge_cases(spark):
    docs = [(1, LONG, "en", 1), (2, LONG, None, 1), (2, LONG, None, 1), (None, LONG, "en", 2), (3, None, "", 3), (4, "", "de", 4),
            (5, "AB cd #", "de", 5), (6, "a " * 20_000, "en", 6), (7, "x y", "fr", 7), (7, "x z", "fr", 7), (None, None, None, 8),
            (9, LONG + " | SHOUT" * 90, "en", 9), (10, "é" * 9 + "A", "en", 9)]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (7, 1, 1), (99, 1, 1), (5, None, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, n long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    wide = df.selectExpr("*", "1 as digest", "2 as part", "3 as a")
    want = brute_audit(docs, labels)
    assert rows_by_key(audit.audit(df, marks)) == want and len(want) == 4 * 600
    assert rows_by_key(audit.audit(wide, marks)) == want
    assert audit.audit(df.limit(0), marks).count() == 0
    assert {(r[5], r[6]) for r in rows_by_key(audit.audit(df, marks.limit(0))).values()} == {(0, 0)}


def test_audit_of_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert rows_by_key(q_corpus.op12_filter_audit(spark, SF)) == brute_audit(docs, labels)


def brute_phrases(docs, least, first=2000, inside=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        longer, rows = Counter(), []
        for p, a in c.items():
            if len(p) == 3 and a >= least:
                for sub in (p[:2], p[1:]):
                    longer[sub] = max(longer[sub], a)
        for p, a in c.items():
            if len(p) > 1 and a >= least and not 100 * longer[p] >= inside * a:
                score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:first], 1)]
    return sorted(out)


EDGE = [("New York, new  york! NEW\tYork", None)] * 6 + [("new york", "und"), (None, "en"), ("", None), ("É É é", "en"),
                                                         ("x " * 30_000, "en"), ("a a a a", ""), ("!!.,", "en"), ("tip top", None)]


@pytest.mark.parametrize("least", [1, 2, 10])
def test_phrases_of_edge_cases(spark, least):
    df = spark.createDataFrame(EDGE, "text string, lang string").selectExpr("*", "1 as phrase", "2 as f", "3 as n")
    got = sorted(tuple(r) for r in collocations.phrases(df, least, bits=16, partition_bytes=1000).collect())
    assert got == brute_phrases(EDGE, least)
    assert collocations.phrases(df.limit(0)).count() == 0


@pytest.mark.parametrize("least,bits,size", [(3, 28, 10_000), (10, 12, 32_000_000)])
def test_phrases_of_documents(spark, least, bits, size):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")
    got = sorted(tuple(r) for r in collocations.phrases(docs, least, bits=bits, partition_bytes=size).collect())
    assert got == brute_phrases([tuple(r) for r in docs.collect()], least) and len(got) > 50


def test_products_beyond_64_bits(spark):
    docs = spark.createDataFrame([("a b", "x")], "text string, lang string")
    big = 10**14 - 7
    counts = spark.createDataFrame([("x", None, 3 * big), ("x", "a", big), ("x", "b", big - 1), ("x", "a b", big - 3)],
                                   "lang string, phrase string, f long")
    keep, collocations.frequent = collocations.frequent, lambda *a: counts
    try:
        row = collocations.phrases(docs).first()
    finally:
        collocations.frequent = keep
    assert row.score == 10**6 * (big - 3) ** 2 // (big * (big - 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=60), min_size=1, max_size=8), st.integers(2, 12))
def test_every_frequent_key_survives(shares, least):
    summary, true = collocations.Summary(sum(map(len, shares)), least), Counter(x for s in shares for x in s)
    for share in shares:
        summary.add(*collocations.counted(np.array(share, np.uint64)))
        summary.merge()
    assert len(summary.keys) <= summary.capacity and summary.off < least
    assert {k for k, n in true.items() if n >= least} <= set(summary.survivors(least).tolist())
    assert all(true[k] - summary.off <= c <= true[k] for k, c in zip(summary.keys.tolist(), summary.counts.tolist()))


@pytest.mark.parametrize("name", list(q_corpus.ORACLE))
def test_against_sql(spark, name):
    assert compare(q_corpus.QUERIES[name](spark, SF), duck_views(SF), q_corpus.ORACLE[name]) is None


def test_digests_of_tokens(spark):
    row = q_corpus.op11_byte_bpe(spark, SF).orderBy("doc_id").first()
    text = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").first().text
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
