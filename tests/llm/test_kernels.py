"""Kernels against brute force, without Spark."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tabulon.llm import bitslices, curves, mixing, personal, pieces, suffixes
from tabulon.llm.common import shingles, text_bytes
from tabulon.llm.minhash import sketch


def test_shingles_match_python():
    texts = ["", "a", "A b c d", "a b c d e f", "x  y\tz\nw v u", "é ü ß a b c", None, "same same same same same same"]
    data, offsets = text_bytes(pa.array(texts))
    of, hashes = shingles(data, offsets)
    sets = [set() for _ in texts]
    for o, h in zip(of.tolist(), hashes.tolist()):
        sets[o].add(h)
    for t, s in zip(texts, sets):
        w = [x for x in re.split(r"[ \t-\r]+", t or "") if x]
        want = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        assert len(s) == len(want)


def test_sketch_fills_every_bin_and_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**62, 300, dtype=np.uint64)
    b = np.concatenate([a[:270], rng.integers(0, 2**62, 30, dtype=np.uint64)])
    rows = np.repeat([0, 1, 2], [300, 300, 1])
    out = sketch(rows, np.concatenate([a, b, a[:1]]), 3, 196)
    assert (out != np.uint64(2**64 - 1)).all()
    assert abs((out[0] == out[1]).mean() - 270 / 330) < 0.12


def test_loser_tree_merges_with_prefixes():
    rng = random.Random(3)
    runs = []
    for _ in range(5):
        s = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))) for _ in range(30))
        lcps, rests, lengths = suffixes.front_code(s)
        assert suffixes.front_decode(lcps, rests, lengths) == s
        runs.append((s, lcps))
    merged = suffixes.merge_runs(runs)
    out = [runs[r][0][i] for r, i, _ in merged]
    assert out == sorted(x for s, _ in runs for x in s)
    for (x, y), (_, _, k) in zip(zip(out, out[1:]), merged[1:]):
        assert k == suffixes.shared(x, y)


def test_encoder_equals_library():
    import sentencepiece

    v = pieces.read_vocabulary()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(1)
    texts = ["", " a", "日本語 hello\n", "a" * 200, "internationalization of things", "def f(x):\n    return x", "\x00 <s>"]
    texts += ["".join(rng.choice("abc th eé日\n  .,ing") for _ in range(rng.randrange(60))) for _ in range(100)]
    data, offsets = text_bytes(pa.array(texts))
    flat, rows = pieces.Encoder(v).batch(data, offsets)
    assert [flat[a:b].tolist() for a, b in zip(rows, rows[1:])] == library.encode(texts)


def test_bit_sliced_top_k_is_exact():
    rng = np.random.default_rng(5)
    rows = rng.integers(-300, 300, (500, 9))
    rows[10] = rows[11]
    queries = rows[::50]
    ids, asked = np.arange(500), np.arange(0, 500, 50)
    got = bitslices.best_of_block(ids, rows, asked, queries, 5)
    for q in asked:
        score = rows @ rows[q]
        order = [i for i in np.lexsort((ids, -score)) if i != q][:5]
        mine = got[got["query_id"] == q]
        assert mine["vec_id"].tolist() == order and mine["score"].tolist() == score[order].tolist()


def test_hilbert_is_a_curve():
    cells = np.array([(x, y) for x in range(8) for y in range(8)])
    key = curves.hilbert(cells, 3)
    assert sorted(key) == list(range(64))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(2)
    size, chance = rng.integers(1, 900, 400).astype(float), np.full(400, 0.37)
    out = mixing.fly(size, chance, rng.random(400))
    assert ((out > 0) & (out < 1)).sum() <= 3
    assert out.sum() == pytest.approx(chance.sum()) and (out * size).sum() == pytest.approx((chance * size).sum())
    assert set(mixing.land(np.array([3.0, 5, 9]), np.array([0.5, 0.5, 0.5]))) <= {0.0, 1.0}


def test_patterns_and_field():
    text = "a.b@x.example.com 10.0.0.256 at 10.0.0.5 by 4111 1111 1111 1111 or +1 (017) 555-7713 not 4111111111111112"
    kinds = [(personal.KINDS[k], text[a:b]) for k, a, b in personal.base_spans(text)]
    assert kinds == [("email", "a.b@x.example.com"), ("ip", "10.0.0.5"), ("card", "4111 1111 1111 1111"),
                     ("phone", "+1 (017) 555-7713")]
    assert personal.base_spans("5 4111 1111 1111 1111") == []  # one match of 17 digits, not tried again
    model = personal.train()
    (spans,) = personal.all_spans(["please call 555-201-7788 soon"], model)
    assert [(personal.KINDS[k], base) for k, _, _, base in spans] == [("phone", False)]
    assert personal.all_spans(["", "a" * 50_000, "1" * 50_000, "@" * 999, "version 3.2 of 2021"], model) == [[]] * 5
    assert personal.labelled("x [ip|10.0.0.1] y") == (["x", "10.0.0.1", "y"], [0, personal.LABELS.index("B-ip"), 0])
