"""Toxicity by averaged subword embeddings and a linear softmax.

A document is the mean of the embeddings of all its subwords: every word and
its character n-grams of 3 to 5 with word ends marked, hashed into a table, so
that unseen misspellings share most of their vectors with known words.
Embeddings and softmax are trained together in NumPy (Adam) on a bounded
sample of labelled rows, the ``SAMPLE`` first by a hash of their id; scoring
covers every whole text.  As the softmax is linear, a word's share of the
margin is the sum of its subwords' margins, computed once per distinct word
of a slice.

Defined results: null and empty texts get the score of the bias alone; label
rows without doc_id or toxic are left out, of several for one id the highest
counts, and of several texts of one id the smallest is learned; without labels of both kinds every score is the share of label 1, 0
without any; repeated rows stay, with the same answer; columns besides doc_id
and text play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SALTS, chunked, fresh, mix, prepare, stage, text_bytes

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 5000
SIZE, DIM, GRAMS = 2**18, 4, (3, 4, 5)
EPOCHS, RATE, DECAY = 20, 0.05, 1e-6

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def subwords(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, table row) of all subwords of the words."""
    points = np.frombuffer(("\n" + "\n".join(f"<{w}>" for w in distinct)).encode("utf-32-le", "surrogatepass"),
                           np.uint32).astype(np.uint64)
    gap = points == 10
    word = np.cumsum(gap) - 1
    coded = mix(points + SALTS[100])
    of, rows = [], []
    for n in GRAMS:
        if len(points) < n:
            continue
        m = len(points) - n + 1
        h = np.full(m, SALTS[110 + n])
        for k in range(n):
            h += coded[k:m + k] * SALTS[120 + k]
        whole = (word[:m] == word[n - 1:]) & ~gap[:m]
        of.append(word[:m][whole])
        rows.append((mix(h[whole]) % np.uint64(SIZE)).astype(np.int64))
    first = np.flatnonzero(gap)
    place = np.arange(len(points)) - first[word]
    total = np.add.reduceat(coded * (SALTS[200 + place % 1000] ^ place.astype(np.uint64)), first)
    of.append(np.arange(len(distinct)))
    rows.append((mix(total ^ SALTS[101]) % np.uint64(SIZE)).astype(np.int64))
    return np.concatenate(of), np.concatenate(rows)


def word_index(data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-cased words of texts given as bytes, the index of each
    running word, and the word offsets of the rows."""
    if not len(data):
        return [], np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _INSIDE[data]
    cut = np.concatenate([[True], inside[1:] != inside[:-1]])
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(cut)
    parts = pa.Array.from_buffers(pa.binary(), len(at), [
        None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    real = inside[at]
    coded = parts.filter(pa.array(real)).dictionary_encode()
    lower = pa.array([w.decode("utf-8", "replace").lower() for w in coded.dictionary.to_pylist()], pa.string())
    lower = lower.dictionary_encode()
    index = lower.indices.to_numpy()[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    return lower.dictionary.to_pylist(), index, np.searchsorted(at[real], offsets)


def _bags(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for lo, hi in chunked(offsets):
            distinct, index, first = word_index(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            of, rows = subwords(distinct) if distinct else (np.zeros(0, np.int64),) * 2
            order = np.argsort(of, kind="stable")
            start, rows = np.searchsorted(of[order], np.arange(len(distinct) + 1)), rows[order]
            kept, counts = [], []
            for a, b in zip(first, first[1:]):
                words, times = np.unique(index[a:b], return_counts=True)
                size = start[words + 1] - start[words]
                spot = np.repeat(start[words], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                own, where = np.unique(rows[spot], return_inverse=True)
                kept.append(own.astype(np.int32))
                counts.append(np.bincount(where, np.repeat(times, size), len(own)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo),
                 pa.array(kept, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["doc_id", "toxic", "rows", "counts"])


def fit(rows: list[np.ndarray], counts: list[np.ndarray], label: np.ndarray) -> tuple[np.ndarray, float]:
    """Margin of each table row and bias, from documents as counted bags."""
    rng = np.random.default_rng(7)
    used = np.flatnonzero(np.bincount(np.concatenate(rows), minlength=SIZE))
    size = len(used)
    place = np.full(SIZE, -1)
    place[used] = np.arange(size)
    total = [max(1, c.sum()) for c in counts]
    counts = [(c / t).astype(np.float32) for c, t in zip(counts, total)]
    rows = [place[r].astype(np.int32) for r in rows]
    table = rng.normal(0, 0.1, (size, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    balance = np.where(label == 1, 0.5 / max(1e-9, label.mean()), 0.5 / max(1e-9, 1 - label.mean())) ** 0.5
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, soft, bias)]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for some in np.array_split(order, max(1, len(order) // 300)):
            flat = np.concatenate([rows[i] for i in some])
            w = np.concatenate([counts[i] for i in some])
            doc = np.repeat(np.arange(len(some)), [len(rows[i]) for i in some])
            hidden = np.stack([np.bincount(doc, w * table[flat, k], len(some)) for k in range(DIM)], 1)
            margin = hidden @ soft + bias
            p = np.exp(margin - margin.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), label[some]] -= 1
            p *= balance[some][:, None] / len(some)
            back = p @ soft.T
            grads = [np.stack([np.bincount(flat, w * back[doc, k], size) for k in range(DIM)], 1) + DECAY * table,
                     hidden.T @ p + DECAY * soft, p.sum(axis=0)]
            step += 1
            for value, grad, (m, v) in zip((table, soft, bias), grads, moments):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    margins = np.zeros(SIZE)
    margins[used] = table @ (soft[:, 1] - soft[:, 0])
    return margins, float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Margins and bias, or a plain score if there are not both labels."""
    prepare(docs.sparkSession)
    seen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
            .where("toxic in (0, 1) and doc_id is not null and crc32(string(doc_id)) % 5 <> 0")
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    chosen = stage(seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bags = (texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
            .mapInArrow(_bags, "doc_id long, toxic int, rows array<int>, counts array<int>")
            .toArrow().to_pandas().sort_values("doc_id"))
    label = bags["toxic"].to_numpy(np.int64)
    if not len(label) or label.min() == label.max():
        return float(label.mean()) if len(label) else 0.0
    return fit([np.asarray(x) for x in bags["rows"]], [np.asarray(x) for x in bags["counts"]], label)


def score(docs: DataFrame, model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every whole text."""
    at = [c.lower() for c in docs.columns].index(text.lower())

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            for lo, hi in chunked(offsets):
                n = hi - lo
                if isinstance(model, float):
                    result = np.full(n, model)
                else:
                    margins, bias = model
                    distinct, index, first = word_index(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                    of, rows = subwords(distinct) if distinct else (np.zeros(0, np.int64),) * 2
                    sums = np.bincount(of, margins[rows], len(distinct))[index]
                    size = np.bincount(of, minlength=len(distinct))[index]
                    row = np.repeat(np.arange(n), np.diff(first))
                    mean = np.bincount(row, sums, n) / np.maximum(1, np.bincount(row, size, n))
                    result = 1 / (1 + np.exp(-np.clip(mean + bias, -500, 500)))
                part = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(result)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    model = train(docs, labels, sample)
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", F.expr("coalesce(crc32(string(doc_id)) % 5 = 0, false)").alias("held_out"), "score",
                         F.expr("int(score >= 0.5)").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the model does not reject."""
    (name,) = fresh(docs, "score")
    return score(docs, train(docs, labels, sample), out=name).where(F.col(name) < 0.5).drop(name)
