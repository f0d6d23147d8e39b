"""Exact top-k by integer inner product over a bit-sliced index.

Every component x becomes floor(256 * x).  A block of rows keeps its
quantised components (the top bits, shifted so that ``SLICES`` bits hold the
block's range) as one bitmap per component and bit.  For a slice of queries
the weighted sum of all components is made of bitmaps alone: for each bit of
the weights the chosen slices are added with carry-save bitmap arithmetic.
The k-th largest sum is found from the most significant sum slice downward;
rows whose sum is within the quantisation error of it are the boundary and
are scored exactly, the rest cannot be among the k.  Ties go to the smaller
id.

Rows and queries meet block by block (``ROW_BLOCK`` rows by ``QUERY_BLOCK``
queries), each pair of blocks in its own group; k rows per query and block
go on, and a partial top-k is merged per query.

Defined results: vectors that are null or hold a null or non-finite component
take no part; a repeated id is a candidate for each of its rows, but a query
never finds rows of its own id, and of several rows with the query's id each
asks (their results are merged, best first); shorter vectors count as padded
with zeros; rows and queries with a component of 2**26 or more after quantising
are left out of the bitmaps and scored apart, exactly; components and scores
beyond 64 bits count as the nearest 64-bit number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, stage

SLICES, ROW_BLOCK, QUERY_BLOCK, QUERY_SLICE = 6, 16_384, 4_096, 64
#: Components from here on are scored in whole numbers without bound; least score that is told.
WIDE, LOWEST = 2**26, -2**63


def _bitmap(flags: np.ndarray) -> np.ndarray:
    """Rows of flags packed into 64-bit words."""
    n = -(-flags.shape[-1] // 64) * 64
    padded = np.zeros((*flags.shape[:-1], n), bool)
    padded[..., :flags.shape[-1]] = flags
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


class Counter:
    """Sum of bitmaps by weight: at most two pending per bit, merged by full
    adders as they come."""

    def __init__(self):
        self.pending: list[list[np.ndarray]] = []

    def add(self, bit: int, bits: np.ndarray) -> None:
        while True:
            while len(self.pending) <= bit:
                self.pending.append([])
            slot = self.pending[bit]
            slot.append(bits)
            if len(slot) < 3:
                return
            a, b, c = slot
            x = a ^ b
            slot[:] = [x ^ c]
            bit, bits = bit + 1, (a & b) | (x & c)

    def slices(self) -> list[np.ndarray]:
        """One bitmap per bit, least significant first."""
        out, bit = [], 0
        while bit < len(self.pending):
            while len(self.pending[bit]) > 1:
                a, b = self.pending[bit].pop(), self.pending[bit].pop()
                self.pending[bit].append(a ^ b)
                self.add(bit + 1, a & b)
            out.append(self.pending[bit][0] if self.pending[bit] else None)
            bit += 1
        like = next(x for x in out if x is not None)
        return [np.zeros_like(like) if x is None else x for x in out]


def _count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1).astype(np.int64)


def boundary(rows: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Flags (queries x rows) of the rows that can be among the k best by
    inner product; both are integer matrices."""
    n = len(rows)
    low = rows.min(axis=0)
    span = int((rows.max(axis=0) - low).max())
    shift = max(0, span.bit_length() - SLICES)
    coarse = (rows - low) >> shift
    everyone = _bitmap(np.ones((1, n), bool))
    slices = [[_bitmap((coarse[:, j] >> b & 1).astype(bool)[None]) for b in range(max(1, span.bit_length() - shift))]
              for j in range(rows.shape[1])]
    # a negative weight adds the complement: -w * (top - x) is w * x but for a constant
    weight_bits = int(np.abs(queries).max(initial=0)).bit_length()
    total = Counter()
    flags = [np.where((np.abs(queries) >> b & 1).astype(bool), np.uint64(2**64 - 1), np.uint64(0))
             for b in range(weight_bits)]
    minus = np.where(queries < 0, np.uint64(2**64 - 1), np.uint64(0))
    for j, own in enumerate(slices):
        signed = [bits ^ minus[:, j, None] for bits in own]
        for b in range(weight_bits):
            chosen = flags[b][:, j, None]
            if chosen.any():
                for i, bits in enumerate(signed):
                    total.add(b + i, bits & chosen)
    if not total.pending:
        return np.ones((len(queries), n), bool)
    sums = total.slices()
    # k-th largest sum of each query, from the most significant slice downward
    equal = np.repeat(everyone, len(queries), axis=0)
    missing = np.full(len(queries), min(k, n))
    bar = np.zeros(len(queries), object)
    for bit in range(len(sums) - 1, -1, -1):
        high = equal & sums[bit]
        count = _count(high)
        enough = count >= missing
        bar[enough] += 1 << bit
        missing = np.where(enough, missing, missing - count)
        equal = np.where(enough[:, None], high, equal & ~sums[bit])
    # x = low + 2**shift * coarse + rest, 0 <= rest < 2**shift: an error below
    # sum |w| * (2**shift - 1) on either side, in units of 2**shift
    error = (np.abs(queries).sum(axis=1) * ((1 << shift) - 1) >> shift) + 1
    least = np.maximum(0, bar - error.astype(object))
    # sums >= least, again from the most significant slice downward
    above = np.zeros_like(equal)
    equal = np.repeat(everyone, len(queries), axis=0)
    for bit in range(len(sums) - 1, -1, -1):
        one = np.array([int(x) >> bit & 1 for x in least], bool)[:, None]
        above = np.where(one, above, above | (equal & sums[bit]))
        equal = equal & np.where(one, sums[bit], ~sums[bit])
    kept = (above | equal).view(np.uint8)
    return np.unpackbits(kept, axis=-1, bitorder="little")[:, :n].astype(bool)


def best_of_block(row_ids, rows, query_ids, queries, k: int) -> pd.DataFrame:
    """The k best rows of a block for each query, own ids left out."""
    order = np.argsort(row_ids, kind="stable")
    row_ids, rows = row_ids[order], rows[order]
    _, times = np.unique(row_ids, return_counts=True)
    room = k + int(times.max())  # rows of the query's own id may come first
    out = []
    for lo in range(0, len(queries), QUERY_SLICE):
        some = queries[lo:lo + QUERY_SLICE]
        for q, w, able in zip(query_ids[lo:lo + QUERY_SLICE], some, boundary(rows, some, room)):
            at = np.flatnonzero(able)
            at = at[row_ids[at] != q]
            score = rows[at] @ w
            first = np.argsort(-score, kind="stable")[:k]
            out.append(pd.DataFrame({"query_id": q, "vec_id": row_ids[at[first]], "score": score[first]}))
    return pd.concat(out).astype("int64")


def _matrix(column) -> np.ndarray:
    wide = max((len(x) for x in column), default=0)
    out = np.zeros((len(column), wide), np.int64)
    for i, x in enumerate(column):
        out[i, :len(x)] = x
    return out


def best_of_all(row_ids, rows, query_ids, queries, k: int) -> pd.DataFrame:
    """As ``best_of_block``, for components of any size: rows and queries with
    one of ``WIDE`` or more are scored apart, in whole numbers without bound."""
    large = [((m >= WIDE) | (m <= -WIDE)).any(axis=1) for m in (rows, queries)]
    if not large[0].any() and not large[1].any():
        return best_of_block(row_ids, rows, query_ids, queries, k)
    out = []
    if not large[0].all() and not large[1].all():
        out.append(best_of_block(row_ids[~large[0]], rows[~large[0]], query_ids[~large[1]], queries[~large[1]], k))
    exact = [m.astype(object) for m in (rows, queries)]
    for i in range(len(queries)):
        at = np.flatnonzero((large[0] | large[1][i]) & (row_ids != query_ids[i]))
        score = np.array([min(max(int(x), LOWEST), -LOWEST - 1) for x in exact[0][at] @ exact[1][i]], np.int64)
        first = np.lexsort((row_ids[at], ~score))[:k]
        out.append(pd.DataFrame({"query_id": query_ids[i], "vec_id": row_ids[at[first]], "score": score[first]}))
    return pd.concat(out).astype("int64")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` (vec_id,
    embedding) for every row of ``queries`` (same columns)."""
    prepare(vectors.sparkSession)

    def whole(df: DataFrame) -> DataFrame:
        fine = F.expr("embedding is not null and vec_id is not null and forall(embedding, x -> x is not null"
                      " and not isnan(x) and abs(double(x)) < double('infinity'))")
        scaled = F.expr("transform(embedding, x -> floor(256 * double(x)))")
        return df.where(fine).select(F.col("vec_id").cast("long").alias("id"), scaled.alias("v"))

    rows, asked = stage(whole(vectors)), stage(whole(queries))
    row_blocks = max(1, -(-rows.count() // ROW_BLOCK))
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    place = F.xxhash64("id", "v")
    rows = (rows.withColumn("rb", F.pmod(place, F.lit(row_blocks)))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))))
    asked = (asked.withColumn("qb", F.pmod(place, F.lit(query_blocks)).cast("int"))
             .withColumn("rb", F.explode(F.expr(f"sequence(0L, {row_blocks - 1}L)"))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        x, w = _matrix(left["v"]), _matrix(right["v"])
        wide = max(x.shape[1], w.shape[1], 1)
        x, w = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (x, w))
        return best_of_all(left["id"].to_numpy(), x, right["id"].to_numpy(), w, k)

    found = (rows.groupBy("rb", "qb").cogroup(asked.groupBy("rb", "qb"))
             .applyInPandas(run, "query_id long, vec_id long, score long"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
