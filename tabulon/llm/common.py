"""Shared helpers: Arrow text buffers as NumPy bytes, words and their 64-bit
hashes, 5-word shingle sets, size-checked joins, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir, ship_package

#: Words are runs of bytes outside this set (ASCII blank, tab to carriage return).
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNSTEP = np.uint64(pow(int(_STEP), -1, 2**64))
SALTS = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Text bytes that a task turns into arrays at a time (one longer text is taken whole).
CHUNK_BYTES = 750_000
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 * 2**20)
#: Rows of ids that may be broadcast (16 MB); beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_STEP**i`` and its inverse, modulo 2**64, for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, _UNSTEP)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def chunked(offsets: np.ndarray, limit: int = CHUNK_BYTES, most: int = 4000):
    """Consecutive row ranges of about ``limit`` bytes and ``most`` rows at most."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), lo + most, n)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n + 1 word offsets of the rows.
    ``offsets`` start at 0 and cover ``data``."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SEPARATORS[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``data[start:end]``: equal bytes, equal hash."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct ``width``-word shingles of every row, in
    row order, hashes sorted within a row; with fewer words the whole
    sequence is one shingle, without words there is none."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    count = np.diff(first)
    rows = np.repeat(np.arange(len(count)), count)
    n = len(hashes)
    if n >= width:
        joined = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            joined += hashes[k:n - width + 1 + k] * SALTS[k]
        whole = np.arange(n - width + 1) + width <= first[1:][rows[:n - width + 1]]
        joined, of = joined[whole], rows[:n - width + 1][whole]
    else:
        joined, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            extra[has] += hashes[first[short[has]] + k] * SALTS[k]
        extra += SALTS[width + count[short]]
        joined, of = np.concatenate([joined, extra]), np.concatenate([of, short])
    joined = mix(joined)
    order = np.argsort((of.astype(np.uint64) << np.uint64(52)) | (joined >> np.uint64(12)), kind="stable")
    joined, of = joined[order], of[order]
    if len(joined):
        new = np.ones(len(joined), bool)
        new[1:] = (joined[1:] != joined[:-1]) | (of[1:] != of[:-1])
        joined, of = joined[new], of[new]
    return of, joined


def prepare(spark) -> None:
    """Checkpoint folder and package for this application, and smaller Arrow
    batches than the default where the cluster names no size (a worker holds
    a batch and what it makes of it)."""
    if not spark.sparkContext.getConf().contains(BATCH_KEY):
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write under the shared checkpoint folder and read again."""
    return cut_lineage(df)


def sized(small: DataFrame, rows_at_most: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` (a stored table) with a broadcast hint if a count shows that
    it has at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(small) if small.count() <= rows_at_most else small


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that do not clash with columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(df: DataFrame, name: str) -> Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b long): (node, component) with
    the smallest node reachable, for every node that has an edge.  Alternating
    large and small stars: each round is two grouped minima and two joins;
    every round is written to the shared folder.  Ends when the edges stay
    the same; then every node hangs on its smallest one."""
    def oriented(e: DataFrame) -> DataFrame:
        return (e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .where("a <> b").distinct())

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stage(oriented(edges))
    seen = mark(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")
        large = oriented(large)
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        now = stage(oriented(small.select("a", F.col("m").alias("b")).union(small.select("b", "m"))))
        last, seen = seen, mark(now)
        if seen == last:
            roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
