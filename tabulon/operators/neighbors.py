"""Neighbourhoods in the topic space.

Exact search over a cell partition: every row belongs to the nearest of at
most ``PIVOTS`` pivot rows, and a cell's radius is the largest distance of its
rows to the pivot.  By the triangle inequality a row at distance ``d`` from a
pivot has no neighbour within ``r`` in that cell when ``d > r + radius``, so a
row visits only the cells that may hold one (for kNN, ``r`` is the distance of
the k-th nearest row of a part of its own cell).  Neighbouring cells are packed
into blocks of up to ``BLOCK_ROWS`` rows, larger cells split by hash, and a row
is sent once to every block with a cell that it must visit; the visits of a
block are dealt to a few shares.  A task holds the rows of one block and streams
the visits past them in NumPy, emitting only what the operator needs (the k
best per row, or the pairs within the radius).  Vectors without low-dimensional
structure prune little: exact search then costs what comparing all rows costs,
in bounded groups, and a row is sent to as many places as there are blocks.

Everything after the search is joins and grouped aggregates over the edge
table ``(a, b, distance)``; the co-reused pairs of a neighbourhood are found by
streaming its edges past the reuses of the files.  Rows with null or non-finite components (and, for
cosine, zero vectors) have no neighbours.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.stats import group_row_number, scalar
from ..functions.vectors import all_finite

EDGE_SCHEMA = "a long, b long, distance double"
PIVOTS, CELL_ROWS, BLOCK_ROWS = 1024, 2048, 32_768
#: Most numbers of one matrix of distances.
CHUNK = 4_000_000
#: Most reuses that a task holds, and edges that it takes together (more if of one target).
HELD_REUSES, ROWS_TOGETHER = 16_000_000, 16_384
#: Share of the norms by which an estimated distance may miss the exact one.
SLACK = 1e-6


def _rows(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _norms(A: np.ndarray) -> np.ndarray:
    return np.sqrt((A * A).sum(axis=1))


def _estimate(A: np.ndarray, B: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Euclidean distances by one matrix product, and how far they may be off."""
    a, b = _norms(A), _norms(B)
    d2 = (a * a)[:, None] + (b * b)[None, :] - 2.0 * (A @ B.T)
    return np.sqrt(np.maximum(d2, 0.0)), SLACK * (a[:, None] + b[None, :])


def _exact(A: np.ndarray, B: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of A to the same rows of B."""
    if metric == "cosine":  # rows have length 1
        return 1.0 - (A * B).sum(axis=1)
    diff = B - A
    return np.sqrt((diff * diff).sum(axis=1))


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equally long vectors."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class _Shared:
    """Which rows of a block share an item with given rows, by an index from
    the items of the block to its rows."""

    def __init__(self, items: pa.Array):
        flat = items.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(flat, kind="stable")
        self.items, self.n = flat[order], len(items)
        self.row = np.repeat(np.arange(len(items)), np.diff(items.offsets.to_numpy()))[order]

    def matrix(self, items: pa.Array) -> np.ndarray:
        out = np.zeros((len(items), self.n), bool)
        wanted = items.flatten().to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(len(items)), np.diff(items.offsets.to_numpy()))
        lo, hi = (np.searchsorted(self.items, wanted, side) for side in ("left", "right"))
        for i, one, end in zip(at[lo < hi], lo[lo < hi], hi[lo < hi]):
            out[i, self.row[one:end]] = True
        return out


class _Cells:
    """Rows with their cell, part and block (a stored table), the pivots, and
    per cell its radius and blocks (at most ``PIVOTS`` cells)."""

    def __init__(self, space: DataFrame, metric: str, block_rows: int, keep: list[str] | None = None):
        from ..session import cut_lineage, ship_package

        spark = space.sparkSession
        ship_package(spark)
        self.keep = keep or []
        w = F.col("w").cast("array<double>")
        rows = space.select(F.col("file").cast("long").alias("file"), w.alias("w"), *self.keep).filter(
            F.col("w").isNotNull() & all_finite(F.col("w")))
        if metric == "cosine":
            norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x))
            rows = (rows.withColumn("_n", norm).filter(F.col("_n") > 0)
                    .select("file", F.transform("w", lambda x: x / F.col("_n")).alias("w"), *self.keep))
        rows = cut_lineage(rows)
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.forall(
            "w", lambda x: x == x.cast("float").cast("double"))).alias("single")).first()
        n = seen["n"]
        # numbers that single precision holds exactly are sent in it
        self.vector = "array<float>" if seen["single"] else "array<double>"
        slots = spark.sparkContext.defaultParallelism
        want = min(PIVOTS, max(slots, math.ceil(n / block_rows)))
        picked = rows.orderBy(F.xxhash64("file"), "file").limit(want).select("w").toPandas()
        self.empty = n == 0
        if self.empty:
            return
        pivots = _rows(picked["w"])
        middle = pivots - pivots.mean(axis=0)
        # cells in the order of their pivots along the direction of most spread
        self.pivots = pivots = pivots[np.argsort(middle @ np.linalg.eigh(middle.T @ middle)[1][:, -1], kind="stable")]

        def assign(it):
            for pdf in it:
                if len(pdf):
                    d, _ = _estimate(_rows(pdf["w"]), pivots)
                    cell = d.argmin(axis=1)
                    yield pd.DataFrame({"file": pdf["file"], "cell": cell.astype(np.int32),
                                        "far": d[np.arange(len(d)), cell], "w": pdf["w"], **{c: pdf[c] for c in self.keep}})

        kept = "".join(f", {c} {space.schema[c].dataType.simpleString()}" for c in self.keep)
        placed = cut_lineage(rows.withColumn("w", F.col("w").cast(self.vector)).mapInPandas(
            assign, f"file long, cell int, far double, w {self.vector}{kept}"))
        sizes = placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("m")).toPandas()
        self.radius = np.full(len(pivots), -np.inf)
        self.radius[sizes["cell"]] = sizes["radius"]
        m = np.zeros(len(pivots), np.int64)
        m[sizes["cell"]] = sizes["m"]
        room = max(block_rows, min(BLOCK_ROWS * block_rows // CELL_ROWS, math.ceil(n / math.ceil(math.sqrt(4 * slots)))))
        self.first, self.blocks = np.zeros(len(pivots), np.int64), np.ceil(m / room).astype(np.int64)
        n_blocks, full = 0, room
        for c in range(len(pivots)):
            if self.blocks[c] > 1:  # blocks of its own
                self.first[c], full = n_blocks, room
                n_blocks += self.blocks[c]
            elif m[c]:
                if full + m[c] > room:
                    n_blocks, full = n_blocks + 1, 0
                self.first[c], full = n_blocks - 1, full + m[c]
        self.n_blocks, self.shares = int(n_blocks), math.ceil(8 * slots / n_blocks)

        def of(values, at="cell"):
            return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col(at) + 1)

        h = F.xxhash64("file")
        self.rows = placed.select("file", "w", "cell", *self.keep,
                                  F.pmod(h, of(np.ceil(m / block_rows))).cast("int").alias("part"),
                                  (of(self.first) + F.pmod(h, of(np.maximum(self.blocks, 1)))).cast("int").alias("block"))

    def visits(self, asked: DataFrame) -> DataFrame:
        """(file, w, reach, kept columns, block): the blocks with a cell that a
        row of ``asked`` (file, w, reach, kept columns) must see."""
        pivots, radius, first, blocks, n_blocks = self.pivots, self.radius, self.first, self.blocks, self.n_blocks

        def spread(it):
            for pdf in it:
                for lo in range(0, len(pdf), 1024):
                    some = pdf.iloc[lo:lo + 1024]
                    d, off = _estimate(_rows(some["w"]), pivots)
                    row, cell = np.nonzero(d <= some["reach"].to_numpy()[:, None] + radius[None, :] + 2 * off)
                    times = blocks[cell]
                    row, block = np.repeat(row, times), np.repeat(first[cell], times)
                    block += np.arange(len(block)) - np.repeat(np.cumsum(times) - times, times)
                    row, block = np.divmod(np.unique(row * n_blocks + block), n_blocks)
                    for at in range(0, len(row), 8192):
                        cut = slice(at, at + 8192)
                        yield some.iloc[row[cut]].assign(block=block[cut].astype(np.int32))

        asked = asked.select("file", "w", "reach", *self.keep)
        return asked.mapInPandas(spread, StructType([*asked.schema.fields, StructField("block", IntegerType())]))

    def search(self, asked: DataFrame, kernel, schema: str) -> DataFrame:
        """``kernel(block rows, visits)`` yields the columns of ``schema`` for
        every block and a stretch of the visits of one of its shares, both
        Arrow tables of (file, w, reach, kept columns)."""
        visits = self.visits(asked).select(
            "block", F.pmod(F.xxhash64("file", F.lit(1)), F.lit(self.shares)).cast("int").alias("share"),
            F.lit(1).alias("side"), "file", "w", "reach", *self.keep)
        rows = self.rows.select("block", F.explode(F.sequence(F.lit(0), F.lit(self.shares - 1))).alias("share"),
                                F.lit(0).alias("side"), "file", "w", F.lit(None).cast("double").alias("reach"), *self.keep)
        out = to_arrow_schema(StructType.fromDDL(schema))

        def run(batches):
            now, held, block = None, [], None
            for batch in batches:
                keys = [np.asarray(batch.column(i)) for i in range(3)]
                cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(batch)]):
                    if lo == hi:
                        continue
                    if (keys[0][lo], keys[1][lo]) != now:
                        now, held, block = (keys[0][lo], keys[1][lo]), [], None
                    piece = batch.slice(lo, hi - lo)
                    if keys[2][lo] == 0:
                        held.append(piece)
                        continue
                    if not held:
                        continue
                    if block is None:
                        block = kernel.prepare(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    step = max(1, CHUNK // len(block["ids"]))
                    for at in range(0, len(piece), step):
                        for columns in kernel.find(block, piece.slice(at, step)):
                            yield pa.RecordBatch.from_arrays(
                                [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
                                 for c, f in zip(columns, out)], schema=out)

        by = ["block", "share"]
        return (visits.unionByName(rows).repartition(*by).sortWithinPartitions(*by, "side").mapInArrow(run, schema))


class _Kernel:
    """The rows of a block made ready, and what is found of visits in it."""

    def __init__(self, metric: str, reach: float | None = None, radius: float | None = None, k: int | None = None,
                 include_self: bool = False, keep: tuple = (), shared: str | None = None):
        self.metric, self.reach, self.radius, self.k = metric, reach, radius, k
        self.include_self, self.keep, self.shared = include_self, keep, shared

    def prepare(self, rows: pa.RecordBatch) -> dict:
        B = _vectors(rows.column("w"))
        half = (B * B).sum(axis=1) / -2
        return {"ids": np.asarray(rows.column("file")), "B": B, "far": np.sqrt(-2 * half.min(initial=0)),
                "turned": np.concatenate([B, half[:, None], np.ones((len(B), 1))], axis=1).T,
                "kept": [rows.column(c) for c in self.keep],
                "shared": _Shared(rows.column(self.shared)) if self.shared else None}

    def find(self, block: dict, visits: pa.RecordBatch):
        ids, B = block["ids"], block["B"]
        own, A = np.asarray(visits.column("file")), _vectors(visits.column("w"))
        if self.radius is None:
            yield from self.nearest(ids, B, own, A, np.asarray(visits.column("reach")))
            return
        half = (A * A).sum(axis=1) / -2
        off = SLACK * (block["far"] + np.sqrt(-2 * half.min(initial=0)))
        # -d * d / 2 by one product
        close = np.concatenate([A, np.ones((len(A), 1)), half[:, None]], axis=1) @ block["turned"]
        row, at = np.nonzero(close >= -(self.reach + 2 * off) ** 2 / 2)
        del close
        common = block["shared"].matrix(visits.column(self.shared)) if self.shared else None
        for lo in range(0, len(row), 65_536):
            i, j = row[lo:lo + 65_536], at[lo:lo + 65_536]
            exact = _exact(A[i], B[j], self.metric)
            inside = exact <= self.radius
            i, j, exact = i[inside], j[inside], exact[inside]
            found = [own[i], ids[j], exact]
            for mine, theirs in zip((visits.column(c) for c in self.keep), block["kept"]):
                found += [mine.take(pa.array(i)), theirs.take(pa.array(j))]
            yield found + ([common[i, j]] if self.shared else [])

    def nearest(self, ids, B, own, A, reach):
        d, off = _estimate(A, B)
        if not self.include_self:
            order = np.argsort(ids, kind="stable")
            lo, hi = (np.searchsorted(ids[order], own, side) for side in ("left", "right"))
            for i in np.flatnonzero(lo < hi):
                d[i, order[lo[i]:hi[i]]] = np.inf
        if len(ids) > self.k:
            reach = np.minimum(reach, np.partition(d + off, self.k - 1, axis=1)[:, self.k - 1])
        off *= 2
        off += reach[:, None]
        row, at = np.nonzero((d <= off) & np.isfinite(d))
        for lo, hi in whole_runs(row, 65_536):
            i, j = row[lo:hi], at[lo:hi]
            exact = np.concatenate([_exact(A[i[x:x + 65_536]], B[j[x:x + 65_536]], self.metric)
                                    for x in range(0, len(i), 65_536)])
            order = np.lexsort((ids[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            best = np.arange(len(i)) - np.searchsorted(i, i, "left") < self.k
            yield own[i[best]], ids[j[best]], exact[best]


def whole_runs(row: np.ndarray, size: int):
    """Stretches of about ``size`` entries of a sorted array that split no value."""
    lo = 0
    while lo < len(row):
        hi = int(np.searchsorted(row, row[min(lo + size, len(row)) - 1], "right"))
        yield lo, hi
        lo = hi


def knn(space: DataFrame, k: int = 5, metric: str = "euclidean", include_self: bool = False,
        block_rows: int = CELL_ROWS) -> DataFrame:
    """The ``k`` nearest rows of every row (ties by id), exactly, as edges
    (a, b, distance, rank); all other rows if there are fewer than ``k``."""
    from ..session import cut_lineage

    cells = _Cells(space, metric, block_rows)
    if cells.empty:
        return space.sparkSession.createDataFrame([], EDGE_SCHEMA + ", rank long")

    def reach(pdf: pd.DataFrame) -> pd.DataFrame:
        """An upper bound of the k-th distance, from the row's own part."""
        A = _rows(pdf["w"])
        out = np.full(len(A), np.inf)
        least = k if include_self else k + 1
        if len(A) >= least:
            for lo in range(0, len(A), 1024):
                d, off = _estimate(A[lo:lo + 1024], A)
                out[lo:lo + 1024] = np.partition(d + off, least - 1, axis=1)[:, least - 1]
        return pd.DataFrame({"file": pdf["file"], "w": pdf["w"], "reach": out})

    asked = cut_lineage(cells.rows.select("file", "w", "cell", "part").groupBy("cell", "part").applyInPandas(
        reach, f"file long, w {cells.vector}, reach double"))

    w = Window.partitionBy("a").orderBy("distance", "b")
    found = cells.search(asked, _Kernel(metric, k=k, include_self=include_self), EDGE_SCHEMA)
    return (found.withColumn("rank", F.row_number().over(w).cast("long"))
            .filter(F.col("rank") <= k))


def radius_neighbors(space: DataFrame, radius: float, metric: str = "euclidean",
                     block_rows: int = CELL_ROWS, method: str = "exact",
                     lsh_bucket_length: float | None = None, lsh_tables: int = 8,
                     keep: list[str] | tuple = (), shared: str | None = None,
                     targets: list[int] | None = None) -> DataFrame:
    """Every pair (a, b) with distance <= radius, the row itself
    included (distance 0), exactly, as edges (a, b, distance).  Columns of
    ``space`` named by ``keep`` come along as ``<column>_a`` and ``<column>_b``;
    ``shared`` names an array of non-null longs and adds whether both rows'
    arrays share one (exact method).  Given ``targets``, a few files, only
    their neighbours are searched (exact method).

    ``method='lsh'`` is an approximate search (euclidean only, a subset of
    the exact edges) by ``BucketedRandomProjectionLSH``."""
    if method == "lsh":
        return _radius_lsh(space, radius, lsh_bucket_length or radius, lsh_tables)
    cells = _Cells(space, metric, block_rows, [*keep, *([shared] if shared else [])])
    if cells.empty or radius < 0:
        kept = "".join(f", {c}_{x} {space.schema[c].dataType.simpleString()}" for c in keep for x in "ab")
        return space.sparkSession.createDataFrame([], EDGE_SCHEMA + kept + (", shared boolean" if shared else ""))
    # rows of length 1 at cosine distance r lie sqrt(2 r) apart
    reach = math.sqrt(2 * radius) if metric == "cosine" else float(radius)

    schema = EDGE_SCHEMA + "".join(f", {c}_{side} {space.schema[c].dataType.simpleString()}" for c in keep for side in "ab")
    kernel = _Kernel(metric, reach, radius, keep=tuple(keep), shared=shared)
    asked = cells.rows if targets is None else cells.rows.filter(F.col("file").isin(*targets))
    return cells.search(asked.select("file", "w", F.lit(reach).alias("reach"), *cells.keep), kernel,
                        schema + (", shared boolean" if shared else ""))


def _radius_lsh(space: DataFrame, radius: float, bucket_length: float, tables: int) -> DataFrame:
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    v = space.select(F.col("file").cast("long").alias("file"),
                     array_to_vector(F.col("w").cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket_length,
                                        numHashTables=tables, seed=7).fit(v)
    j = model.approxSimilarityJoin(v, v, radius, distCol="distance")
    return j.select(F.col("datasetA.file").alias("a"), F.col("datasetB.file").alias("b"),
                    F.col("distance").cast("double").alias("distance"))


def drop_clones(edges: DataFrame) -> DataFrame:
    """Neighbours at distance 0 removed (the target itself too)."""
    return edges.filter(F.col("distance") != 0)


def with_pages(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Attach page_a / page_b from (file, page), unless the search brought them
    along (``keep``)."""
    if {"page_a", "page_b"} <= set(edges.columns):
        return edges
    pa = pages.select(F.col("file").alias("a"), F.col("page").alias("page_a"))
    pb = pages.select(F.col("file").alias("b"), F.col("page").alias("page_b"))
    return edges.join(pa, "a").join(pb, "b")


def drop_same_page(edges: DataFrame) -> DataFrame:
    """Neighbours of the target's own page removed (needs page_a, page_b)."""
    return edges.filter(F.col("page_a") != F.col("page_b"))


def _levels(e: DataFrame) -> DataFrame:
    return (e.withColumn("lvl_same_page", F.col("distance") != 0)
            .withColumn("lvl_restricted", (F.col("distance") != 0) & (F.col("page_a") != F.col("page_b"))))


def neighbor_counts(edges: DataFrame, pages: DataFrame, with_list: bool = False) -> DataFrame:
    """Per target, neighbour and page counts at the clone / same-page /
    restricted levels and the mean distance at the restricted level (NULL
    without neighbour).  Every target of ``pages`` is kept.  ``with_list``
    adds the sorted restricted neighbour ids."""
    e = _levels(with_pages(edges, pages))
    r = F.col("lvl_restricted")
    aggs = [F.count(F.lit(1)).alias("_n"), F.count_if(F.col("lvl_same_page")).alias("_s"), F.count_if(r).alias("_r"),
            F.sum(F.when(r, F.col("distance"))).alias("_d")]
    if with_list:
        aggs.append(F.collect_list(F.when(r, F.col("b"))).alias("_l"))
    by_page = e.groupBy("a", "page_b").agg(*aggs)  # few rows a task, whatever the number of edges
    aggs = [F.sum("_n").alias("n_neighbors_clone"),
            F.count("page_b").alias("n_pages_clone"),
            F.sum("_s").alias("n_neighbors_same_page"),
            F.sum("_r").alias("n_neighbors"),
            F.count_if((F.col("_r") > 0) & F.col("page_b").isNotNull()).alias("n_pages"),
            (F.sum("_d") / F.when(F.sum("_r") > 0, F.sum("_r"))).alias("mean_distance")]
    if with_list:
        aggs.append(F.array_sort(F.flatten(F.collect_list("_l"))).alias("indices_neighbors"))
    per = by_page.groupBy("a").agg(*aggs)
    targets = pages.select(F.col("file").alias("a"), F.col("page").alias("id_page"))
    out = targets.join(per, "a", "left")
    for c in ("n_neighbors_clone", "n_pages_clone", "n_neighbors_same_page", "n_neighbors", "n_pages"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return out


def co_reused_among(pairs: DataFrame, reuses: DataFrame) -> DataFrame:
    """The pairs (lo, hi) of ``pairs`` whose two files share a reuse of
    ``reuses`` (file, reuse): the reuses of one file, looked up for the other."""
    r = reuses.select("file", "reuse").distinct()
    asked = pairs.select("lo", "hi").filter(F.col("lo") < F.col("hi")).distinct()
    return (asked.join(r.select(F.col("file").alias("lo"), "reuse"), "lo")
            .join(r.select(F.col("file").alias("hi"), "reuse"), ["hi", "reuse"], "left_semi")
            .select("lo", "hi").distinct())


class _Held:
    """The reuses of files, by file and by reuse."""

    def __init__(self, files: pa.Array, reuses: pa.Array):
        times = np.diff(reuses.offsets.to_numpy())
        order = np.argsort(np.asarray(files), kind="stable")
        self.files = np.asarray(files)[order]
        codes = np.asarray(reuses.flatten().dictionary_encode().indices).astype(np.int64)
        self.n_codes = int(codes.max(initial=0)) + 1
        starts = (np.cumsum(times) - times)[order]
        self.times = times[order]
        self.codes = codes[_ranges(starts, self.times)]
        self.starts = np.cumsum(self.times) - self.times

    def pairs(self, t: np.ndarray, b: np.ndarray, size: int):
        """Positions (i, j) of the rows (t, b) of one t with b[i] < b[j] and a
        reuse in common, each once; rows are sorted.  About ``size`` candidates
        are looked at together, and all those of one i."""
        at = np.minimum(np.searchsorted(self.files, b), len(self.files) - 1)
        times = np.where(self.files[at] == b, self.times[at], 0)
        row = np.repeat(np.arange(len(b)), times)
        if not len(row):
            return
        nth = np.cumsum(np.concatenate([[0], t[1:] != t[:-1]]))
        key = nth[row] * self.n_codes + self.codes[_ranges(self.starts[at], times)]
        order = np.argsort(key, kind="stable")  # rows of one key stay sorted by b
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        there = key[order]
        ends = np.append(np.flatnonzero(there[1:] != there[:-1]) + 1, len(there))
        later = np.empty(len(order), np.int64)  # candidates of every entry
        later[order] = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(order)) - 1
        member = row[order]
        for lo, hi in _stretches(row, later, size):
            i = np.repeat(row[lo:hi], later[lo:hi])
            j = member[_ranges(place[lo:hi] + 1, later[lo:hi])]
            i, j = np.divmod(np.unique(i * len(b) + j), len(b))
            less = b[i] < b[j]
            yield i[less], j[less]


def _ranges(starts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every start, as often as ``times`` says."""
    return np.arange(times.sum()) + np.repeat(starts - (np.cumsum(times) - times), times)


def _stretches(row: np.ndarray, weight: np.ndarray, size: int):
    """Stretches of entries of a sorted array with about ``size`` of weight
    that split no value."""
    done, lo = np.cumsum(weight), 0
    while lo < len(row):
        before = done[lo - 1] if lo else 0
        hi = min(max(int(np.searchsorted(done, before + size, "right")), lo + 1), len(row))
        hi = int(np.searchsorted(row, row[hi - 1], "right"))
        yield lo, hi
        lo = hi


def _local_pairs(edges: DataFrame, reuses: DataFrame, *flags: str, held_reuses: int = HELD_REUSES) -> DataFrame:
    """(t, x1, x2, flags of x1 and x2): pairs x1 < x2 of one target's
    neighbours that share a reuse.  Targets are dealt into groups; the edges of
    a group are sorted by target and stream past the files' reuses, which every
    group gets.  Where there are more than ``held_reuses`` of them, a group
    gets one part of the reuses at a time, and the edges go to every part."""
    from ..session import cut_lineage, ship_package

    spark = edges.sparkSession
    ship_package(spark)
    edges = edges.select(F.col("a").cast("long").alias("t"), F.col("b").cast("long").alias("b"),
                         *[F.coalesce(f, F.lit(False)).alias(f) for f in flags]).dropna(subset=["t", "b"])
    r = cut_lineage(reuses.select(F.col("file").cast("long").alias("b"), "reuse").filter(
        F.col("b").isNotNull() & F.col("reuse").isNotNull()).distinct())
    parts = math.ceil(max(1, r.count()) / held_reuses)
    groups = 4 * spark.sparkContext.defaultParallelism
    kind = r.schema["reuse"].dataType.simpleString()
    lists = r.groupBy("b", F.pmod(F.xxhash64("reuse"), F.lit(parts)).cast("int").alias("part")).agg(
        F.collect_list("reuse").alias("reuses"))
    lists = lists.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "part",
                         F.lit(None).cast("long").alias("t"), "b", "reuses",
                         *[F.lit(None).cast("boolean").alias(f) for f in flags])
    asked = edges.select(F.pmod(F.xxhash64("t"), F.lit(groups)).cast("int").alias("group"),
                         F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "t", "b",
                         F.lit(None).cast(f"array<{kind}>").alias("reuses"), *flags)
    schema = "t long, x1 long, x2 long" + "".join(f", {f}{i} boolean" for i in (1, 2) for f in flags)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def find(held: _Held, rows: list):
        table = pa.Table.from_batches(rows)
        t, b = (table.column(c).to_numpy() for c in ("t", "b"))
        marks = [table.column(f).to_numpy().astype(bool) for f in flags]
        order = np.lexsort((*marks, b, t))
        t, b, marks = t[order], b[order], [m[order] for m in marks]
        new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in (t, b, *marks)], axis=0)])
        t, b, marks = t[new], b[new], [m[new] for m in marks]
        for i, j in held.pairs(t, b, CHUNK // 4):
            for lo in range(0, len(i), 65_536):
                x, y = i[lo:lo + 65_536], j[lo:lo + 65_536]
                columns = [t[x], b[x], b[y], *[m[x] for m in marks], *[m[y] for m in marks]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    def run(batches):
        now, files, held, rows, n = None, [], None, [], 0
        for batch in batches:
            keys = [np.asarray(batch.column(c)) for c in ("group", "part")] + [
                batch.column("t").fill_null(0).to_numpy(), np.asarray(batch.column("t").is_null())]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)]):
                if lo == hi:
                    continue
                here = (keys[0][lo], keys[1][lo])
                if rows and (here != now or n >= ROWS_TOGETHER and keys[2][lo] != last):
                    yield from find(held, rows)
                    rows, n = [], 0
                if here != now:
                    now, files, held = here, [], None
                piece = batch.slice(lo, hi - lo)
                if keys[3][lo]:
                    files.append(piece.select(["b", "reuses"]))
                    continue
                if held is None and files:
                    table = pa.Table.from_batches(files).combine_chunks()
                    held, files = _Held(table.column("b").combine_chunks(), table.column("reuses").combine_chunks()), []
                if held is not None:
                    rows.append(piece.select(["t", "b", *flags]))
                    n, last = n + len(piece), keys[2][lo]
        if rows:
            yield from find(held, rows)

    pairs = (asked.unionByName(lists).repartition("group", "part")
             .sortWithinPartitions("group", "part", F.col("t").asc_nulls_first()).mapInArrow(run, schema))
    return pairs if parts == 1 else pairs.distinct()


def reuse_pairs_in_neighborhood(edges: DataFrame, pages: DataFrame, reuses: DataFrame) -> DataFrame:
    """Per target, the number of neighbour pairs sharing a reuse of
    ``reuses`` (file, reuse) at the three levels."""
    e = (_levels(with_pages(edges, pages)).withColumnRenamed("lvl_same_page", "s")
         .withColumnRenamed("lvl_restricted", "r"))
    j = _local_pairs(e, reuses, "s", "r")
    per = j.groupBy("t").agg(F.count(F.lit(1)).alias("n_reuses_clone"),
                             F.count_if(F.col("s1") & F.col("s2")).alias("n_reuse_same_page"),
                             F.count_if(F.col("r1") & F.col("r2")).alias("n_reuses"))
    targets = pages.select(F.col("file").alias("t"))
    out = targets.join(per, "t", "left")
    for c in ("n_reuses_clone", "n_reuse_same_page", "n_reuses"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return out.withColumnRenamed("t", "a")


def target_reuses(edges: DataFrame, pages: DataFrame, reuses: DataFrame) -> DataFrame:
    """Per target, neighbours sharing a reuse of ``reuses`` (file, reuse)
    with the target at the three levels; the target itself shares one when
    it has any.  Edges that carry ``shared`` from the search are not looked up."""
    e = _levels(with_pages(edges, pages))
    if "shared" in e.columns:
        j, share = e, F.col("shared")
    else:
        e = e.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
        p = co_reused_among(e, reuses).withColumn("_pair", F.lit(True))
        rf = reuses.select(F.col("file").alias("a"), F.lit(True).alias("_reused")).distinct()
        j = e.join(p, ["lo", "hi"], "left").join(rf, "a", "left")
        share = F.when(F.col("a") == F.col("b"), F.coalesce(F.col("_reused"), F.lit(False))) \
            .otherwise(F.coalesce(F.col("_pair"), F.lit(False)))
    per = j.groupBy("a").agg(
        F.count_if(share).alias("n_reuses_target_clone"),
        F.count_if(share & F.col("lvl_same_page")).alias("n_reuses_target_same_page"),
        F.count_if(share & F.col("lvl_restricted")).alias("n_reuses_target"))
    targets = pages.select(F.col("file").alias("a"))
    out = targets.join(per, "a", "left")
    for c in ("n_reuses_target_clone", "n_reuses_target_same_page", "n_reuses_target"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return out


def describe_neighbors(edges: DataFrame, files: DataFrame, reuses: DataFrame) -> DataFrame:
    """Neighbour report: for each (target, neighbour) the neighbour's
    descriptive columns (from ``files`` keyed by ``file``; NULL where it has
    no row there), the distance, its rank by distance and whether it shares a
    reuse of ``reuses`` (file, reuse) with the target."""
    from ..session import cut_lineage

    e = drop_clones(edges)
    if "shared" in e.columns:
        j = e.withColumnRenamed("shared", "common_reuse")
    else:
        e = e.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
        p = co_reused_among(e, reuses).withColumn("common_reuse", F.lit(True))
        j = e.join(p, ["lo", "hi"], "left").withColumn(
            "common_reuse", F.coalesce(F.col("common_reuse"), F.lit(False)))
    info = files.withColumnRenamed("file", "b")
    # rank within a target without putting a large neighbourhood in one task;
    # the rows to be ranked are stored once, as range bounds are sampled from them
    ranked = group_row_number(cut_lineage(j), ["a"], [F.col("distance"), F.col("b")], "rank")
    return ranked.join(info, "b", "left").drop("lo", "hi")


def reuse_edges_local(edges: DataFrame, reuses: DataFrame) -> DataFrame:
    """Per target, the co-reused pairs (a, b) whose both files are in the
    target's neighbourhood (the target included, distance 0)."""
    return _local_pairs(edges, reuses).select(F.col("t").alias("target"), "x1", "x2")


def neighbors_by_page(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Neighbours of each target grouped by their page (count and sorted
    ids), clones excluded."""
    e = with_pages(drop_clones(edges), pages)
    return e.groupBy("a", "page_b").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list("b")).alias("neighbors"))
