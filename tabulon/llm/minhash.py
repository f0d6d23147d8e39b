"""Near-duplicate documents by fast similarity sketching.

A document's set holds its distinct 5-word shingles (64-bit hashes of
lower-cased words).  Its sketch has ``BANDS * ROWS`` bins: in round i every
shingle falls into one hashed bin with a hashed value, the smallest
(round, value) stays; from round t on, round t + j puts every shingle into
bin j, so that after 2t rounds at most no bin is empty.  A document needs
further rounds only until its bins are full.  Two sets agree in a bin with
probability J, concentrated like fully independent bins.

Documents with the same set are one class.  Classes that agree in a whole
band of bins are candidates (28 bands of 7: a pair at J = 0.85 is missed with
probability 2e-5) and are confirmed on the full sets.  No bucket is expanded
into all its pairs: every member is first held against the bucket's smallest
class; only members that then lie outside its component are compared further,
against the bucket's members in other components: in small buckets as joined
rows, in larger ones block by block inside tasks that emit nothing but links.
A bucket of m members with o outside costs m * o / 256 shuffled rows, split
over as many tasks as there are block pairs.

Defined results: null text is empty; a document without words is linked with
nothing; repeated rows of one id stay, each with the same answer; a row
without doc_id is not compared (component null, kept true); columns besides
doc_id and text play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, chunked, components, mix, prepare, shingles, sized, stage, text_bytes

BANDS, ROWS = 28, 7
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Buckets with up to so many pairs left are compared as joined rows, larger
#: ones in blocks of so many members, so many shared shingles at a time.
FEW_PAIRS, BLOCK, COLUMNS = 64, 256, 2048


def sketch(rows: np.ndarray, hashes: np.ndarray, n: int, bins: int) -> np.ndarray:
    """n x bins sketch of the sets given as (row, hash); rows without a
    shingle keep the largest value everywhere."""
    empty = np.uint64(2**64 - 1)
    out = np.full((n, bins), empty, np.uint64)
    flat = out.reshape(-1)
    for i in range(2 * bins):
        if not len(rows):
            break
        h = mix(hashes + SALTS[8 + i])
        at = (h % np.uint64(bins)).astype(np.int64) if i < bins else np.full(len(h), i - bins)
        value = (np.uint64(i) << np.uint64(48)) | (mix(h) >> np.uint64(16))
        np.minimum.at(flat, rows * bins + at, value)
        open_rows = (out == empty).any(axis=1)[rows]
        rows, hashes = rows[open_rows], hashes[open_rows]
    return out


def _features(bands: int, per_band: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in chunked(offsets):
                part = data[offsets[lo]:offsets[hi]]
                of, hashes = shingles(part, offsets[lo:hi + 1] - offsets[lo])
                n = hi - lo
                bins = sketch(of, hashes, n, bands * per_band).reshape(n, bands, per_band)
                keys = np.zeros((n, bands), np.uint64)
                for k in range(per_band):
                    keys += bins[:, :, k] * SALTS[2000 + k]
                keys = mix(keys + SALTS[2100:2100 + bands])
                count = np.bincount(of, minlength=n)
                first = np.concatenate([[0], np.cumsum(count)])
                sums = []
                for salt in SALTS[2050:2052]:
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ salt))])
                    sums.append(mix(total[first[1:]] - total[first[:-1]] + count.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(count.astype(np.int64)),
                    pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                    pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32),
                                             pa.array(keys.reshape(-1).view(np.int64)))],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands"])
    return run


def _sets(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for lo, hi in chunked(offsets):
            of, hashes = shingles(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            first = np.searchsorted(of, np.arange(hi - lo + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo),
                 pa.ListArray.from_arrays(first, pa.array(hashes.view(np.int64)))],
                names=["id", "items"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact overlap of each pair (a, b, n_a, n_b) on the full sets; pairs
    whose sizes alone rule the link out are not read."""
    fits = pairs.where(F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return (fits.join(left, "a").join(right, "b")
            .select("a", "b", both.alias("both"), (F.col("n_a") + F.col("n_b") - both).alias("either"))
            .withColumn("linked", F.expr(f"100 * both >= {percent} * either")))


def _links_across(percent: int):
    """Links between the two sides of a block pair whose components differ.
    Overlaps are counted over the shingles that two members share, some
    thousand columns at a time."""
    def run(group):
        sides = [group[group["side"] == k] for k in (0, 1)]
        if not len(sides[0]) or not len(sides[1]):
            return group[["id", "c"]].iloc[:0].set_axis(["a", "b"], axis=1)
        sizes = [s["items"].map(len).to_numpy() for s in sides]
        rows = [np.repeat(np.arange(len(s)), k) for s, k in zip(sides, sizes)]
        _, at, count = np.unique(np.concatenate([np.concatenate(s["items"].to_numpy()) for s in sides]),
                                 return_inverse=True, return_counts=True)
        column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[at]
        columns = np.split(column, [len(rows[0])])
        both = np.zeros((len(sides[0]), len(sides[1])), np.float32)
        for lo in range(0, int(column.max()) + 1, COLUMNS):
            flags = []
            for s, r, c in zip(sides, rows, columns):
                flag = np.zeros((len(s), COLUMNS), np.float32)
                here = (c >= lo) & (c < lo + COLUMNS)
                flag[r[here], c[here] - lo] = 1
                flags.append(flag)
            both += flags[0] @ flags[1].T
        cut = both.astype(np.int64)
        linked = 100 * cut >= percent * (sizes[0][:, None] + sizes[1][None] - cut)
        linked &= sides[0]["c"].to_numpy()[:, None] != sides[1]["c"].to_numpy()[None]
        a, b = np.nonzero(linked)
        return pd.DataFrame({"a": sides[0]["id"].to_numpy()[a], "b": sides[1]["id"].to_numpy()[b]})
    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``
    (doc_id, text); kept marks the smallest id of each component."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = stage(texts.mapInArrow(
        _features(bands, rows),
        "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"))
    classes = stage(known.where("doc_id is not null and n_shingles > 0").groupBy("d1", "d2")
                    .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"),
                         F.first("bands").alias("bands")))
    members = classes.select("id", "n", F.explode("bands").alias("key"))
    leads = (members.groupBy("key").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("*").alias("size"))
             .where("size > 1").select("key", F.col("lead.id").alias("a"), F.col("lead.n").alias("n_a")))
    buckets = stage(members.join(leads, "key").where("id <> a")
                    .select("key", "a", "n_a", F.col("id").alias("b"), F.col("n").alias("n_b")))
    stars = buckets.select("a", "b", "n_a", "n_b").distinct()
    involved = stage(stars.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    one = texts.join(sized(involved), "doc_id", "left_semi")
    sets = stage(one.mapInArrow(_sets, "id long, items array<long>").dropDuplicates(["id"]))
    near = stage(_confirm(stars, sets, percent))

    # Members of a bucket in different components.
    part = components(near.where("linked").select("a", "b"))
    part = stage(part)
    placed = (buckets.join(part.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
              .join(part.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
              .select("key", F.col("b").alias("id"), F.col("n_b").alias("n"),
                      F.coalesce("cb", "b").alias("c"), F.coalesce("ca", "a").alias("main")))
    placed = stage(placed)
    sizes = (placed.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.expr("int(c <> main)")).alias("o"))
             .where("o > 0"))
    busy = stage(placed.join(sizes, "key"))
    few = busy.where(f"m * o <= {FEW_PAIRS}")
    rest = (few.where("c <> main").alias("x").join(
        few.alias("y"), F.expr("x.key = y.key and x.c <> y.c and (y.c = y.main or x.id < y.id)"
                               f" and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"))
            .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"),
                    F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).distinct())
    more = _confirm(rest, sets, percent).where("linked").select("a", "b")
    many = (busy.where(f"m * o > {FEW_PAIRS}")
            .withColumn("blocks", F.expr(f"int(ceil(m / {BLOCK}))"))
            .withColumn("out_blocks", F.expr(f"int(ceil(o / {BLOCK}))")))
    place = F.xxhash64("id")
    left = many.where("c <> main").select(
        "key", "id", "c", F.lit(0).alias("side"), F.pmod(place, F.col("out_blocks")).alias("i"),
        F.explode(F.expr("sequence(0L, blocks - 1L)")).alias("j"))
    right = many.select(
        "key", "id", "c", F.lit(1).alias("side"), F.explode(F.expr("sequence(0L, out_blocks - 1L)")).alias("i"),
        F.pmod(place, F.col("blocks")).alias("j"))
    blocks = left.union(right).join(sets, "id").groupBy("key", "i", "j")
    more = more.union(blocks.applyInPandas(_links_across(percent), "a long, b long"))
    links = near.where("linked").select("a", "b").union(more)
    whole = components(links)
    named = (classes.select("d1", "d2", "id").join(
        whole.select(F.col("node").alias("id"), "component"), "id", "left")
        .select("d1", "d2", F.coalesce("component", "id").alias("component_id")))
    own = F.expr("doc_id is null or n_shingles = 0")
    return (known.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
            .select("doc_id", "n_shingles",
                    F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.lit(True))))


def keep_one(docs: DataFrame, percent: int = 80, bands: int = 32, rows: int = 6) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group; the other
    rows of a kept id too, if it has several."""
    prepare(docs.sparkSession)
    gone = stage(near_duplicates(docs, percent, bands, rows).where("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(sized(gone), docs["doc_id"] == F.col("_gone"), "left_anti")
