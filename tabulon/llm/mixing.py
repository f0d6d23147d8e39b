"""Mixing sources to target weights by the cube method.

Targets: the sources in code-point order (null last) weigh 5, 2, 1, repeating,
and share ``SHARE`` of all sizes; a target stops at ``MOST`` times its
source's size and the excess is shared again by weight until none is above.
A document is taken floor(r) times, r = target / source size, and once more
with probability r - floor(r).  These last draws are balanced: in the flight
phase three documents at a time move along the null space of the constraints
(words taken, documents taken) until one of them is decided, so that both
totals of the source stay what they are; buckets of a source fly side by side
and leave three undecided documents at most, which meet in fewer buckets
until one is left.  The landing decides the last three with a few set aside,
the largest and some of all sizes: of all sums of words that a choice of them
can reach (a dynamic program over sums and counts) it takes the one nearest to
the words that remain, then the one nearest in documents.  All draws follow
hashes of the rows: reruns agree.

Defined results: size is the number of words, null text has none; documents
of size 0 are taken 0 times; rows without doc_id and repeated rows are
documents of their own; an empty table, or one without words, gives target 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import global_index
from .common import fresh, prepare, sized, stage

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents that fly together in one task, on average.
BUCKET = 2_000
#: Documents of a source that do not fly, the largest and others spread over its
#: sizes: with the last three open ones they make the landing problem.
LARGEST, SPREAD = 12, 20
#: Steps in which the landing tells sums apart (one word, while the sum is below).
STEPS = 2**17


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, docs, target) of a table with source and size."""
    totals = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
              .withColumn("by", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("at") % len(WEIGHTS) + 1).cast("int"))
    rows = stage(global_index(totals, "by", "at").select(
        "source", "source_size", "docs", weight.alias("weight"), (MOST * F.col("source_size")).alias("most")))
    whole = SHARE * (rows.agg(F.sum("source_size")).first()[0] or 0)
    rate, at_most = 0.0, -1
    while True:  # the sources at their most only grow in number
        full = F.expr("most = 0") | (F.lit(rate) * F.col("weight") >= F.col("most"))
        n, held, free = rows.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("most")).otherwise(0.0)),
                                 F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == at_most or not free:
            break
        rate, at_most = (whole - held) / free, n
    return rows.select("source", "source_size", "docs",
                       F.least(F.lit(rate) * F.col("weight"), F.col("most")).alias("target"))


def fly(size: np.ndarray, chance: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Flight phase: chances moved to 0 or 1 with sum(chance) and
    sum(chance * size) unchanged, but for three at most that stay between."""
    p = chance.tolist()
    s = size.tolist()
    held: list[int] = []
    for nxt, u in enumerate(draw.tolist()):
        held.append(nxt)
        if len(held) < 3:
            continue
        a, b, c = held
        way = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if not any(way):
            way = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / w if w > 0 else p[i] / -w for i, w in zip(held, way) if w)
        down = min(p[i] / w if w > 0 else (1 - p[i]) / -w for i, w in zip(held, way) if w)
        move = up if u * (up + down) < down else -down
        for i, w in zip(held, way):
            p[i] += move * w
            if p[i] < 1e-9 or p[i] > 1 - 1e-9:
                p[i] = float(round(p[i]))
        open_ = [i for i in held if 0 < p[i] < 1]
        held = open_ if len(open_) < 3 else open_[1:]  # rounding left none decided: keep the newest
    return np.array(p)


def land(size: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Decide the few that are open: the choice nearest to the words that
    remain, then nearest in documents.  Bit x of reach[k][c] says that some c of
    the first k documents have x steps of words."""
    unit = max(1, int(size.sum()) // STEPS + 1)
    steps = [round(s / unit) for s in size]
    reach = [[1]]
    for s in steps:
        last = reach[-1]
        reach.append([(last[c] if c < len(last) else 0) | (last[c - 1] << s if c else 0) for c in range(len(last) + 1)])
    words, docs = (chance * size).sum() / unit, chance.sum()
    best = None
    for count, sums in enumerate(reach[-1]):
        below = sums & ((1 << int(words) + 1) - 1)
        above = sums >> int(words) + 1
        near = [below.bit_length() - 1] if below else []
        near += [int(words) + (above & -above).bit_length()] if above else []
        for x in near:
            found = (abs(x - words), abs(count - docs), count, x)
            best = found if best is None or found < best else best
    _, _, count, x = best
    picked = np.zeros(len(steps))
    for k in range(len(steps), 0, -1):
        if not (count < len(reach[k - 1]) and reach[k - 1][count] >> x & 1):
            picked[k - 1] = 1.0
            count, x = count - 1, x - steps[k - 1]
    return picked


def _level(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["draw", "row"], kind="stable").reset_index(drop=True)
    chance = group["chance"].to_numpy(float).copy()
    size = group["size"].to_numpy(float)
    draw = (group["draw"].to_numpy() + 0.5) / 2**31
    last = group["buckets"].iat[0] == 1
    by_size = np.argsort(size, kind="stable")
    rest = by_size[:max(0, len(size) - LARGEST)]
    spot = np.unique((np.linspace(0, 1, SPREAD) * (len(rest) - 1)).astype(int)) if len(rest) else []
    aside = np.concatenate([rest[spot], by_size[len(rest):]]).astype(int) if last else by_size[:0]
    alive = np.setdiff1d(np.arange(len(group)), aside)
    while True:
        before = len(alive)
        chance[alive] = fly(size[alive], chance[alive], draw[alive])
        alive = alive[(chance[alive] > 0) & (chance[alive] < 1)]
        if len(alive) <= 3 or len(alive) == before:
            break
    if last:
        chance[alive[3:]] = np.round(chance[alive[3:]])
        alive = np.concatenate([alive[:3], aside])
        chance[alive] = land(size[alive], chance[alive])
    return group.assign(chance=chance)


def mix(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row
    of ``docs`` (doc_id, text, source)."""
    prepare(docs.sparkSession)
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    rows = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"),
                             words.cast("long").alias("size")))
    return _draws(rows, stage(targets(rows)), ["doc_id"], bucket)


def resample(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.  Rows that
    are equal in id, source and text share their draws' total."""
    prepare(docs.sparkSession)
    size, key, n, part = fresh(docs, "size", "key", "n", "part")
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "source", "text"))
    rows = stage(keyed.select(F.col(key).alias("key"), F.col("source").cast("string").alias("source"),
                              words.cast("long").alias("size")))
    drawn = stage(_draws(rows, stage(targets(rows)), ["key"], bucket).groupBy("key")
                  .agg(F.sum("copies").alias(n), F.count("*").alias(part))
                  .where(F.col(n) > 0).withColumnRenamed("key", key))
    out = keyed.join(sized(drawn), key)
    # rows with the same key: each is repeated for its share, rounded up for the first ones
    again = out.where(F.col(part) > 1).withColumn(size, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    times = F.expr(f"int((`{n}` + `{part}` - `{size}`) div `{part}`)")
    times_one = F.col(n).cast("int")
    one = out.where(F.col(part) == 1).withColumn(n, times_one).drop(part)
    more = again.withColumn(n, times).drop(part, size)
    out = one.unionByName(more).where(F.col(n) > 0)
    return out.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def _draws(rows: DataFrame, per: DataFrame, keep: list[str], bucket: int) -> DataFrame:
    """Rows (``keep``, size, source) with source_size, target, copies, taken."""
    joined = rows.join(sized(per.withColumnRenamed("source", "_source")),
                       F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-12)
    joined = (joined.withColumn("base", whole.cast("double"))
              .withColumn("chance", F.greatest(ratio - whole, F.lit(0.0)))
              .withColumn("chance", F.expr("if(size = 0 or chance < 1e-12, 0.0D, chance)"))
              .withColumn("row", F.xxhash64(*keep, "size"))
              .withColumn("draw", F.pmod(F.xxhash64("row", F.lit("draw")), F.lit(2**31)))
              .withColumn("buckets", F.ceil(F.col("docs") / bucket)))
    columns = [*keep, "size", "source", "source_size", "target", "base", "chance", "row", "draw", "buckets"]
    joined = joined.select(*columns)
    done, now = joined.where("chance = 0"), joined.where("chance > 0")
    steps = 1 + max(0, math.ceil(math.log(max(1, (per.agg(F.max("docs")).first()[0] or 1) / bucket), bucket / 4)))
    for step in range(steps + 1):
        spot = F.pmod(F.xxhash64("row", F.lit(step)), F.col("buckets"))
        now = stage(now.withColumn("bucket", spot).groupBy("source", "bucket")
                    .applyInPandas(_level, now.schema.add("bucket", "long")).drop("bucket"))
        done = done.union(now.where("chance in (0, 1)"))
        now = now.where("chance > 0 and chance < 1").withColumn(
            "buckets", F.lit(1).cast("long") if step + 1 >= steps else F.ceil(F.col("buckets") * 4 / bucket))
    return done.select(*keep, "size", "source", "source_size", "target",
                       (F.col("base") + F.col("chance")).cast("long").alias("copies"),
                       ((F.col("base") + F.col("chance")) * F.col("size")).cast("long").alias("taken"))
