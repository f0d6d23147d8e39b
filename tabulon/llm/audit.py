"""Filter interaction audit by contingency tensor contractions.

Every row fails or passes each of five filters.  Counted per part, the rows
form a 2x2x2x2x2 tensor (0: passes, 1: fails; one axis a filter), and whatever
an order of the filters does follows from it: a step keeps the cells that pass
on the axes so far, removes those that also fail on its own, and so on.  One
``einsum`` answers all 120 orders x 5 steps by taking pass, fail or all along
each axis.  Spark counts the cells; a task contracts one part's 32 cells (times
good / toxic marks), however many rows they stand for.

Repeats ("E") are told by the SHA-256 of the text.  Equal texts share all other
conditions, so rows are first counted per (doc_id, text, part, marks) and per
(text, part, marks); what is compared within a text is a few counts, not rows.

Defined results: null text is empty; null part is the empty string; a row
without doc_id repeats nothing and no row repeats it; rows of one doc_id do not
repeat each other; repeated rows count as often as they stand there; labels of
one id count as good or toxic if any row says so, ids without labels are
neither; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage

FILTERS = "ABCDE"
#: Failure conditions of A to D over ``t`` (the text) and ``w`` (its words).
CONDITIONS = {
    "A": "size(w) < 100",
    "B": "100 * size(array_distinct(w)) < 80 * size(w)",
    "C": "100 * regexp_count(t, '[A-Z]') > 10 * length(t)",
    "D": "t rlike '[#$%&*|]'",
}
SCHEMA = ("part string, filter_order string, step int, filter string, kept long, removed long, redundant long, "
          "unique_fails long, good_lost long, toxic_lost long, shapley long")


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, a, b, c, d): digest of the text and whether it
    fails A to D, per row of ``docs`` (doc_id, text, lang)."""
    text = docs.selectExpr("doc_id", "coalesce(cast(lang as string), '') as part", "coalesce(cast(text as string), '') as t")
    words = r"regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+', 0)"
    # one lambda binds the words, so that the text is split once
    both = f"named_struct('a', {CONDITIONS['A']}, 'b', {CONDITIONS['B']})"
    held = F.expr(f"transform(array({words}), w -> {both})[0]")
    return (text.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), held.alias("held"),
                        F.expr(CONDITIONS["C"]).alias("c"), F.expr(CONDITIONS["D"]).alias("d"))
            .select("doc_id", "part", "digest", "held.a", "held.b", "c", "d"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, a, b, c, d, e, good, toxic, n): rows per cell and mark."""
    marks = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    own = ["part", "digest", "a", "b", "c", "d"]
    rows = failures(docs).withColumn("doc_id", F.col("doc_id").cast("long")).groupBy("doc_id", *own).agg(F.count("*").alias("n"))
    marked = rows.join(marks, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", *own, "n", *[F.coalesce(m, F.lit(False)).alias(m) for m in ("good", "toxic")])
    own += ["good", "toxic"]
    # per text, part and marks: all rows, the smallest id and the rows that have it, and the rows without id
    texts = marked.groupBy(*own).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("of_least"),
        F.coalesce(F.sum(F.expr("if(doc_id is null, n, 0)")), F.lit(0)).alias("without"))
    first = texts.selectExpr("*", "min(least) over (partition by digest) as first")
    passing = "without + if(least is not null and least = first, of_least, 0)"
    sides = F.expr(f"explode(array(struct(false as e, {passing} as m), struct(true as e, n - ({passing}) as m)))")
    return (first.select(*own, sides.alias("side")).where("side.m > 0")
            .groupBy("part", "a", "b", "c", "d", "side.e", "good", "toxic").agg(F.sum("side.m").alias("n")))


def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def selectors(kind: str) -> np.ndarray:
    """600 x 5 x 2: what each step of each order takes along every axis."""
    out = np.empty((120, 5, 5, 2), np.int64)
    for i, order in enumerate(orders()):
        for step, name in enumerate(order):
            for axis, other in enumerate(FILTERS):
                earlier = other in order[:step]
                out[i, step, axis] = {
                    "kept": PASS if earlier or other == name else ALL,
                    "removed": PASS if earlier else FAIL if other == name else ALL,
                    "fails": FAIL if other == name else ALL,
                    "unique": FAIL if other == name else PASS}[kind]
    return out.reshape(600, 5, 2)


def contract(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Sum of a 2x2x2x2x2 tensor under each row of selectors."""
    return np.einsum("abcde,na,nb,nc,nd,ne->n", tensor, *(chosen[:, k] for k in range(5)), optimize=True)


def interactions(part: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part, from its cells."""
    at = tuple(part[c].to_numpy(np.int64) for c in "abcde")
    n = part["n"].to_numpy(np.int64)

    def tensor(mark=None):
        out = np.zeros((2,) * 5, np.int64)
        np.add.at(out, at, n if mark is None else n * part[mark].to_numpy(np.int64))
        return out

    whole, taken = tensor(), selectors("removed")
    removed = contract(whole, taken)
    names = np.array([name for order in orders() for name in order])
    summed = {f: int(removed[names == f].sum()) for f in FILTERS}
    return pd.DataFrame({
        "part": part["part"].iloc[0], "filter_order": np.repeat(orders(), 5), "step": np.tile(np.arange(1, 6), 120),
        "filter": names, "kept": contract(whole, selectors("kept")), "removed": removed,
        "redundant": contract(whole, selectors("fails")) - removed, "unique_fails": contract(whole, selectors("unique")),
        "good_lost": contract(tensor("good"), taken), "toxic_lost": contract(tensor("toxic"), taken),
        "shapley": [summed[f] for f in names]})


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: what the step keeps
    and removes, what it would remove had others not done so before, what only
    it removes, and its part of all removals over all orders."""
    prepare(docs.sparkSession)
    return stage(cells(docs, labels)).groupBy("part").applyInPandas(interactions, SCHEMA)
