"""Licence scan: sparse TF-IDF cosine of statements and licence files to
templates, then inheritance from the nearest ancestor directory.

Words are lower-cased runs of letters and digits, each weighted by
ln((1 + files) / (1 + files with the word)) + 1 over all files; words outside
the templates only lengthen a vector, common ones by little.  The units
compared are the sentences of every line of the whole text, the sentences of
every paragraph over its lines, the runs of as many words as a template that
begin with one of its words, wherever lines break, and the whole text of files
with a licence file's name.  Marks that are no letters or digits (comment
marks, quotes) part words only.  A unit without a template's telling words (its heaviest,
without which the cosine stays below the threshold) cannot reach it, so only
files and units that hold one are compared; nothing is lost.  A run is taken
apart only where its dot product reaches the threshold with the least norm
that it can have: a word weighs 1 or more, and a repeated word lengthens the
vector.

A file's own licence is its best unit's template; a file without one takes
that of the nearest directory at or above its own with a licensed licence
file.

Defined results: null text and path are empty; a path without ``/`` lies in
the root directory, whose name is empty; ties go to the smaller licence, then
path; repeated rows stay; an empty table gives an empty result; other columns
play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, sized, stage

#: Standard licence statements (public texts).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file"
                   " except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification,"
                     " are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the"
                " GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"
            " is hereby granted"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
            " associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: End of fixed values.
LICENCE_NAMES = r"(?i)^(licen[sc]e|copying|notice)([._-].*)?$"
THRESHOLD = 0.8
#: Weighted words that may be broadcast.
WORDS_AT_MOST = 200_000


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _plain(text: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def _runs(texts: DataFrame, templates, weights, idf: dict[str, float], threshold: float) -> DataFrame:
    """(file, pos, m): the runs of m words of ``texts`` (file, words) that can
    reach the threshold with a template of m words."""
    parts = {w: [0.0] * len(templates) for w in idf}
    for i, _, w, y in weights:
        parts[w][i] = idf[w] * y
    table = F.broadcast(texts.sparkSession.createDataFrame(
        [(w, idf[w] ** 2 - 1, part) for w, part in parts.items()], "w string, over double, part array<double>"))
    spots = (texts.distinct().select("file", F.size("words").alias("size"), F.posexplode("words").alias("pos", "w"))
             .join(table, "w"))
    by, hits = Window.partitionBy("file").orderBy("pos"), []
    for i, (_, text) in enumerate(templates):
        m = len(_plain(text))
        run, part = by.rangeBetween(0, m - 1), F.col("part")[i]
        least = F.sqrt(F.sum("over").over(run) + F.least(F.lit(m), F.col("size") - F.col("pos")))
        hits.append(F.when((part > 0) & (F.sum(part).over(run) >= threshold * (1 - 1e-6) * least), F.lit(m)))
    hits = spots.select("file", "pos", F.array(*hits).alias("m"))
    return stage(hits.select("file", "pos", F.explode(F.array_distinct("m")).alias("m")).where("m is not null"))


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, path, own_licence, cosine, licence, inherited_from) for every row of
    ``files`` (id, path, text)."""
    spark = files.sparkSession
    prepare(spark)
    files = files.select("id", F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    files = files.withColumn("file", F.xxhash64("id", "path", "text"))
    terms = sorted({w for _, text in templates for w in _plain(text)})
    n = files.count()
    seen = stage(files.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("w"))
                 .groupBy("w").agg(F.count("*").alias("n")))
    few = {r["w"]: r["n"] for r in seen.where(F.col("w").isin(terms)).collect()}  # at most one row per template word
    idf = {w: math.log((1 + n) / (1 + few.get(w, 0))) + 1 for w in terms}
    weights, telling = [], set()
    for i, (name, text) in enumerate(templates):
        counts = {w: _plain(text).count(w) for w in _plain(text)}
        vector = {w: c * idf[w] for w, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        weights += [(i, name, w, x / norm) for w, x in vector.items()]
        left = norm * norm
        for w in sorted(vector, key=lambda w: (-vector[w], w)):
            if left < (threshold * norm) ** 2 * (1 - 1e-9):
                break
            telling.add(w)
            left -= vector[w] ** 2
    tells = F.array(*map(F.lit, sorted(telling)))
    able = stage(files.where(F.arrays_overlap(_words(F.col("text")), tells)).select("file").distinct())
    some = files.join(sized(able), "file", "left_semi")
    name = F.substring_index("path", "/", -1)
    lines = F.split("text", r"\n|(?<=[.!?])\s+")
    paragraphs = F.split("text", r"\n[^\p{L}\p{N}\n]*(?=\n)|(?<=[.!?])\s+")
    whole = F.when(name.rlike(LICENCE_NAMES), F.array("text")).otherwise(F.array().cast("array<string>"))
    units = (some.select("file", F.explode(F.concat(lines, paragraphs, whole)).alias("unit"))
             .select("file", _words(F.col("unit")).alias("words")))
    texts = some.select("file", _words(F.col("text")).alias("words"))
    runs = sized(_runs(texts, templates, weights, idf, threshold))
    runs = texts.join(runs, "file").select("file", F.expr("slice(words, pos + 1, m)").alias("words"))
    units = (units.union(runs).where(F.arrays_overlap("words", tells)).distinct()
             .withColumn("u", F.xxhash64("file", "words")))
    counts = stage(units.select("file", "u", F.explode("words").alias("w"))
                   .groupBy("file", "u", "w").agg(F.count("*").alias("tf")))
    known = stage(seen.join(counts.select("w").distinct(), "w", "left_semi")
                  .select("w", (F.log(F.lit(1 + n) / (1 + F.col("n"))) + 1).alias("idf")))
    vectors = counts.join(sized(known, WORDS_AT_MOST), "w").withColumn("x", F.expr("tf * idf"))
    norms = vectors.groupBy("file", "u").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    table = F.broadcast(spark.createDataFrame(weights, "template int, licence string, w string, y double"))
    dots = vectors.join(table, "w").groupBy("file", "u", "template", "licence").agg(F.sum(F.expr("x * y")).alias("dot"))
    hits = (dots.join(norms, ["file", "u"]).withColumn("cosine", F.round(F.expr("dot / norm"), 6))
            .where(F.col("cosine") >= threshold))
    own = stage(hits.groupBy("file").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
                .select("file", F.col("b.licence").alias("own_licence"), (-F.col("b.c")).alias("cosine")))
    placed = (files.drop("text").join(sized(own), "file", "left")
              .withColumn("parts", F.split("path", "/"))
              .withColumn("named", F.element_at("parts", -1).rlike(LICENCE_NAMES)))
    above = F.expr("transform(sequence(0, size(parts) - 1), i -> array_join(slice(parts, 1, i), '/'))")
    here = F.expr("array_join(slice(parts, 1, size(parts) - 1), '/')")
    given = stage(placed.where("named and own_licence is not null").groupBy(here.alias("dir"))
                  .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "own_licence", "path")).alias("b"))
                  .select("dir", F.col("b.own_licence").alias("given"), F.col("b.path").alias("giver")))
    bare = (placed.where("own_licence is null").select("file", F.posexplode(above).alias("depth", "dir")).distinct()
            .join(sized(given), "dir").groupBy("file")
            .agg(F.max(F.struct("depth", "given", "giver")).alias("b"))
            .select("file", F.col("b.given").alias("given"), F.col("b.giver").alias("giver")))
    return (placed.join(bare, "file", "left")
            .select("id", "path", "own_licence", "cosine", F.coalesce("own_licence", "given").alias("licence"),
                    F.col("giver").alias("inherited_from")))
