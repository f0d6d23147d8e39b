"""Text features (F1–F17): text parts, tokens, counts, document-frequency
filter, row normalisation, part mixing, stemming and TF-IDF.

The sparse matrix is kept in long form ``(doc_id, term, value)``; every step
is a groupBy / join keyed on ``doc_id`` or ``term``.  Skew: a very common
term or a very long document is one hot key; all per-key work goes through
partial aggregation.  Joins back hash their side of one row per term or
document (:func:`_per_key`), so the matrix is dealt but never sorted, and AQE
splits skewed ones.  A matrix that several branches read is a stage table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import attach_row, global_index, scalar, spread
from ..functions.text import light_french_stem_expr, stopwords, token_array

PART_WEIGHTS = {"content": 0.5, "header": 0.25, "extradata": 0.25}
PART_ORDER = ["content", "header", "extradata"]


# --------------------------------------------------------------------------
# F1–F5 text parts.  Input: one row per file with its table text, header
# text and extradata (any may be NULL).
# --------------------------------------------------------------------------

def text_part_content(text: Column, header_rows: Column | int = 1) -> Column:
    """file text without its header row(s) (the header row count, not
    the number of columns, is skipped)."""
    n = header_rows if isinstance(header_rows, Column) else F.lit(header_rows)
    text = F.coalesce(text, F.lit(""))
    head = F.call_function("substring_index", text, F.lit("\n"), n)
    return F.when(n > 0, F.substr(text, F.length(head) + 2)).otherwise(text)


def text_part_extradata(extradata: Column) -> Column:
    """extradata text, or ``''`` for a file without extradata."""
    return F.coalesce(extradata, F.lit(""))


def text_part_header(text: Column) -> Column:
    """the header line (first line of the file)."""
    return F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)


def text_part_content_header(text: Column) -> Column:
    """whole table text, header included."""
    return F.coalesce(text, F.lit(""))


def text_part_full(table_text: Column, extradata: Column) -> Column:
    """table text + ``' '`` + extradata (``''`` when absent)."""
    return F.concat(F.coalesce(table_text, F.lit("")), F.lit(" "),
                    F.coalesce(extradata, F.lit("")))


def select_text(parts: DataFrame, content: bool, header: bool, extradata: bool,
                id_col: str = "doc_id") -> DataFrame:
    """Text of one of the part sets that make sense together.

    ``parts`` has ``content`` (table text without header), ``header`` and
    ``extradata`` columns; the extradata of a file goes alone or with its whole
    table.
    """
    table_text = F.concat_ws("\n", F.col("header"), F.col("content"))
    choices = {
        ("content",): F.coalesce(F.col("content"), F.lit("")),
        ("header",): F.coalesce(F.col("header"), F.lit("")),
        ("extradata",): text_part_extradata(F.col("extradata")),
        ("content", "header"): text_part_content_header(table_text),
        ("content", "header", "extradata"): text_part_full(table_text, F.col("extradata")),
    }
    asked = tuple(name for name, on in zip(("content", "header", "extradata"), (content, header, extradata)) if on)
    if asked not in choices:
        raise ValueError(f"parts {asked} are not one of {sorted(choices)}")
    text = choices[asked]
    return parts.select(F.col(id_col).alias("doc_id"), text.alias("text"))


# --------------------------------------------------------------------------
# F7–F11 tokens, counts, df filter, row normalisation
# --------------------------------------------------------------------------

def tokenize(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
             stop: list[str] | None = None, strip_stopwords: bool = True) -> DataFrame:
    """(doc_id, tokens) — lower, accent-fold, ``\\b[a-z]{3,}\\b``, stop
    words removed (F8 list by default)."""
    stop = stopwords(strip_stopwords) if stop is None else stop
    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col))).select(
        "doc_id", token_array(F.col(text_col), stop).alias("tokens"))


def stopword_frame(spark, strip_stopwords: bool = True) -> DataFrame:
    """F8: the stop list as a small (bounded, ~190 rows) DataFrame."""
    return spark.createDataFrame([(w,) for w in stopwords(strip_stopwords)], "word string")


def _counts_in_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, count) of each row's ``tokens``: sorted, a term's run of
    tokens is counted where it lies, so no (row, term) pair is hashed."""
    # exploded as one item: sorted once, not for every use of it below
    runs = rows.select(*keys, F.explode(F.array(F.sort_array("tokens"))).alias("_sorted"))
    runs = runs.filter(F.size("_sorted") > 0)
    runs = runs.withColumn("_starts", F.filter(
        F.sequence(F.lit(0), F.size("_sorted") - 1),
        lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1))))
    runs = runs.select(*keys, "_sorted", "_starts", F.posexplode("_starts").alias("_run", "_start"))
    end = F.coalesce(F.get("_starts", F.col("_run") + 1), F.size("_sorted"))
    return runs.select(*keys, F.get("_sorted", F.col("_start")).alias("term"),
                       (end - F.col("_start")).cast("long").alias("count"))


def _per_key(rows: DataFrame) -> DataFrame:
    """One row per term or document, for joins to a matrix: hashed partition
    by partition, as sorting the matrix costs more than dealing it."""
    return rows.hint("shuffle_hash")


def _ids_repeat(docs: DataFrame, id_col: str) -> bool:
    return not docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty()


def term_counts(tokens: DataFrame) -> DataFrame:
    """(doc_id, term, count): each row's terms are counted in the row;
    rows of the same document, if there are any, are added up."""
    counts = _counts_in_rows(tokens, ["doc_id"])
    if _ids_repeat(tokens, "doc_id"):
        counts = counts.groupBy("doc_id", "term").agg(F.sum("count").alias("count"))
    return counts


def counted_terms(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                  strip_stopwords: bool = True) -> DataFrame:
    """F7 + F9 materialised once as a stage table: the counts feed several
    branches (document frequency, row sums, joins) and are far smaller than
    the text, so tokenising twice would cost more than writing them."""
    from ..session import cut_lineage

    return cut_lineage(term_counts(tokenize(docs, text_col, id_col, strip_stopwords=strip_stopwords)))


def n_documents(docs: DataFrame) -> int:
    """Number of files (rows of the matrix), empty ones included."""
    return int(scalar(docs, F.count(F.lit(1))))


def df_filter(counts: DataFrame, n_docs: int, min_df: int = 2,
              max_df: float = 0.95) -> DataFrame:
    """keep terms with ``min_df <= df <= max_df * n`` (n counts every
    file, empty ones too).  The kept-term list is joined back."""
    max_count = max_df * n_docs if isinstance(max_df, float) else max_df
    dfs = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    keep = dfs.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_count)))
    # inner join on the unique kept terms (a semi join would be pushed below
    # the count aggregate); the document frequency rides along for tfidf
    return counts.join(_per_key(keep), "term").select(*counts.columns, "df")


def normalize_rows(counts: DataFrame, n_docs: int, value_col: str = "count"):
    """scale each row to the mean row sum over all files (empty rows
    count 0 in the mean and get weight 1).  Returns (matrix, weights) where
    weights has (doc_id, row_sum, weight) for non-empty rows.  The mean is a
    one-row aggregate attached lazily, so the counts are computed once."""
    sums = counts.groupBy("doc_id").agg(F.sum(value_col).cast("double").alias("row_sum"))
    mean = sums.agg((F.sum("row_sum") / F.lit(float(n_docs) if n_docs else 1.0)).alias("_mean"))
    weights = attach_row(sums, mean).select(
        "doc_id", "row_sum",
        F.when(F.col("row_sum") == 0, F.lit(1.0)).otherwise(F.col("_mean") / F.col("row_sum"))
        .alias("weight"))
    scaled = (counts.join(_per_key(weights), "doc_id")
              .select("doc_id", "term", (F.col(value_col) * F.col("weight")).alias("value")))
    return scaled, weights


# --------------------------------------------------------------------------
# F12–F16 mixing, stemming, TF-IDF
# --------------------------------------------------------------------------

def mix_parts(matrices: dict[str, DataFrame], weights: dict[str, float] | None = None,
              mode: str = "linear") -> DataFrame:
    """one matrix over the union of the parts' vocabularies.

    ``mode='linear'``: sum of weight * value (the paper); ``'power'``: sum of
    value ** weight (the code).  A word absent from a part contributes 0.
    The output keeps ``first_part`` (rank of the first part whose vocabulary
    holds the word), the feature order used to pick representatives.
    """
    weights = weights or PART_WEIGHTS
    frames = []
    for name in PART_ORDER:
        if name not in matrices:
            continue
        w = float(weights[name])
        v = F.col("value")
        mixed = v * F.lit(w) if mode == "linear" else F.pow(v, F.lit(w))
        if mode not in ("linear", "power"):
            raise ValueError(f"unknown mixing mode {mode!r}")
        frames.append(matrices[name].select(
            "doc_id", "term", mixed.alias("value"),
            F.lit(PART_ORDER.index(name)).alias("part_rank")))
    from ..session import cut_lineage

    union = cut_lineage(reduce(DataFrame.unionByName, frames))
    first =union.groupBy("term").agg(F.min("part_rank").alias("first_part"))
    summed = union.groupBy("doc_id", "term").agg(F.sum("value").alias("value"))
    return summed.join(first, "term")


def stemmed_vocabulary(matrix: DataFrame) -> DataFrame:
    """(term, first_part, total, stem) of every word, as a stage table: the
    stemmer runs once per distinct word."""
    from ..session import cut_lineage

    if "first_part" not in matrix.columns:
        matrix = matrix.withColumn("first_part", F.lit(0))
    per_term = matrix.groupBy("term").agg(F.min("first_part").alias("first_part"),
                                          F.sum("value").alias("total"))
    return cut_lineage(per_term.withColumn("stem", light_french_stem_expr("term")))


def representatives(vocabulary: DataFrame, rule: str = "first") -> DataFrame:
    """(stem, word): ``first`` (F14) takes the first word of a stem in feature
    order (part rank, then alphabetical index), ``heaviest`` (F15) the word of
    largest total weight, first in feature order on ties."""
    keys = {"first": F.struct("first_part", "term"),
            "heaviest": F.struct((-F.col("total")).alias("neg_total"), "first_part", "term")}
    if rule not in keys:
        raise ValueError(f"unknown representative rule {rule!r}")
    return vocabulary.groupBy("stem").agg(F.min(keys[rule])["term"].alias("word"))


def stem_merge(matrix: DataFrame, representative: str = "first") -> DataFrame:
    """Sum the columns sharing a (light French) stem; label each
    stem by a representative word.  A row's ``first_part`` may be the part it
    comes from: rows of several parts are summed as well.  The word table is
    vocabulary-sized."""
    words = stemmed_vocabulary(matrix)
    words = words.join(representatives(words, representative), "stem").select("term", "word")
    return (matrix.join(_per_key(words), "term").groupBy("doc_id", "word").agg(F.sum("value").alias("value"))
            .select("doc_id", F.col("word").alias("term"), "value"))


def tfidf(matrix: DataFrame, n_docs: int, value_col: str = "value",
          df_col: str | None = None) -> DataFrame:
    """F16: idf = ln((1+n)/(1+df)) + 1 (smooth idf), tf raw, rows
    L2-normalised; rows without terms stay empty.  ``df_col`` names a
    document-frequency column already carried by the matrix (counts straight
    from :func:`df_filter`), which saves one aggregation and join.  The
    weighted rows are a stage table: their norms and the result read it."""
    from ..session import cut_lineage

    nz = matrix.filter(F.col(value_col) != 0)
    idf = F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    if df_col:
        with_df = nz.withColumnRenamed(df_col, "df") if df_col != "df" else nz
    else:
        with_df = nz.join(_per_key(nz.groupBy("term").agg(F.count(F.lit(1)).alias("df"))), "term")
    weighted = cut_lineage(with_df.select("doc_id", "term", (F.col(value_col) * idf).alias("w")))
    norms = weighted.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return (weighted.join(_per_key(norms), "doc_id")
            .select("doc_id", "term", (F.col("w") / F.col("norm")).alias("weight")))


# --------------------------------------------------------------------------
# F17 end to end
# --------------------------------------------------------------------------

def count_part(texts: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.95,
               strip_stopwords: bool = True) -> DataFrame:
    """Counts of one text part, df-filtered and row-normalised."""
    counts = df_filter(counted_terms(texts, strip_stopwords=strip_stopwords), n_docs, min_df, max_df)
    scaled, _ = normalize_rows(counts, n_docs)
    return scaled


def extract_features(parts: DataFrame, content: bool = True, header: bool = False,
                     extradata: bool = False, mode: str = "linear", stem: bool = True,
                     representative: str = "first", min_df: int = 2,
                     max_df: float = 0.95, strip_stopwords: bool = True,
                     id_col: str = "doc_id") -> DataFrame:
    """parts → per-part counts (df filter, normalisation) → mix → stem
    merge → TF-IDF, as (doc_id, term, weight).

    Each selected part is counted on its own, all of them in one table keyed
    by the part, read once each for the document frequencies, the row sums and
    the mixed values; mixing and stemming are one sum per (doc, word).  The
    allowed flag combinations are those of :func:`select_text`.
    """
    from ..session import cut_lineage, let_go

    select_text(parts, content, header, extradata, id_col)  # validates the flags
    if mode not in ("linear", "power"):
        raise ValueError(f"unknown mixing mode {mode!r}")
    n = n_documents(parts)
    chosen = [p for p, on in (("content", content), ("header", header),
                              ("extradata", extradata)) if on]
    texts = F.explode(F.array(*[F.struct(
        F.lit(PART_ORDER.index(p)).alias("part"), F.lit(PART_WEIGHTS[p]).alias("share"),
        F.coalesce(F.col(p), F.lit("")).alias("text")) for p in chosen]))
    tokens = (spread(parts).select(F.col(id_col).alias("doc_id"), texts.alias("p"))
              .select("doc_id", "p.part", "p.share",
                      token_array(F.col("p.text"), stopwords(strip_stopwords)).alias("tokens")))
    counts = _counts_in_rows(tokens, ["part", "share", "doc_id"])
    if _ids_repeat(parts, id_col):
        counts = counts.groupBy("part", "share", "doc_id", "term").agg(F.sum("count").alias("count"))
    counts = cut_lineage(counts)

    max_count = max_df * n if isinstance(max_df, float) else max_df
    keep = (counts.groupBy("part", "term").agg(F.count(F.lit(1)).alias("df"))
            .filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_count))).select("part", "term"))
    kept = cut_lineage(counts.join(_per_key(keep), ["part", "term"]))
    let_go(counts)
    sums = kept.groupBy("part", "doc_id").agg(F.sum("count").cast("double").alias("row_sum"))
    means = sums.groupBy("part").agg((F.sum("row_sum") / F.lit(float(n) if n else 1.0)).alias("mean"))
    # one row per part: a bounded broadcast
    rows = sums.join(F.broadcast(means), "part").select(
        "part", "doc_id", (F.col("mean") / F.col("row_sum")).alias("weight"))
    value = F.col("count") * F.col("weight")
    mixed = value * F.col("share") if mode == "linear" else F.pow(value, F.col("share"))
    values = cut_lineage(kept.join(_per_key(rows), ["part", "doc_id"]).select(
        "doc_id", "term", mixed.alias("value"), F.col("part").alias("first_part")))
    let_go(kept)
    if stem:
        merged = stem_merge(values, representative)
    else:
        merged = values.groupBy("doc_id", "term").agg(F.sum("value").alias("value"))
    merged = cut_lineage(merged)
    let_go(values)
    features = tfidf(merged, n)
    let_go(merged)
    return features


def vocabulary(matrix: DataFrame) -> DataFrame:
    """(word, index) with index = alphabetical rank of the word, the
    feature order of the count step.  Distributed global rank (range
    partitioning + per-partition offsets), no single-task window."""
    words = matrix.select(F.col("term").alias("word")).distinct()
    return global_index(words, "word", "index")
