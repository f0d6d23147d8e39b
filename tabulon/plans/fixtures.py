"""Wiring of the driver tables to the pipeline's concepts.

| concept                          | driver table stand-in                     |
| -------------------------------- | ----------------------------------------- |
| cleaned file and its text        | documents (doc_id, text)                  |
| header / content / extradata     | first line / rest of documents.text;     |
|                                  | conversations by role system/user/assistant |
| extension, producer              | documents.lang, documents.source          |
| page of a topic-space row        | embeddings.label                          |
| page–reuse bridge                | lineitem: l_orderkey = reuse, l_partkey = file, part.p_brand = page |
| tags                             | tokens of part.p_name                     |
| topic space W                    | embeddings.embedding                      |
| reused-together label and score  | labels.quality, documents.n_chars         |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.textfeat import text_part_content, text_part_header

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, header, content, extradata) from documents: the first line is
    the header, the rest the table content; no extradata."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id",
                    text_part_header(F.col("text")).alias("header"),
                    text_part_content(F.col("text"), 1).alias("content"),
                    F.lit(None).cast("string").alias("extradata"))


def conversation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, header, content, extradata) from conversations: system turns
    are the header, user turns the content, assistant turns the extradata,
    each joined in turn order."""
    c = table(spark, sf_dir, "conversations")

    def part(role):
        return F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(F.col("role") == role, F.struct("turn", "text")))), lambda s: s["text"]), "\n")

    agg = c.groupBy("conv_id").agg(part("system").alias("header"),
                                   part("user").alias("content"),
                                   part("assistant").alias("extradata"))
    return agg.select(F.col("conv_id").alias("doc_id"),
                      *[F.when(F.col(x) == "", None).otherwise(F.col(x)).alias(x)
                        for x in ("header", "content", "extradata")])


def file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, page) from part: file = p_partkey, page = p_brand."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"),
                                               F.col("p_brand").alias("page"))


def file_reuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, reuse) edges of the bridge: lineitem (l_partkey, l_orderkey)."""
    return (table(spark, sf_dir, "lineitem")
            .select(F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("reuse"))
            .distinct())


def topic_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W as (file, page, w array<double>) from embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("file"), F.col("label").alias("page"),
                    F.col("embedding").cast("array<double>").alias("w"))


# ---------------------------------------------------------------------------
# Round-trip fixtures for the tablizing operators
# ---------------------------------------------------------------------------

PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
PART_ROWS_PER_FILE = 40
CUSTOMER_ROWS_PER_FILE = 150


def _text_files(df, key, cols, sep, per_file, prefix, comment, empty_col=None):
    parts = [F.col(c).cast("string") for c in cols] + ([F.lit("")] if empty_col else [])
    line = F.concat_ws(sep, *parts)
    fid = F.concat(F.lit(prefix), F.floor(F.col(key) / per_file).cast("string"))
    rows = df.select(fid.alias("file_id"), F.col(key).alias("_k"), line.alias("line"))
    body = rows.groupBy("file_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_k", "line"))), lambda s: s["line"]), "\n").alias("body"))
    head = sep.join(cols + ([empty_col] if empty_col else []))
    text = F.concat(F.lit(comment + " "), F.substring_index("file_id", "-", -1), F.lit("\n" + head + "\n"),
                    F.col("body"))
    return body.select("file_id", text.alias("text"))


def delimited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files with a comment line, a header and rows: part rows with
    ``;`` (40 per file), customer rows with ``,`` (150 per file, so they are
    sampled) and an always-empty last column ``c_comment``."""
    part = _text_files(table(spark, sf_dir, "part"), "p_partkey", PART_COLS, ";",
                       PART_ROWS_PER_FILE, "part-", "# part batch")
    cust = _text_files(table(spark, sf_dir, "customer"), "c_custkey", CUSTOMER_COLS, ",",
                       CUSTOMER_ROWS_PER_FILE, "cust-", "# customer batch", "c_comment")
    return part.unionByName(cust)


def quoted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part files with every fourth name quoted: it holds the delimiter
    and, doubled, the quotes around its brand."""
    part = table(spark, sf_dir, "part")
    quoted = F.concat(F.lit('"'), F.col("p_name"), F.lit('; said ""'), F.col("p_brand"), F.lit('"""'))
    part = part.withColumn("p_name", F.when(F.col("p_partkey") % 4 == 0, quoted).otherwise(F.col("p_name")))
    return _text_files(part, "p_partkey", PART_COLS, ";", PART_ROWS_PER_FILE, "part-", "# part batch")


def multiline_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part files with every third name quoted and over three lines, the
    second of them empty; it holds the delimiter and doubled quotes.  Every
    fifth type starts with a quote that is none of a field's."""
    part = table(spark, sf_dir, "part")
    long = F.concat(F.lit('"'), F.col("p_name"), F.lit('; ""\n\n'), F.col("p_brand"), F.lit('"";;"'))
    part = (part.withColumn("p_name", F.when(F.col("p_partkey") % 3 == 0, long).otherwise(F.col("p_name")))
            .withColumn("p_type", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit('"so" '), F.col("p_type")))
                        .otherwise(F.col("p_type"))))
    return _text_files(part, "p_partkey", PART_COLS, ";", PART_ROWS_PER_FILE, "part-", "# part batch")
