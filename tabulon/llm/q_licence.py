"""Registered query: licences of documents laid out as a tree of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .licences import scan

#: Each source is a tree: 4096 documents a directory, 64 a subdirectory; every
#: 8th document is named as a licence file.
PATH = ("concat_ws('/', coalesce(source, 'none'), concat('d', doc_id div 4096), concat('s', doc_id div 64),"
        " if(doc_id % 8 = 0, concat('LICENSE.', doc_id), concat(doc_id, '.txt')))")


def op2_licence_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(PATH).alias("path"), "text")
    return scan(docs).withColumnRenamed("id", "doc_id")


QUERIES = {"op2_licence_scan": op2_licence_scan}

ORACLE: dict[str, str] = {}
