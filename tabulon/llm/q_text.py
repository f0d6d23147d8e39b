"""Registered queries: tokens, personal data and toxicity of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import personal
from .common import table
from .pieces import encode_checked
from .toxicity import classify


def op8_sentencepiece(spark, sf_dir):
    return encode_checked(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_toxicity(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"),
                    table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op3_pii(spark, sf_dir):
    found = personal.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = "filter(spans, s -> s.base)"
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as bigint)").alias(f"n_{k}")
                    for k in personal.BASE_KINDS],
        F.sha2(F.expr(joined.format(base)), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"),
        F.expr("cast(size(filter(spans, s -> not s.base)) as bigint)").alias("n_added"))


QUERIES = {"op3_pii": op3_pii, "op8_sentencepiece": op8_sentencepiece, "op9_toxicity": op9_toxicity}

ORACLE: dict[str, str] = {}
