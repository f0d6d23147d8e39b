"""Corpus pipeline: toxicity, near-duplicates, personal data, source mixing
and tokens, each stage over all rows that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet under the shared checkpoint folder and the next stage reads it.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from tabulon.llm import minhash, mixing, personal, pieces, toxicity
from tabulon.llm.common import stage, table


def drop_toxic(spark, docs, sf_dir):
    """Operator 9: rows scored 0.5 or more go; trained on labels of the rows at hand."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_near_duplicates(spark, docs, sf_dir):
    """Operator 6: of each group of similarity 0.8 the smallest doc_id stays."""
    return minhash.keep_one(docs, 80)


def redact_personal(spark, docs, sf_dir):
    """Operator 3: spans of personal data become their kind's name."""
    return personal.redact(docs)


def mix_sources(spark, docs, sf_dir):
    """Operator 7: every row as often as the mix takes it."""
    return mixing.resample(docs)


def encode(spark, docs, sf_dir):
    """Operator 8: piece ids of every whole text, checked by decoding."""
    return pieces.encode_checked(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("pii", redact_personal),
          ("mixing", mix_sources), ("tokens", encode)]

#: Trained models and balanced draws have no SQL form; tests hold each stage
#: against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
