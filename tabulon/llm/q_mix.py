"""Registered queries: mixing sources to target weights."""

from __future__ import annotations

from .common import table
from .mixing import mix


def op7_mixing(spark, sf_dir):
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


QUERIES = {"op7_mixing": op7_mixing}

ORACLE: dict[str, str] = {}
