"""Queries and DuckDB oracles of the package, by name."""

from __future__ import annotations

import corpus_pipeline

from . import q_chat, q_corpus, q_dedup, q_licence, q_mix, q_search, q_text

MODULES = [q_chat, q_corpus, q_dedup, q_licence, q_mix, q_search, q_text]


def all_queries():
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def all_oracles():
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
