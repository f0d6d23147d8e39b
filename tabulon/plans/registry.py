"""All registered queries and their DuckDB oracles, gathered by area."""

from __future__ import annotations

import importlib

AREAS = ["q_text", "q_catalog", "q_pairs", "q_neigh", "q_topics", "q_tablize", "q_sources"]


def _modules():
    return [importlib.import_module(f"tabulon.plans.{name}") for name in AREAS]


def _shipped(fn):
    """Wrap a query so the package reaches the executors first."""
    import functools

    @functools.wraps(fn)
    def run(spark, sf_dir):
        from ..session import ship_package

        ship_package(spark)
        return fn(spark, sf_dir)

    return run


def all_queries():
    out = {}
    for m in _modules():
        out.update({name: _shipped(fn) for name, fn in m.QUERIES.items()})
    return out


def all_oracles():
    out = {}
    for m in _modules():
        out.update(m.ORACLE)
    return out
