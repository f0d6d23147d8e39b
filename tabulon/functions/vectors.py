"""Array-column vector math kept JVM-side (higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def abs_diff(a: Column, b: Column) -> Column:
    """Element-wise |a - b|."""
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def norm_l1(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.abs(v))


def norm_l2(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v))


def norm_inf(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0), lambda acc, v: acc + v))


def all_finite(x: Column) -> Column:
    return F.forall(x, lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def mat_vec(rows: list[list[float]], x: Column) -> Column:
    """``M @ x`` for a small literal matrix M (k x k, driver-side)."""
    out = []
    for r in rows:
        coeffs = F.array(*[F.lit(float(v)) for v in r])
        out.append(F.aggregate(F.zip_with(coeffs, x, lambda c, v: c * v), F.lit(0.0),
                               lambda acc, v: acc + v))
    return F.array(*out)
