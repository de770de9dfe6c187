"""Numbers that come out alike on any engine and in any order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """Half up on the binary value; built-in round works on decimal text instead."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


def mean(column: str | Column) -> Column:
    """Average by a decimal sum, so that the order of additions doesn't show; null without values."""
    c = F.col(column) if isinstance(column, str) else column
    return F.sum(c.cast("decimal(18,4)")).cast("double") / F.count(c)


def percent(part: Column, whole: Column, digits: int) -> Column:
    """MT7: a rate with a guarded denominator."""
    return rounded(part.cast("double") * 100 / F.greatest(whole, F.lit(1)), digits)


def cosine(a: Column, b: Column) -> Column:
    """MT2 in double precision, kept in 0..1; a zero norm counts as 1e-9."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(dot(x, x))
    guard = lambda n: F.when(n == 0, F.lit(1e-9)).otherwise(n)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / (guard(norm(a)) * guard(norm(b)))))


def unit(v: Column) -> Column:
    """MT9: the vector over its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def valid_vector(v: Column, dimension: int) -> Column:
    """MT8: of the right size, and every number finite."""
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull()
    return v.isNotNull() & (F.size(v) == dimension) & ~F.exists(v, bad)
