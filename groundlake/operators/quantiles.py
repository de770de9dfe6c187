"""Exact percentiles in bounded memory: counts of distinct values, a histogram that names one bucket, and a running sum inside it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 256  # buckets between a value and its double


def bucket(value: Column) -> Column:
    """A whole number that never falls where the value grows; values not a number come last."""
    return F.when(F.isnan(value), F.lit(2**63 - 1)).otherwise(F.floor(F.signum(value) * F.log2(1 + F.abs(value)) * STEPS))


def percentiles(rows: DataFrame, keys: tuple[str, ...], wanted: dict[str, tuple[str, float]], interpolated: bool = False) -> DataFrame:
    """``keys`` and a column for each of ``wanted``, name: (column of numbers, share); nulls don't count, a group without a value has null.

    Plain ones are the least value that at least that share of values doesn't pass; ``interpolated`` ones lie between the two nearest.

    Scale: rows are counted by value before any shuffle; a group's counts are dealt by value. A histogram of some thousand buckets a group
    names the bucket of each percentile; only its values are put in order, in a sort that spills. No task holds a group's values.
    """
    keys_, by = list(keys), [*keys, "measure"]
    columns = dict.fromkeys(c for c, _ in wanted.values())
    each = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*keys, "x.*")
    counts = each.filter("v is not null").groupBy(*by, "v").agg(F.count("*").alias("n")).withColumn("bucket", bucket(F.col("v")))
    place = Window.partitionBy(*by).orderBy("bucket")
    filled = counts.groupBy(*by, "bucket").agg(F.sum("n").alias("held"))
    filled = filled.withColumns({"upto": F.sum("held").over(place.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("held").over(Window.partitionBy(*by))})
    ranks = []
    for name, (column, share) in wanted.items():
        at = share * (F.col("total") - 1)
        some = (F.floor(at) + 1, F.ceil(at) + 1) if interpolated else (F.greatest(F.lit(1), F.ceil(share * F.col("total"))),)
        ranks += [F.when(F.col("measure") == column, F.struct(F.lit(name).alias("name"), F.lit(k).alias("side"), r.cast("bigint").alias("rank"), (at - F.floor(at)).alias("rest"))) for k, r in enumerate(some)]
    asked = filled.withColumn("w", F.explode(F.array_compact(F.array(*ranks)))).select(*by, "bucket", (F.col("upto") - F.col("held")).alias("before"), "upto", "w.*").filter("rank > before AND rank <= upto").drop("upto")
    a, c = asked.alias("a"), counts.alias("c")
    inside = a.join(c, reduce(lambda x, y: x & y, [F.col(f"a.{n}").eqNullSafe(F.col(f"c.{n}")) for n in [*by, "bucket"]])).select("a.*", "c.v", "c.n")
    running = F.col("before") + F.sum("n").over(Window.partitionBy(*by, "name", "side").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("running", running).filter("running >= rank").groupBy(*keys_, "name", "side").agg(F.min("v").alias("v"), F.any_value("rest").alias("rest"))
    side = lambda name, k: F.max(F.when((F.col("name") == name) & (F.col("side") == k), F.col("v")))
    rest = lambda name: F.max(F.when(F.col("name") == name, F.col("rest")))
    value = (lambda n: side(n, 0) + (side(n, 1) - side(n, 0)) * rest(n)) if interpolated else (lambda n: side(n, 0))
    return found.groupBy(*keys_).agg(*[value(n).alias(n) for n in wanted])


def with_percentiles(table: DataFrame, rows: DataFrame, keys: tuple[str, ...], wanted: dict[str, tuple[str, float]], interpolated: bool = False) -> DataFrame:
    """``table`` (a row for each value of ``keys``) with the percentiles of ``rows`` beside it."""
    found = percentiles(rows, keys, wanted, interpolated)
    right = found.select(*[F.col(k).alias(f"_{k}") for k in keys], *wanted)
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return table.join(right, on, "left").drop(*[f"_{k}" for k in keys])
