import math
import random

import numpy as np

from groundlake.operators import quantiles

WANTED = {"least": ("x", 0.0), "half": ("x", 0.5), "high": ("x", 0.95), "most": ("x", 1.0), "other": ("y", 0.5)}


def brute(values, share, interpolated):
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    if interpolated:
        return float(np.quantile(values, share))
    return values[max(1, math.ceil(share * len(values))) - 1]


def test_percentiles_are_brute_force(spark):
    draw = random.Random(2)
    value = {"a": lambda: draw.choice([None, draw.gauss(0, 1000), 5.0, -5.0, 0.0, 1e-12, -1e300]), "b": lambda: float(draw.randrange(10)), None: lambda: draw.random(), "d": lambda: None}
    rows = [(g, value[g](), draw.random()) for g in value for _ in range(301)] + [("one", 7.5, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    for interpolated in (False, True):
        got = {r.g: r.asDict() for r in quantiles.percentiles(df, ("g",), WANTED, interpolated).collect()}
        for g in [*value, "one"]:
            for name, (column, share) in WANTED.items():
                want = brute([r[1 if column == "x" else 2] for r in rows if r[0] == g], share, interpolated)
                assert got[g][name] == want or math.isclose(got[g][name], want, rel_tol=1e-12), (g, name)
    beside = quantiles.with_percentiles(df.select("g").distinct(), df.filter("g <> 'b'"), ("g",), WANTED).collect()
    assert len(beside) == 5 and all((r.other is None) == (r.g in ("b", "one", None)) for r in beside)
    assert quantiles.percentiles(df.limit(0), ("g",), WANTED).count() == 0


def test_values_not_a_number_come_last_and_buckets_never_fall(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, math.inf), (1, 3.0), (1, -math.inf)], "g int, x double")
    row = quantiles.percentiles(df, ("g",), {"a": ("x", 0.25), "b": ("x", 0.5), "c": ("x", 0.75), "d": ("x", 1.0)}).first()
    assert (row.a, row.b, row.c) == (-math.inf, 3.0, math.inf) and math.isnan(row.d)
    values = sorted([-1e308, -7.0, -1.0, -1e-9, 0.0, 1e-9, 0.5, 1.0, 1.001, 7.0, 1e308, *np.random.default_rng(1).normal(0, 50, 500).tolist()])
    buckets = [r.b for r in spark.createDataFrame([(v,) for v in values], "x double").select(quantiles.bucket(quantiles.F.col("x")).alias("b")).collect()]
    assert buckets == sorted(buckets)


def test_no_task_holds_the_values_of_a_group(spark):
    """The one window over values is dealt by bucket; nothing collects."""
    df = spark.range(1000).selectExpr("1 AS g", "CAST(id AS DOUBLE) AS x")
    plan = quantiles.percentiles(df, ("g",), {"p": ("x", 0.95)})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.replace("percentiles", "") and "collect_" not in plan
