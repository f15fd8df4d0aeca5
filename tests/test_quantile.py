"""Exact medians against Spark's own, on awkward values."""

import random

import pytest
from pyspark.sql import functions as F

from tidegauge.plans.quantile import exact_median

INF, NAN = float("inf"), float("nan")


def both(spark, rows, kind):
    d = spark.createDataFrame(rows, f"k int, v {kind}")
    own = {r.k: r.median for r in exact_median(d, ["k"], "v").collect()}
    spark_median = {r.k: r.m for r in d.groupBy("k").agg(F.median("v").alias("m")).where("m IS NOT NULL").collect()}
    return {k: str(v) for k, v in own.items()}, {k: str(v) for k, v in spark_median.items()}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_awkward_values(spark, kind):
    cases = [[NAN, 0.5, 0.25, 100.0, 200.0], [INF, 1.0, 2.0], [-INF, -INF, 3.0], [NAN, NAN, 1.0], [0.0, -0.0, 0.0], [1e-40, -1e-40, 2e-45], [INF, INF, -INF, -INF, 1.0],
             [5.0], [1.0, 2.0], [NAN], [None, 7.0], [-3.0, -1.0, -2.0, -8.0]]
    if kind == "double":
        cases += [[1e-300, 2e-300, 5e-324], [1.7e308, 1.6e308, 1.0], [1 + k * 2.0 ** -52 for k in range(9)]]
    own, want = both(spark, [(k, v) for k, values in enumerate(cases) for v in values], kind)
    assert own == want


def test_random_doubles(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([rng.gauss(0, 1), rng.gauss(1000, 1e-6), rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300)])) for k in range(6) for _ in range(rng.randrange(1, 400))]
    own, want = both(spark, rows, "double")
    assert own == want
