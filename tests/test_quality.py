from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import quality, regularize


@pytest.fixture(scope="module")
def aligned(spark):
    rows = [(1, 0, 10.0, 10.0), (1, 1, 10.0, 10.5), (1, 2, 0.0, 1.0), (1, 3, 0.0, 0.0), (2, 0, 4.0, 2.0), (2, 1, 5.0, None), (2, 2, None, 1.0)]
    return spark.createDataFrame(rows, "tid int, ts int, real double, approx double")


def test_counts(aligned):
    assert sorted(map(tuple, quality.alignment_counts(aligned, 5.0).collect())) == [(1, 4, 0, 0, 1), (2, 2, 1, 1, 1)]
    assert {r.kind for r in quality.violations(aligned, 5.0).collect()} == {"missing", "extra", "outside"}


def test_error_table(aligned):
    rows = {r.tid: r for r in quality.error_table(aligned.where("real <> 0")).collect()}
    assert rows[1].average_error == pytest.approx(5.0) and rows[1].mean_absolute_error == pytest.approx(2.5)
    assert (rows[1].difference_count, rows[1]["count"], rows[2].maximum_error) == (1, 2, 50.0)


@pytest.mark.parametrize("eps, last", [(10.0, 2), (0.0, 3)])
def test_histogram_keeps_large_errors_in_the_last_bin(aligned, eps, last):
    rows = quality.error_histogram(aligned, eps).orderBy("bin").collect()
    assert len(rows) == 10 and sum(r.value for r in rows) == 5 and rows[-1].value == last
    assert rows[0].bin == pytest.approx((eps or 1) / 10 + 1e-6)


def test_ceiled_histogram_is_whole(aligned):
    rows = {r.error: r.n for r in quality.error_ceil_histogram(aligned).collect()}
    assert rows == {i: 0 for i in range(11)} | {0: 2, 5: 1, 50: 1, None: 1}


def test_mape_variants(aligned):
    both = aligned.where("real IS NOT NULL AND approx IS NOT NULL")
    one = {r.tid: r for r in quality.mape(both).collect()}
    assert one[1].mape == pytest.approx(100 * 0.05 / 4) and one[2].max_error == 0.5
    pooled = quality.mape_pooled(both).first()
    assert pooled.mape == pytest.approx((0 + 0.05 + 0.5) / 3) and pooled.inf_count == 1


def test_downsampling_bins_close_on_the_right(spark):
    p = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0, s), float(s)) for s in (0, 1, 2, 3, 4, 5, 9)], "tid int, ts timestamp, value float")
    got = regularize.downsample(p, 1000, [2]).orderBy("ts").collect()
    assert [(r.ts.second, r.value) for r in got] == [(0, 0.0), (2, 1.5), (4, 3.5), (6, 5.0), (10, 9.0)]
    rows = regularize.downsample_rows(p, 3).orderBy("ts").collect()
    assert [(r.ts.second, r.value) for r in rows] == [(2, 1.0), (5, 4.0), (9, 9.0)]
    with pytest.raises(ValueError):
        regularize.downsample_rows(p, 0)


def test_scaling_inverts(spark):
    p = spark.createDataFrame([(1, datetime(2024, 1, 1), 8.0)], "tid int, ts timestamp, value float")
    s = spark.createDataFrame([(1, 4.0)], "tid int, scaling float")
    assert regularize.scale(p, s).first().value == 32.0 and regularize.unscale(regularize.scale(p, s), s).first().value == 8.0


def test_mape_agg_exchanges_no_row_per_factor(spark):
    from catalog import quality as queries
    d = queries.mape_agg(spark, "/root/testdata/sf0.001")
    # partial sums only
    assert d._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(factor") == 1
