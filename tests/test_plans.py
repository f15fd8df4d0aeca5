"""Physical plans: what must not appear, and what must reach the scan."""

import re

import pytest
from pyspark.sql import functions as F

from catalog import fixtures as fx
from tidegauge.operators import aggregate, view

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def groups(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return fx.store(spark, SF, "pts_seq")


def test_segment_aggregates_stay_in_the_jvm_and_skip_payloads(groups):
    text = plan(aggregate.agg_segments(view.members(groups), ["tid"]))
    assert "ArrowEvalPython" not in text and "payload" not in text


def test_counts_read_three_columns(groups):
    text = plan(view.count_points(groups))
    assert "ReadSchema: struct<n_ticks:int,tids:array<int>>" in text


def test_time_range_reaches_the_scan(groups):
    text = plan(view.points(groups, ts_from="2024-01-01 00:01:00", ts_to="2024-01-01 00:02:00"))
    assert "GreaterThanOrEqual(end_time,2024-01-01 00:01:00.0)" in text and "LessThanOrEqual(start_time,2024-01-01 00:02:00.0)" in text


def test_group_filter_reaches_the_scan(spark, groups):
    text = plan(view.points(groups, tids=[3], gids=view.gids_of(fx.series_seq(spark, SF), [3])))
    assert "EqualTo(gid,3)" in text or "In(gid, [3])" in text


def test_period_partitions_are_pruned(groups):
    from tidegauge.sources.store import scan_range
    text = plan(scan_range(groups, "day", "2024-01-01", "2024-01-02"))
    assert "PartitionFilters: [isnotnull(period" in text


def test_only_clipped_segments_are_decoded(groups):
    clipped = view.clip(view.members(groups), "2024-01-01 00:01:00")
    text = plan(aggregate.agg_segments(clipped, ["tid"], clipped=True))
    assert "CASE WHEN" in text and "ArrowEvalPython" in text


@pytest.mark.parametrize("name", list(fx.POINTS))
def test_no_cartesian_product_in_the_point_tables(spark, name):
    text = plan(fx.POINTS[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_bounds_of_sql_functions_reach_the_scan(spark):
    from catalog import segments
    plan = segments.sql_datapoints(spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = plan[plan.index("PushedFilters"):].split("\n")[0]
    assert "GreaterThanOrEqual(end_time" in pushed and "LessThanOrEqual(start_time" in pushed
    assert "period" in plan[plan.index("PartitionFilters"):].split("\n")[0]


def test_readings_beside_the_grid_are_refused(spark):
    import pytest

    from tidegauge.operators import regularize
    series = spark.createDataFrame([(1, 1, 1000), (2, 1, 1000)], "tid int, gid int, si_ms long")
    rows = [(1, 0, 1.0), (1, 1000, 2.0), (2, 1500, 3.0), (7, 0, 4.0), (2, None, 5.0)]
    points = spark.createDataFrame(rows, "tid int, ms long, value float").selectExpr("tid", "timestamp_millis(ms) ts", "value")
    kept, refused = regularize.split_grid(points, series)
    assert sorted((r.tid, r.reason) for r in refused.collect()) == [(2, "off grid"), (2, "off grid"), (7, "unknown")]
    assert {(r.tid, r.value) for r in regularize.align_grid(kept, series).collect()} == {(1, 1.0), (1, 2.0), (2, None)}
    for bad in ("tid = 7 OR tid = 1", "ms IS NULL"):
        with pytest.raises(Exception, match="not among the listed|not on the grid"):
            regularize.align_grid(points if bad == "ms IS NULL" else points.where("tid <> 2"), series).collect()


def test_either_of_two_conditions_reaches_the_scan(spark, groups):
    wanted = view.touches(view.gids_of(fx.stored_series(spark, SF), [2])) | view.touches(ts_to="2024-01-01 00:01:00")
    text = plan(view.points(groups.where(wanted)))
    assert "Or(EqualTo(gid,2),LessThanOrEqual(start_time,2024-01-01 00:01:00.0))" in text or "Or(In(gid, [2]),LessThanOrEqual(start_time" in text


def test_series_are_looked_up_by_id(spark):
    found = fx.stored_series(spark, SF)
    assert view.gids_of(found, [3, 5, 3, 99_999_999]) == [3, 5] and view.gids_of(found, []) == []
    assert sorted(map(str, found.collect())) == sorted(map(str, fx.series_seq(spark, SF).collect()))
    text = plan(found.where("tid in (3, 5)").select("gid"))
    assert "In(tid, [3,5])" in text and "Exchange" not in text


def test_points_of_small_segments_are_not_broadcast(spark):
    from tidegauge.operators import quality
    from tidegauge.operators.compress import compress
    real = spark.range(6000).selectExpr("cast(1 AS int) tid", "timestamp_millis(id * 1000) ts", "cast(3 AS float) value")
    approx = view.points(compress(real, 5.0, si_ms=1000))
    table = quality.error_table(quality.align(real, approx))
    assert "BroadcastHashJoin" not in plan(table) and "SortMergeJoin" in plan(table)
    assert [tuple(r) for r in table.collect()] == [(1, 0.0, 0.0, 0, 6000, 0.0)]


def test_points_of_a_single_series_travel_without_what_the_key_tells(spark):
    from tidegauge.operators.compress import compress
    text = plan(compress(fx.points(spark, SF, "pts_seq"), 0.0, si_ms=2000))
    assert re.search(r"fit_chunk\(gid#\d+, chunk#\d+L, ms#\d+L, value#\d+\)", text)


def test_segments_are_dealt_out_before_they_become_points(groups):
    text = plan(view.points(groups))
    assert text.index("ArrowEvalPython") < text.index("REPARTITION_BY_COL")
