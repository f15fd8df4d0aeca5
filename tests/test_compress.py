from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge import schema
from tidegauge.functions.models import Constant, Fit, Linear, Xor, correlated_members
from tidegauge.operators import aggregate, quality, view
from tidegauge.operators.compress import compress, compress_groups, lasting_subgroups, rejoined_subgroups

START = datetime(2024, 2, 28, 23, 50)


@pytest.fixture(scope="module")
def points(spark):
    """Three members of one group with different gaps, and a fourth, longer series."""
    rng = np.random.default_rng(2)
    rows = []
    for tid, n in ((1, 400), (2, 400), (3, 400), (4, 3000)):
        v = np.round(100 + np.cumsum(rng.normal(0, 0.3, n)) + (30 if tid == 3 else 0), 2)
        kept = rng.random(n) > (0.02 if tid != 4 else 0.001)
        rows += [(tid, int(i), float(v[i])) for i in range(n) if kept[i]]
    start = F.unix_millis(F.lit(START).cast("timestamp"))
    return spark.createDataFrame(rows, "tid int, i long, v double").select(
        "tid", F.timestamp_millis(start + F.col("i") * 1000).alias("ts"), F.col("v").cast("float").alias("value")).repartition(5).cache()


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 9)], "tid int, gid int").withColumn("si_ms", F.lit(1000).cast("long"))


def violations(points, groups, eps):
    return quality.violations(quality.align(points, view.points(groups)), eps).count()


@pytest.mark.parametrize("eps", [0.0, 1.0, 10.0])
@pytest.mark.parametrize("chunk_ticks", [64, 4096, 100_000])
def test_series(points, eps, chunk_ticks):
    g = compress(points, eps, si_ms=1000, chunk_ticks=chunk_ticks).cache()
    assert violations(points, g, eps) == 0
    assert g.groupBy().agg(F.sum("n_ticks")).first()[0] == points.count()


@pytest.mark.parametrize("eps", [0.0, 10.0])
@pytest.mark.parametrize("split_fraction", [0.0, 1.0])
def test_groups(points, series, eps, split_fraction):
    g = compress_groups(points, series, eps=eps, chunk_ticks=300, split_fraction=split_fraction).cache()
    assert violations(points, g, eps) == 0
    widths = {r.w for r in g.where("gid = 7").select(F.size("tids").alias("w")).distinct().collect()}
    assert widths == ({1, 2} if split_fraction and eps else widths) and (max(widths) == 3 or split_fraction)
    gaps = g.where("gid = 7").select((F.size("tids") + F.col("n_gaps")).alias("s")).distinct().collect()
    assert [r.s for r in gaps] == [3]


def test_group_aggregates_and_ranges(points, series):
    g = compress_groups(points, series, eps=0.0).cache()
    lo, hi = "2024-02-28 23:51:00.5", "2024-02-29 00:03:20.7"
    clipped = view.clip(view.members(g), lo, hi)
    got = aggregate.agg_segments(clipped, ["tid"], clipped=True).orderBy("tid").collect()
    v = F.col("value").cast("double")
    want = points.where(F.col("ts").between(F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp"))).groupBy("tid").agg(
        F.count("*"), F.min(v), F.max(v), F.sum(v), F.avg(v)).orderBy("tid").collect()
    assert [tuple(r) for r in got] == [pytest.approx(tuple(r)) for r in want]
    for unit in ("minute", "day_of_month", "am_pm", "second"):
        got = aggregate.calendar_agg(view.members(g), "sum", unit, ["tid"]).orderBy("tid", "field").collect()
        field = {"minute": F.minute("ts"), "day_of_month": F.dayofmonth("ts"), "am_pm": F.floor(F.hour("ts") / 12), "second": F.second("ts")}[unit]
        want = points.groupBy("tid", field.cast("int").alias("field")).agg(F.sum(v)).orderBy("tid", "field").collect()
        assert [tuple(r) for r in got] == [pytest.approx(tuple(r)) for r in want]


def test_point_range_of_groups(points, series):
    g = compress_groups(points, series, eps=0.0)
    lo, hi = "2024-02-28 23:51:00.5", "2024-02-29 00:03:20.7"
    got = view.points(g, tids=[2, 4], ts_from=lo, ts_to=hi)
    want = points.where(F.col("tid").isin(2, 4) & F.col("ts").between(F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("tid", "ts", "value").collect()))


def test_lookup(points, series):
    g = view.members(compress_groups(points, series, eps=0.0))
    wanted = points.select("tid", "ts").unionByName(points.select("tid", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")))
    got = view.point_lookup(g, wanted, 60_000)
    assert got.count() == 2 * points.count()
    assert sorted(map(tuple, got.where("value IS NOT NULL").collect())) == sorted(map(tuple, points.select("tid", "ts", "value").collect()))


class Doubled:
    """A user-defined lossless model type: at most 10 ticks as float64."""

    mtid = 77

    def fit(self, values, si_ms, eps):
        n = min(10, len(values))
        return Fit(n, 1.0, payload=values[:n].astype("<f8").tobytes())

    @staticmethod
    def decode(payload, count):
        import numpy
        return numpy.frombuffer(payload, "<f8", count)


def test_user_model_type(spark, points):
    from pyspark import cloudpickle
    import sys
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    models = (Constant(), Doubled())
    g = compress(points, 0.0, si_ms=1000, models=models).cache()
    assert {r.mtid for r in g.select("mtid").distinct().collect()} >= {77}
    got = view.points(g, models=models)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, points.select("tid", "ts", "value").collect()))


@pytest.mark.parametrize("options", [dict(eps=-1), dict(eps=101), dict(length_bound=0), dict(chunk_ticks=0), dict(split_fraction=-0.1)])
def test_options_out_of_range(points, options):
    with pytest.raises(ValueError):
        compress(points, si_ms=1000, **options)


def test_strict_verification_raises(points):
    aligned = quality.align(points, points.withColumn("value", F.col("value") * 1.5))
    with pytest.raises(ValueError):
        quality.violations(aligned, 10.0, strict=True)


def test_a_hot_series_is_many_groups(points):
    """No Python task group grows with a series: chunks are bounded in ticks."""
    g = compress(points.where("tid = 4"), 100.0, si_ms=1000, models=(Constant(), Linear(), Xor(50)), chunk_ticks=100)
    assert g.select("chunk").distinct().count() >= 30 and g.agg(F.max("n_ticks")).first()[0] <= 100


def test_sizes(points, series):
    g = compress_groups(points, series, eps=0.0).cache()
    sizes = quality.model_sizes(g).first()
    assert sizes.points == points.count() and sizes.metadata_size == 24 * g.count()
    assert sizes.expected_size == sizes.models_size + sizes.metadata_size + sizes.gaps_size
    payload = g.where(F.col("mtid").isin(schema.XOR, schema.RAW)).agg(F.sum(F.length("payload"))).first()[0]
    assert payload == g.where(F.col("mtid").isin(schema.XOR, schema.RAW)).agg(F.sum("model_bytes")).first()[0]


def test_wide_groups_are_stored_in_parts(spark, monkeypatch):
    from tidegauge.operators import compress as module
    monkeypatch.setattr(module, "GROUP_WIDTH", 8)
    d = spark.range(20 * 100).select((F.col("id") % 20 + 1).cast("int").alias("tid"),
                                     F.timestamp_millis(F.floor(F.col("id") / 20) * 1000).alias("ts"),
                                     F.floor(F.col("id") / 20).cast("float").alias("value"))
    one = spark.range(1, 21).select(F.col("id").cast("int").alias("tid"), F.lit(1).alias("gid"), F.lit(1000).alias("si_ms"))
    g = compress_groups(d, one, eps=1.0).cache()
    assert g.select("part", F.size("tids").alias("w")).distinct().count() == 3 and violations(d, g, 1.0) == 0


def test_derived_members_share_the_segments_of_their_source(spark, points):
    m = view.members(compress(points, 0.0, si_ms=1000))
    derived = spark.createDataFrame([(1, 501, "value * 2"), (1, 502, "value + 1")], "source_tid int, tid int, expression string")
    d = view.derived_members(m, derived)
    assert {r.tid for r in d.select("tid").distinct().collect()} == {501, 502}
    assert d.agg(F.sum("n_ticks")).first()[0] == 2 * points.where("tid = 1").count()


@pytest.fixture(scope="module")
def crowd(spark):
    """80 members around six levels, some of which leave theirs for a while; members 1 and 40 have no points."""
    rng = np.random.default_rng(8)
    level = rng.integers(0, 6, 81)
    v = 100.0 * 1.5 ** level[None, :] * (1 + rng.uniform(-0.02, 0.02, (300, 81)))
    v[100:140, 5::9] *= 1.8
    v[rng.random(v.shape) < 0.05] = np.nan
    v[:, [0, 1, 40]] = np.nan
    rows = [(tid, i, float(v[i, tid])) for i in range(300) for tid in range(81) if not np.isnan(v[i, tid])]
    points = spark.createDataFrame(rows, "tid int, i long, v double").select(
        "tid", F.timestamp_millis(F.col("i") * 1000).alias("ts"), F.col("v").cast("float").alias("value")).repartition(4).cache()
    series = spark.createDataFrame([(t, 3, 1000) for t in range(1, 81)], "tid int, gid int, si_ms long")
    return v.astype(np.float32), points, series


def groups_of(values, tids, eps):
    return {int(tids[i]): int(tids[g[0]]) for g in correlated_members(values[:, tids], eps) for i in g}


@pytest.mark.parametrize("chunk_ticks", [1, 100_000])
def test_lasting_subgroups_do_not_depend_on_chunks(crowd, chunk_ticks):
    v, points, series = crowd
    present = np.flatnonzero(~np.isnan(v).all(axis=0))
    got = {r.tid: r.leader for r in lasting_subgroups(points, series, 5.0, chunk_ticks).collect()}
    want = groups_of(v, present, 5.0)
    assert got == want and 6 < len(set(want.values())) < len(present)


def test_members_leave_their_leader_and_come_back(crowd):
    v, points, series = crowd
    want = []
    chunks = [groups_of(part, np.flatnonzero(~np.isnan(part).all(axis=0)), 5.0) for part in (v[at:at + 64] for at in range(0, 300, 64))]
    for tid in range(81):
        for c, leaders in enumerate(chunks):
            if tid in leaders and want and want[-1][:2] == (tid, leaders[tid]) and want[-1][3] == c - 1:
                want[-1] = (*want[-1][:3], c, want[-1][4] + 1)
            elif tid in leaders:
                want.append((tid, leaders[tid], c, c, 1))
    got = [tuple(r)[1:] for r in rejoined_subgroups(points, series, 5.0, chunk_ticks=1).collect()]
    assert sorted(got) == sorted(want) and len(want) > len({w[:2] for w in want}) > 80


def test_subgroups_of_nothing(spark, series):
    empty = spark.createDataFrame([], "tid int, ts timestamp, value float")
    assert lasting_subgroups(empty, series, 1.0).count() == rejoined_subgroups(empty, series, 1.0).count() == 0


@pytest.mark.parametrize("eps", [0.0, 1.0])
def test_aggregates_of_groups_decode_once_for_all_members(points, series, eps):
    g = compress_groups(points, series, eps=eps).cache()
    shown = view.points(g).withColumn("v", F.col("value").cast("double"))
    lo, hi = "2024-02-28 23:51:00.5", "2024-02-29 00:03:20.7"
    within = F.col("ts").between(F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp"))
    aggs = (F.count("*"), F.min("v"), F.max("v"), F.sum("v"), F.avg("v"))
    fields = {"minute": F.minute("ts"), "day_of_month": F.dayofmonth("ts"), "second": F.second("ts"), "year": F.year("ts"), "month": F.month("ts") - 1}
    clipped = view.clip(view.with_offsets(g), lo, hi)
    for groups, real in ((g, shown), (clipped, shown.where(within))):
        got = aggregate.agg_groups(groups).orderBy("tid").collect()
        want = real.groupBy("tid").agg(*aggs).orderBy("tid").collect()
        assert [tuple(r) for r in got] == [pytest.approx(tuple(r), rel=1e-6) for r in want] and len(got) == 4
        for unit, field in fields.items():
            got = aggregate.agg_groups(groups, unit=unit).orderBy("tid", "field").collect()
            want = real.groupBy("tid", field.cast("int").alias("field")).agg(*aggs).orderBy("tid", "field").collect()
            assert [tuple(r) for r in got] == [pytest.approx(tuple(r), rel=1e-6) for r in want]
    by_member = aggregate.calendar_agg(view.clip(view.members(g), lo, hi), "sum", "minute", ["tid"]).orderBy("tid", "field").collect()
    by_group = aggregate.agg_groups(clipped, aggs=["sum"], unit="minute").orderBy("tid", "field").collect()
    assert [tuple(r) for r in by_member] == [pytest.approx(tuple(r)) for r in by_group]
    counts = aggregate.agg_groups(g, ["gid"], ["count"], "minute")
    assert counts.agg(F.sum("count")).first()[0] == shown.count()


def test_pieces_of_no_groups(points, series):
    g = compress_groups(points.where("false"), series, eps=0.0)
    assert aggregate.agg_groups(g, unit="month").count() == 0
    assert "payload" not in aggregate.group_pieces(g, "month").columns


def test_wide_groups_are_decoded_in_portions(spark, monkeypatch):
    rows = spark.range(0, 200 * 130).select((F.col("id") % 200).cast("int").alias("tid"), F.floor(F.col("id") / 200).alias("i"))
    points = rows.select("tid", F.timestamp_millis(F.col("i") * 1000).alias("ts"), (F.xxhash64("tid", "i") % 1000).cast("float").alias("value"))
    wide = spark.range(200).select(F.col("id").cast("int").alias("tid"), F.lit(1).alias("gid"), F.lit(1000).cast("long").alias("si_ms"))
    monkeypatch.setattr(aggregate, "_DECODED", 5_000)
    v = F.col("value").cast("double")
    got = aggregate.agg_groups(compress_groups(points, wide, eps=0.0), unit="minute", aggs=("sum", "min")).collect()
    want = points.groupBy("tid", F.minute("ts").alias("field")).agg(F.sum(v), F.min(v)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 600
