"""Two-level windows against pandas, with one key holding most of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.plans import ordered
from tidegauge.plans.quantile import exact_median, median_of_counts


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    parts = []
    for key, n in ((1, 3000), (2, 40), (3, 1), (4, 500)):
        at = np.sort(rng.choice(n * 2, n, replace=False))
        parts.append(pd.DataFrame({"k": key, "t": at.astype("int64") * 10, "v": np.where(rng.random(n) < 0.3, rng.normal(size=n), np.nan)}))
    d = pd.concat(parts)
    d["v"] = d.v.astype(object).where(d.v.notna(), None)
    return d


@pytest.fixture(scope="module")
def table(spark, frame):
    return spark.createDataFrame(frame.to_dict("records"), "k int, t long, v double").repartition(7)


BUCKETS = [50, 1000, 10**9]


@pytest.mark.parametrize("width", BUCKETS)
def test_positions(table, frame, width):
    got = ordered.positions(table, ["k"], ["t"], F.floor(F.col("t") / width)).toPandas().sort_values(["k", "t"])
    assert got.rn.tolist() == (frame.groupby("k").cumcount() + 1).tolist()


@pytest.mark.parametrize("width", BUCKETS)
@pytest.mark.parametrize("step", [-1, 1])
def test_neighbours(table, frame, width, step):
    got = ordered.with_neighbour(table, ["k"], "t", ["t"], F.floor(F.col("t") / width), step)
    got = got.select("k", "t", "prev.t").toPandas().set_axis(["k", "t", "p"], axis=1).sort_values(["k", "t"])
    want = frame.groupby("k").t.shift(-step)
    assert got.p.fillna(-1).tolist() == want.fillna(-1).tolist()


@pytest.mark.parametrize("width", BUCKETS)
def test_fill_forward(table, frame, width):
    got = ordered.fill_forward(table, ["k"], "t", "v", F.floor(F.col("t") / width)).toPandas().sort_values(["k", "t"])
    want = frame.assign(v=frame.v.astype(float)).groupby("k").v.ffill()
    assert np.allclose(got.v.astype(float).fillna(-99), want.fillna(-99))


@pytest.mark.parametrize("width", BUCKETS)
@pytest.mark.parametrize("step", [10, 20])
def test_runs(table, frame, width, step):
    d = table.withColumn("s", F.lit(step).cast("long"))
    got = ordered.consecutive_runs(d, ["k"], "t", "s", F.floor(F.col("t") / width)).toPandas().sort_values(["k", "first"])
    new = frame.groupby("k").t.diff() != step
    want = frame.assign(run=new.groupby(frame.k).cumsum()).groupby(["k", "run"]).t.agg(["min", "max", "count"])
    assert got[["first", "last", "n"]].values.tolist() == want.values.tolist()


def test_exact_median(spark):
    rng = np.random.default_rng(9)
    groups = {1: rng.normal(size=2000), 2: rng.integers(-2, 3, 999), 3: [5.0], 4: [-1.0, 4.0], 5: rng.lognormal(size=500) * 1e6}
    rows = [(k, float(np.float32(x))) for k, xs in groups.items() for x in xs]
    got = dict(exact_median(spark.createDataFrame(rows, "k int, v float"), ["k"], "v").collect())
    for k, xs in groups.items():
        assert got[k] == pytest.approx(np.median(np.array(xs, dtype=np.float32).astype(float)), abs=1e-12)


def test_median_of_counts(spark):
    d = spark.createDataFrame([(1, 10, 3), (1, 20, 3), (2, 7, 1)], "k int, v int, c long")
    assert dict(median_of_counts(d, ["k"], "v", "c").collect()) == {1: 15.0, 2: 7.0}


@pytest.mark.parametrize("how", ["mean", "last"])
def test_downsample_deals_out_blocks_that_no_bin_crosses(spark, monkeypatch, how):
    from tidegauge.operators import regularize
    monkeypatch.setattr(regularize, "BUCKET_TICKS", 64)
    rows = [(tid, 5_000 + tick * 1000, float(tick * tick % 97)) for tid, n in ((1, 1000), (2, 1), (3, 61)) for tick in range(n)]
    points = spark.createDataFrame(rows, "tid int, ms long, value float").selectExpr("tid", "timestamp_millis(ms) ts", "value")
    d = regularize.downsample(points, 1000, [2, 5, 7], how)
    want = {}
    for tid, ms, value in rows:
        for k in (2, 5, 7):
            want.setdefault((k, tid, 5_000 + -(-(ms - 5_000) // (k * 1000)) * k * 1000), []).append(value)
    got = {(r.factor, r.tid, r.ms): r.value for r in d.selectExpr("factor", "tid", "unix_millis(ts) ms", "value").collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(sum(v) / len(v) if how == "mean" else v[-1]) for k, v in want.items())
    # one exchange of points to a fixed number of tasks, none of bins
    text = d._jdf.queryExecution().executedPlan().toString()
    assert text.count("REPARTITION_BY_NUM") == 1 and "hashpartitioning(factor" not in text


def test_fill_forward_of_several_columns(spark):
    rows = [(1, 0, 1.0, None), (1, 1, None, None), (1, 7, None, 5.0), (1, 30, None, None), (2, 3, None, 4.0), (2, 40, 2.0, None)]
    d = spark.createDataFrame(rows, "k int, t long, a double, b double")
    got = ordered.fill_forward(d, ["k"], "t", ["a", "b"], F.floor(F.col("t") / 5)).select("k", "t", "a", "b").collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == [
        (1, 0, 1.0, None), (1, 1, 1.0, None), (1, 7, 1.0, 5.0), (1, 30, 1.0, 5.0), (2, 3, None, 4.0), (2, 40, 2.0, 4.0)]


@pytest.mark.parametrize("bucket_ms", [3_000, 40_000, 10**9])
@pytest.mark.parametrize("factors", [None, (3, 5)])
def test_ffill_join_is_a_left_join_filled_forward(spark, bucket_ms, factors):
    from tidegauge.operators import regularize
    ticks = {1: [t for t in range(120) if t % 11], 2: [4], 3: list(range(0, 60, 2))}
    points = [(tid, t, float(t * tid)) for tid, ts in ticks.items() for t in ts] + [(1, None, 7.0), (None, 5, 7.0), (3, 10, None)]
    # samples of times without a point, of no value, there twice, of other series, factors and times
    samples = [(f, tid, t, None if t % 4 == 3 else float(f * t)) for f in (3, 5) for tid in (1, 2, 4) for t in range(0, 130, f)]
    samples += [(3, 1, 12, 36.0), (3, 3, 10, -2.0), (5, 3, 58, -3.0), (5, 3, 58, -4.0), (9, 1, 1, -5.0), (None, 1, 1, -6.0), (3, 1, None, -7.0)]
    spread = [] if factors is None else ["factor"]
    if factors is None:
        samples = [s for s in samples if s[0] == 3]
    want = []
    for f in factors or (3,):
        for tid, t, value in [p for p in points if None not in p[:2]]:
            at = sorted((s[2], s[3]) for s in samples if s[:2] == (f, tid) and s[2] is not None and s[2] <= t and s[2] in ticks[tid] and s[3] is not None)
            here = [a for time, a in at if time == t] or [at[-1][1] if at else None]
            want += [(*([f] if spread else []), tid, t, value, a) for a in here]
    second = "timestamp_millis(t * 1000L) ts"
    p = spark.createDataFrame(points, "tid int, t long, value float").selectExpr("tid", second, "value").repartition(3)
    s = spark.createDataFrame(samples, "factor int, tid int, t long, value float").selectExpr(*spread, "tid", second, "value").repartition(3)
    d = regularize.ffill_join(p, s, [*spread, "tid"], bucket_ms, factors)
    assert d.columns == [*spread, "tid", "ts", "value", "approx"]
    got = [(*[r[c] for c in spread], r.tid, r.t, r.value, r.approx) for r in d.withColumn("t", (F.unix_millis("ts") / 1000).cast("long")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ffill_join_exchanges_no_row_per_factor(spark):
    from catalog import points
    d = points.ffill_join(spark, "/root/testdata/sf0.001")
    assert d.count() > 0 and "hashpartitioning(factor" not in d._jdf.queryExecution().executedPlan().toString()
    d.collect()
    final = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Union") == 1 and "ReusedExchange" in final  # both passes read one exchange of points and samples
