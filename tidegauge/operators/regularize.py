"""Points -> points: grids, gaps, resampling, scaling, reduced precision."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.plans.lookup import required
from tidegauge.plans.ordered import BUCKET, consecutive_runs, fill_forward, positions, time_bucket, with_neighbour

BUCKET_MS = 3_600_000  # of series with an unknown sampling interval
BUCKET_TICKS = 65_536  # of regular series


def regularize(events: DataFrame, key: str, si: str = "hour", how: str = "max") -> DataFrame:
    """One FLOAT value per (key, calendar unit) from irregular (key, ts, value)."""
    aggregates = {"max": F.max("value"), "mean": F.avg("value"), "sum": F.sum("value"),
                  "count": F.count("value"), "last": F.max_by("value", "ts")}
    tick = F.date_trunc(si, "ts")
    return (events.withColumn("tick", tick).groupBy(key, "tick")
            .agg(aggregates[how].cast("float").alias("value"))
            .select(key, F.col("tick").alias("ts"), "value"))


def split_readings(points: DataFrame, series: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Points that `compress` takes, and those it can't take with a `reason`.

    Refused are readings of unlisted series (`unknown`), without time or number (`no number`: null or NaN), and all but the
    first of several in one millisecond (`repeated`; the smallest value comes first). Both tables together are the input.
    """
    number = F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")) & F.col("ts").isNotNull() & F.col("tid").isNotNull()
    d = points.withColumn("reason", F.when(~number, "no number"))
    if series is not None:
        listed = series.select("tid", F.lit(True).alias("__listed")).distinct()
        d = d.join(listed, "tid", "left").withColumn("reason", F.when(F.col("__listed").isNull(), "unknown").otherwise(F.col("reason"))).drop("__listed")
    # refused readings may share a series or a missing time in any number: only the others are numbered
    order = Window.partitionBy("tid", F.unix_millis("ts")).orderBy("value", "ts")
    sound = d.where("reason IS NULL").withColumn("__n", F.row_number().over(order))
    d = sound.unionByName(d.where("reason IS NOT NULL").withColumn("__n", F.lit(1)))
    d = d.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("__n") > 1), "repeated").otherwise(F.col("reason"))).drop("__n")
    return d.where("reason IS NULL").drop("reason"), d.where("reason IS NOT NULL")


def infer_si(points: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(tid, si_ms): the most frequent difference of consecutive timestamps, the smallest on ties."""
    d = with_neighbour(points.select("tid", "ts"), ["tid"], "ts", ["ts"], time_bucket("ts", bucket_ms))
    delta = F.unix_millis("ts") - F.unix_millis("prev.ts")
    return (d.where("prev IS NOT NULL").groupBy("tid", delta.alias("si_ms")).agg(F.count(F.lit(1)).alias("n"))
            .groupBy("tid").agg(F.max_by("si_ms", F.struct(F.col("n"), -F.col("si_ms"))).alias("si_ms")))


def _grids(points: DataFrame, meta: DataFrame) -> DataFrame:
    """(gid, si_ms, lo, hi): first and last time of the listed series of every group."""
    return (points.groupBy("tid").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).join(meta, "tid")
            .groupBy("gid", "si_ms").agg(F.unix_millis(F.min("lo")).alias("lo"), F.unix_millis(F.max("hi")).alias("hi")))


def split_grid(points: DataFrame, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points that `align_grid` takes, and those it can't take with a `reason`: readings of unlisted series (`unknown`), and those
    beside the grid that begins with the first reading of the group (`off grid`) or without time. Both tables together are the input.
    """
    meta = series.select("tid", "gid", F.col("si_ms").cast("long").alias("si_ms"))
    grids = meta.join(_grids(points, meta), ["gid", "si_ms"], "left").select("tid", F.col("lo").alias("__lo"), F.col("si_ms").alias("__si"))
    on = (F.unix_millis("ts") - F.col("__lo")) % F.col("__si") == 0
    d = points.join(grids, "tid", "left").withColumn("reason", F.when(F.col("__si").isNull(), "unknown").when(~F.coalesce(on, F.lit(False)), "off grid")).drop("__lo", "__si")
    return d.where("reason IS NULL").drop("reason"), d.where("reason IS NOT NULL")


def align_grid(points: DataFrame, series: DataFrame, grid_ticks: int = 4096) -> DataFrame:
    """(gid, tid, ts, value) on the common grid of each group, NULL where a member has a gap.

    The grid is generated per block of `grid_ticks`, so no task holds the whole history of a group. A reading of an unlisted
    series or beside the grid raises; split_grid sorts them out.
    """
    meta = series.select("tid", "gid", F.col("si_ms").cast("long").alias("si_ms"))
    spans = _grids(points, meta)
    known = required(points, meta.join(spans.drop("hi"), ["gid", "si_ms"], "left"), ["tid"], "series")
    on = F.coalesce((F.unix_millis("ts") - F.col("lo")) % F.col("si_ms") == 0, F.lit(False))
    refuse = F.raise_error(F.concat(F.lit("not on the grid of its group: "), F.coalesce(F.col("ts").cast("string"), F.lit("null")))).cast("boolean")
    points = known.where(F.when(on, F.lit(True)).otherwise(refuse)).select("tid", "ts", "value")
    last = F.floor((F.col("hi") - F.col("lo")) / F.col("si_ms"))
    blocks = (meta.select("gid", "tid").join(spans.withColumn("last", last), "gid")
              .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / grid_ticks))).alias("block")))
    first = F.col("block") * grid_ticks
    grid = (blocks.repartition("tid", "block")
            .select("gid", "tid", "lo", "si_ms", F.explode(F.sequence(first, F.least(F.col("last"), first + grid_ticks - 1))).alias("i"))
            .select("gid", "tid", F.timestamp_millis(F.col("lo") + F.col("i") * F.col("si_ms")).alias("ts")))
    return grid.join(points, ["tid", "ts"], "left").select("gid", "tid", "ts", "value")


def _ms_points(points: DataFrame, si_ms: int | None, series: DataFrame | None) -> DataFrame:
    d = points.select("tid", F.unix_millis("ts").alias("ms"))
    if series is None:
        return d.withColumn("si_ms", F.lit(si_ms).cast("long"))
    return required(d, series.select("tid", F.col("si_ms").cast("long").alias("si_ms")), ["tid"], "series")


def _tick_bucket() -> Column:
    return F.floor(F.col("ms") / (F.col("si_ms") * BUCKET_TICKS))


def gap_intervals(points: DataFrame, si_ms: int | None = None, series: DataFrame | None = None) -> DataFrame:
    """(tid, gap_start, gap_end, missing): first and last absent tick of every gap."""
    d = with_neighbour(_ms_points(points, si_ms, series), ["tid"], "ms", ["ms"], _tick_bucket())
    before, si = F.col("prev.ms"), F.col("si_ms")
    return d.where(F.col("ms") - before > si).select(
        "tid", F.timestamp_millis(before + si).alias("gap_start"), F.timestamp_millis(F.col("ms") - si).alias("gap_end"),
        (F.floor((F.col("ms") - before) / si) - 1).alias("missing"))


def gapfree_runs(points: DataFrame, si_ms: int | None = None, series: DataFrame | None = None) -> DataFrame:
    """(tid, run_start, run_end, n): maximal runs without a gap."""
    runs = consecutive_runs(_ms_points(points, si_ms, series), ["tid"], "ms", "si_ms", _tick_bucket())
    return runs.select("tid", F.timestamp_millis("first").alias("run_start"),
                       F.timestamp_millis("last").alias("run_end"), "n")


def downsample(points: DataFrame, si_ms: int, factors: Sequence[int], how: str = "mean") -> DataFrame:
    """(factor, tid, ts, value) in bins of factor * si_ms, closed and labelled on the right.

    Bins are anchored at the first timestamp of the series; several factors share one scan. A series is dealt out in blocks
    of ticks that no bin of any factor crosses, to all shuffle partitions: a task has every bin of its blocks whole and
    holds no more than its share of them, whatever the size of the files or of a series.
    """
    starts = points.groupBy("tid").agg(F.unix_millis(F.min("ts")).alias("start"))
    unit = math.lcm(*[int(k) for k in factors])
    block_ms = float(unit * max(1, BUCKET_TICKS // unit) * si_ms)
    offset = F.unix_millis("ts") - F.col("start")
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = (points.join(starts, "tid").select("tid", "ts", "value", "start", F.ceil(offset / block_ms).alias("block"))
              .repartition(tasks, "tid", "block"))
    d = blocks.select("*", F.explode(F.array(*[F.lit(int(k)) for k in factors])).alias("factor"))
    width = F.col("factor").cast("long") * si_ms
    label = F.col("start") + width * F.ceil(offset / width)
    picked = {"mean": F.avg(F.col("value").cast("double")), "last": F.max_by("value", "ts")}[how]
    return (d.groupBy("factor", "tid", "block", F.timestamp_millis(label).alias("ts"))
            .agg(picked.cast("float").alias("value")).drop("block"))


def downsample_rows(points: DataFrame, rows: int, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(tid, ts, value): mean and last timestamp of every `rows` consecutive points."""
    if rows < 1:
        raise ValueError("rows must be at least 1")
    d = positions(points, ["tid"], ["ts"], time_bucket("ts", bucket_ms))
    return (d.groupBy("tid", F.floor((F.col("rn") - 1) / rows).alias("window"))
            .agg(F.max("ts").alias("ts"), F.avg(F.col("value").cast("double")).cast("float").alias("value"))
            .select("tid", "ts", "value"))


def ffill_join(points: DataFrame, sampled: DataFrame, keys: Sequence[str] = ("tid",),
               bucket_ms: int = BUCKET_MS, factors: Sequence[int] | None = None) -> DataFrame:
    """Left join on (keys, ts) with gaps in the sampled value filled forward: (keys, ts, value, approx).

    With `factors`, points have no column `factor` yet and meet the samples of each. Points and samples are dealt out once and
    together, by series and time bucket. There, samples meet the points of their time, every factor is filled in a column of
    its own, and only the result has a row for each. Points without a key or a time are left out.
    """
    by = [k for k in keys if factors is None or k != "factor"]
    kept = [c for c in points.columns if c not in (*by, "ts")]
    label = [] if factors is None else ["factor"]
    # a point's other columns go as one, which tells it from a sample: both passes of fill_forward read it and share one exchange
    real = points.select(*by, "ts", F.struct(*kept).alias("__real"))
    sample = sampled.select(*by, "ts", F.struct(*label, F.col("value").alias("approx")).alias("__sample"))
    d = real.unionByName(sample, allowMissingColumns=True).withColumn(BUCKET, time_bucket("ts", bucket_ms))
    for c in (*by, BUCKET):
        d = d.where(F.col(c).isNotNull())
    d = d.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, BUCKET)

    columns = {"__approx": None} if factors is None else {f"__approx_{k}": int(k) for k in factors}

    def own(k):
        return F.col("__sample")["approx"] if k is None else F.when(F.col("__sample")["factor"] == k, F.col("__sample")["approx"])

    here = Window.partitionBy(*by, BUCKET, "ts")
    d = (d.withColumns({c: F.last(own(k), ignorenulls=True).over(here) for c, k in columns.items()})
         .withColumn("__here", F.collect_list("__sample").over(here)).where("__real IS NOT NULL").drop("__sample"))
    d = fill_forward(d, by, "ts", list(columns), F.col(BUCKET))

    def row(c, k, approx=None):
        filled = F.col(c) if approx is None else F.coalesce(approx, F.col(c))
        return F.struct(*[F.lit(k).alias(f) for f in label], filled.alias("approx"))

    def rows(c, k):
        samples = F.col("__here") if k is None else F.filter("__here", lambda s: s["factor"] == k)
        return F.when(F.size(samples) > 0, F.transform(samples, lambda s: row(c, k, s["approx"]))).otherwise(F.array(row(c, k)))

    # a sample that is there several times makes as many rows
    n = F.size("__here")
    repeated = n > 1 if factors is None else (n > 1) & (n > F.size(F.array_distinct(F.col("__here")["factor"])))
    each = F.when(repeated, F.flatten(F.array(*[rows(c, k) for c, k in columns.items()]))).otherwise(
        F.array(*[row(c, k) for c, k in columns.items()]))
    # outer, though there is always a row: a plain explode computes the array twice, to see whether it is empty
    d = d.withColumn("__rows", each).select(*by, "ts", "__real", F.explode_outer("__rows").alias("__row"))
    return d.select(*by, "ts", "__real.*", "__row.*").select(*keys, "ts", *kept, "approx")


def scale(points: DataFrame, series: DataFrame) -> DataFrame:
    """Stored values: raw value times the scaling of its series, in float32."""
    return _scaled(points, series, lambda v, s: v * s)


def unscale(points: DataFrame, series: DataFrame) -> DataFrame:
    return _scaled(points, series, lambda v, s: v / s)


def _scaled(points, series, f):
    d = required(points, series.select("tid", F.col("scaling").cast("float").alias("scaling")), ["tid"], "series")
    return d.select("tid", "ts", f(F.col("value"), F.col("scaling")).cast("float").alias("value"))


def quantize(points: DataFrame, precisions: Sequence[int]) -> DataFrame:
    """(precision, tid, ts, q, value): values kept to some decimals as integers, and restored."""
    d = points.select("*", F.explode(F.array(*[F.lit(int(p)) for p in precisions])).alias("precision"))
    factor = F.pow(F.lit(10.0), F.col("precision"))
    q = F.round(F.col("value").cast("double") * factor).cast("long")
    return (d.withColumn("q", q)
            .select("precision", "tid", "ts", "q", (F.col("q") / factor).cast("float").alias("value")))


def delta_bytes(quantized: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(precision, tid, n, bytes): size when every second-order difference takes its own whole bytes."""
    keys = ["precision", "tid"]
    b = time_bucket("ts", bucket_ms)
    d = with_neighbour(quantized.select(*keys, "ts", "q"), keys, "ts", ["q"], b)
    d = d.withColumn("d1", F.coalesce(F.col("q") - F.col("prev.q"), F.col("q"))).drop("prev")
    d = with_neighbour(d.select(*keys, "ts", "d1"), keys, "ts", ["d1"], b)
    d2 = F.coalesce(F.col("d1") - F.col("prev.d1"), F.col("d1"))
    size = F.ceil(F.length(F.bin(F.shiftleft(F.abs(d2), 1))) / 8)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
