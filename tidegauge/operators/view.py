"""Views over segments: members, points, clipping, selections."""

from collections.abc import Iterable
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from tidegauge import schema
from tidegauge.functions import xor
from tidegauge.plans.lookup import required


def stored_values(ids: np.ndarray, blobs: list, counts: np.ndarray, models: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """All values of the payloads, one after the other, and where each begins; a missing payload has none."""
    custom = {m.mtid: m.decode for m in models if hasattr(m, "decode")}
    known = np.array([b is not None for b in blobs], dtype=bool)
    counts = np.where(known, counts, 0)
    starts = np.concatenate(([0], np.cumsum(counts)))
    flat = np.zeros(int(starts[-1]), dtype=np.float32)
    coded = np.flatnonzero(known & (ids == schema.XOR))
    if len(coded):
        decoded = xor.decode_many([blobs[i] for i in coded], counts[coded])
        slots = np.repeat(starts[coded] - np.concatenate(([0], np.cumsum(counts[coded])[:-1])), counts[coded])
        flat[slots + np.arange(len(decoded))] = decoded
    for i in np.flatnonzero(known & (ids != schema.XOR)):
        read = custom.get(ids[i], lambda b, n: np.frombuffer(b, dtype="<f4", count=n))
        flat[starts[i]:starts[i + 1]] = read(blobs[i], int(counts[i]))
    return flat, starts


def decoder(models: tuple = ()):
    """A function (mtid, payload, count) of the stored values of segments as array<float>, NULL where there is no payload."""
    @arrow_udf(T.ArrayType(T.FloatType()))
    def decode(mtid: pa.Array, payload: pa.Array, count: pa.Array) -> pa.Array:
        counts = count.to_numpy(zero_copy_only=False).astype(np.int64)
        flat, starts = stored_values(mtid.to_numpy(zero_copy_only=False), payload.to_pylist(), counts, models)
        known = payload.is_valid().to_numpy(zero_copy_only=False)
        offsets = pa.array(starts.astype(np.int32), mask=np.concatenate((~known, [False])))
        return pa.ListArray.from_arrays(offsets, pa.array(flat))

    return decode


def values_of(mtid: Column, payload: Column, count: Column, models: tuple = ()) -> Column:
    """Stored values of non-closed-form segments as array<float>, NULL for the others."""
    return decoder(models)(mtid, payload, count)


def with_offsets(groups: DataFrame) -> DataFrame:
    """Add the width of the group, and the ticks skipped by clipping (none yet) of those stored."""
    new = [] if "skip" in groups.columns else ["0 AS skip", "n_ticks AS n_stored"]
    return groups.selectExpr("*", *new, "size(tids) AS width")


def members(groups: DataFrame) -> DataFrame:
    """One row per series of each segment: its position in the group and the whole-segment statistics."""
    return (with_offsets(groups).selectExpr("*", "posexplode(tids) AS (pos, tid)")
            .selectExpr("* EXCEPT (tids, mins, maxs, sums)", "element_at(mins, pos + 1) AS vmin",
                        "element_at(maxs, pos + 1) AS vmax", "element_at(sums, pos + 1) AS vsum"))


def derived_members(segments: DataFrame, derived: DataFrame) -> DataFrame:
    """Segments of derived series: those of `source_tid` under the new `tid`, plus `expression`."""
    d = derived.select(F.col("source_tid").alias("tid"), F.col("tid").alias("__new"), "expression")
    return segments.join(d, "tid").withColumn("tid", F.col("__new")).drop("__new")


def _time(t) -> Column:
    return F.lit(t).cast("timestamp") if isinstance(t, (str, datetime)) else t


def in_periods(segments: DataFrame, ts_from=None, ts_to=None, longest_ms: int | None = None) -> DataFrame:
    """Drop the partitions of a store that no segment over [ts_from, ts_to] can lie in.

    A segment lies in the period of its start. Those after `ts_to` hold none; with `longest_ms`, the longest time that a
    segment covers (a chunk), neither do those that end before `ts_from` less that time. Periods are at most a year.
    """
    if "period" not in segments.columns:
        return segments
    if isinstance(ts_to, (str, datetime)):
        segments = segments.where(F.col("period") <= F.to_date(_time(ts_to)))
    if isinstance(ts_from, (str, datetime)) and longest_ms is not None:
        start = F.timestamp_millis(F.unix_millis(_time(ts_from)) - longest_ms)
        segments = segments.where(F.col("period") > F.add_months(F.to_date(start), -12))
    return segments


def clip(segments: DataFrame, ts_from=None, ts_to=None, longest_ms: int | None = None) -> DataFrame:
    """Restrict member segments to the ticks in [ts_from, ts_to]; empty ones are dropped.

    The bounds are timestamps, literals or columns. The overlap predicate on the plain columns
    reaches the Parquet scan, and literal bounds prune its partitions (see in_periods).
    """
    if ts_from is None and ts_to is None:
        return segments
    d, first, last = in_periods(segments, ts_from, ts_to, longest_ms), "0L", "n_ticks - 1L"
    if ts_from is not None:
        d = d.withColumn("__lo", _time(ts_from)).where("end_time >= __lo")
        first = "greatest(0L, ceil((unix_millis(__lo) - unix_millis(start_time)) / si_ms))"
    if ts_to is not None:
        d = d.withColumn("__hi", _time(ts_to)).where("start_time <= __hi")
        last = "least(n_ticks - 1L, floor((unix_millis(__hi) - unix_millis(start_time)) / si_ms))"
    kept = [c for c in segments.columns if c not in ("start_time", "end_time", "skip", "n_ticks")]
    return (d.selectExpr("*", f"{first} AS __f", f"{last} AS __l").where("__l >= __f")
            .selectExpr(*[f"`{c}`" for c in kept], "timestamp_millis(unix_millis(start_time) + __f * si_ms) AS start_time",
                        "timestamp_millis(unix_millis(start_time) + __l * si_ms) AS end_time",
                        "cast(skip + __f AS int) AS skip", "cast(__l - __f + 1 AS int) AS n_ticks"))


def points(groups: DataFrame, series: DataFrame | None = None, tids: Iterable[int] | str | None = None,
           ts_from=None, ts_to=None, models: tuple = (), keep: Iterable[str] = (),
           gids: Iterable[int] | None = None, low: float | None = None, high: float | None = None,
           longest_ms: int | None = None) -> DataFrame:
    """(keep, tid, ts, value [, other columns of `series`]) represented by segment groups.

    Only ticks in [ts_from, ts_to] of the wanted series are generated. Values are decoded once per
    group. With `series` the values are divided by `scaling` and its columns are joined; it has to list every series
    that is generated. `tids` is a list or the name of a column of `groups` with the wanted ones of each. `gids`, see gids_of, lets the scan skip the files of other groups. `low` and `high` bound the stored
    values; segments whose extremes are outside are not decoded.
    """
    if low is not None or high is not None:
        groups = groups.where(may_hold(low, high))
    if gids is not None:
        groups = groups.where(F.col("gid").isin([int(g) for g in gids]))
    wanted = tids if tids is None or isinstance(tids, str) else f"cast(array({', '.join(str(int(t)) for t in tids)}) AS array<int>)"
    g = groups if wanted is None else groups.where(f"arrays_overlap(tids, {wanted})")
    g = with_offsets(g).selectExpr("*", "unix_millis(start_time) - skip * si_ms AS __origin")
    # a small file of segments is many points: the segments are dealt out before they are decoded
    g = clip(g, ts_from, ts_to, longest_ms).repartition("tids", "start_time")
    stored = F.expr(f"CASE WHEN mtid NOT IN {schema.CLOSED_FORM} THEN payload END")
    g = g.withColumn("vals", values_of(F.col("mtid"), stored, F.expr("n_stored * width"), models))
    kept = list(keep)
    slots = "sequence(skip * width, (skip + n_ticks) * width - 1)"
    if wanted is not None:  # only the wanted members of a group are generated
        members_at = f"filter(sequence(0, width - 1), p -> array_contains({wanted}, tids[p]))"
        slots = "flatten(transform(sequence(skip, skip + n_ticks - 1), t -> transform(__at, p -> t * width + p)))"
        g = g.withColumn("__at", F.expr(members_at))
    out = (g.selectExpr(*kept, "__origin", "si_ms", "width", "tids", "vals", "a", "b", f"explode({slots}) AS slot")
           .selectExpr(*kept, "tids[slot % width] AS tid", "timestamp_millis(__origin + (slot div width) * si_ms) AS ts",
                       "coalesce(vals[slot], cast(b + a * ((slot div width) * si_ms) AS float)) AS value"))
    if low is not None:
        out = out.where(F.col("value") >= F.lit(low))
    if high is not None:
        out = out.where(F.col("value") <= F.lit(high))
    if series is None:
        return out
    extra = [c for c in series.columns if c not in ("tid", "scaling")]
    return (required(out, series, ["tid"], "series")
            .select(*kept, "tid", "ts", (F.col("value") / F.col("scaling")).cast("float").alias("value"), *extra))


def may_hold(low: float | None, high: float | None) -> Column:
    """Whether a segment group can hold a value in [low, high], from its extremes."""
    closed = F.col("mtid").isin(*schema.CLOSED_FORM)
    first = F.col("b").cast("float")
    last = (F.col("b") + F.col("a") * ((F.col("n_ticks") - 1) * F.col("si_ms"))).cast("float")
    top = F.when(closed, F.greatest(first, last)).otherwise(F.array_max("maxs"))
    bottom = F.when(closed, F.least(first, last)).otherwise(F.array_min("mins"))
    condition = F.lit(True)
    if low is not None:
        condition &= top >= F.lit(low)
    if high is not None:
        condition &= bottom <= F.lit(high)
    return condition


def touches(gids: Iterable[int] | None = None, ts_from=None, ts_to=None) -> Column:
    """Whether a segment group of the listed groups can hold points in the time, from plain columns of the store.

    For conditions on points that points() can't state: what it combines with & and | reaches the scan of groups.where(...), so the
    other segments are neither read nor decoded; the exact condition then follows on the points.
    """
    condition = F.lit(True) if gids is None else F.col("gid").isin([int(g) for g in gids])
    if ts_from is not None:
        condition &= F.col("end_time") >= _time(ts_from)
    return condition if ts_to is None else condition & (F.col("start_time") <= _time(ts_to))


def gids_of(series: DataFrame, tids: Iterable[int]) -> list[int]:
    """The groups of the listed series, at most one per listed id; none for unknown ids.

    On a table of store.write_series this is one small scan of the row groups with those ids.
    """
    return sorted({r.gid for r in series.where(F.col("tid").isin([int(t) for t in tids])).select("gid").collect()})


def points_by_member(groups: DataFrame, series: DataFrame, condition: Column, **options) -> DataFrame:
    """Points of the series whose metadata meets `condition`: groups without one are left out, of the others only those are generated."""
    chosen = series.where(condition)
    wanted = chosen.groupBy("gid").agg(F.collect_set("tid").alias("__wanted"))
    return points(groups.join(wanted, "gid"), chosen, tids="__wanted", **options)


def count_points(groups: DataFrame) -> DataFrame:
    """COUNT(*) over points from lengths only."""
    return groups.agg(F.coalesce(F.sum(F.col("n_ticks") * F.size("tids")), F.lit(0)).alias("n"))


def point_lookup(segments: DataFrame, requests: DataFrame, bucket_ms: int, models: tuple = ()) -> DataFrame:
    """Value of each request (tid, ts) from the segment covering it, NULL outside all segments.

    Segments are listed under each time bucket they touch, so this is an equi-join.
    """
    start = F.unix_millis("start_time")
    buckets = F.sequence(F.floor(start / bucket_ms), F.floor(F.unix_millis("end_time") / bucket_ms))
    stored = F.when(~F.col("mtid").isin(*schema.CLOSED_FORM), F.col("payload"))
    s = segments.select("tid", "start_time", "end_time", "si_ms", "mtid", stored.alias("payload"), "a", "b", "pos", "width",
                        "skip", "n_stored", F.explode(buckets).alias("bucket"))
    r = requests.withColumn("bucket", F.floor(F.unix_millis("ts") / bucket_ms))
    covers = (F.col("r.ts") >= F.col("s.start_time")) & (F.col("r.ts") <= F.col("s.end_time"))
    on_grid = (F.unix_millis("r.ts") - F.unix_millis("s.start_time")) % F.col("s.si_ms") == 0
    joined = r.alias("r").join(
        s.alias("s"), (F.col("r.tid") == F.col("s.tid")) & (F.col("r.bucket") == F.col("s.bucket")) & covers & on_grid,
        "left")
    d = joined.select(
        F.col("r.tid").alias("tid"), F.col("r.ts").alias("ts"), "a", "b", "pos", "width",
        ((F.unix_millis("r.ts") - F.unix_millis("start_time")) / F.col("si_ms") + F.col("skip")).cast("int").alias("tick"),
        "si_ms", "mtid", values_of(F.coalesce("mtid", F.lit(0)), F.col("payload"),
                                   F.coalesce(F.col("n_stored") * F.col("width"), F.lit(0)), models).alias("vals"))
    value = F.coalesce(F.element_at("vals", F.col("tick") * F.col("width") + F.col("pos") + 1),
                       (F.col("b") + F.col("a") * (F.col("tick") * F.col("si_ms"))).cast("float"))
    return d.select("tid", "ts", value.alias("value"))


def overlapping(segments: DataFrame, ranges: DataFrame, bucket_ms: int, salts: int = 1) -> DataFrame:
    """Pairs of segments and (range_id, range_start, range_end) that overlap, once each.

    Both are listed under the time buckets they touch. With `salts` the segments of a bucket are dealt out by
    series to that many tasks, and the ranges go to each, so a crowded time does not end in one task.
    """
    def listed(df, a, b):
        return df.withColumn("bucket", F.explode(F.sequence(F.floor(F.unix_millis(a) / bucket_ms),
                                                            F.floor(F.unix_millis(b) / bucket_ms))))
    s, r = listed(segments, "start_time", "end_time"), listed(ranges, "range_start", "range_end")
    s = s.withColumn("salt", F.pmod(F.hash("tid"), F.lit(salts)))
    r = r.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    first = F.greatest(F.floor(F.unix_millis("start_time") / bucket_ms), F.floor(F.unix_millis("range_start") / bucket_ms))
    return (s.join(r, ["bucket", "salt"])
            .where((F.col("start_time") <= F.col("range_end")) & (F.col("end_time") >= F.col("range_start"))
                   & (F.col("bucket") == first))
            .drop("bucket", "salt"))


def register_views(groups: DataFrame, series: DataFrame, derived: DataFrame | None = None, tids: Iterable[int] | None = None,
                   ts_from=None, ts_to=None, longest_ms: int | None = None) -> None:
    """Temporary views `segment` and `datapoint` for SQL, both with the columns of `series`.

    `segment` carries vmin, vmax and vsum of every segment in the scale of the readings, so COUNT,
    MIN, MAX, SUM and AVG need no points: sum(n_ticks), min(vmin), max(vmax), sum(vsum). `derived`
    has further rows (tid, ts, value) for `datapoint`. The bounds `tids`, `ts_from` and `ts_to` hold for both views; they
    prune groups and periods of the store and are applied before anything is decoded, which SQL predicates on points aren't.
    """
    from tidegauge.operators.aggregate import with_stats
    dims = [c for c in series.columns if c not in ("gid", "si_ms", "scaling")]
    known = series.select(*dims, "scaling")
    scaled = {c: F.col(c).cast("double") / F.col("scaling") for c in ("vmin", "vmax", "vsum")}
    tids = None if tids is None else [int(t) for t in tids]
    gids = None if tids is None else gids_of(series, tids)
    chosen = groups if gids is None else groups.where(F.col("gid").isin(gids))
    bounded = ts_from is not None or ts_to is not None
    parts = members(chosen) if tids is None else members(chosen).where(F.col("tid").isin(tids))
    segments = required(with_stats(clip(parts, ts_from, ts_to, longest_ms), bounded), known, ["tid"], "series").withColumns(scaled)
    extra = [c for c in dims if c != "tid"]
    segments.select("tid", "start_time", "end_time", "mtid", "si_ms", "n_ticks", "vmin", "vmax", "vsum",
                    *extra).createOrReplaceTempView("segment")
    d = points(groups, known, tids, ts_from, ts_to, gids=gids, longest_ms=longest_ms)
    if derived is not None:
        d = d.unionByName(derived.select("tid", "ts", "value"), allowMissingColumns=True)
    d.createOrReplaceTempView("datapoint")


def register_calendar_views(groups: DataFrame, series: DataFrame, units: Iterable[str], aggs: Iterable[str]) -> None:
    """Temporary views `cal_<aggregate>_<unit>` (tid, field, <aggregate>), in the scale of the readings, from segments."""
    from tidegauge.operators.aggregate import calendar_agg
    placed = required(members(groups), series.select("tid", "scaling"), ["tid"], "series")
    for unit in units:
        for agg in aggs:
            calendar_agg(placed, agg, unit, ["tid", "scaling"], scaling=F.col("scaling")).drop("scaling").createOrReplaceTempView(f"cal_{agg}_{unit}")


# Bodies of SQL table functions over the temporary view segment_group; arguments begin with p_, null is no bound.
_KEPT = """(p_from IS NULL OR end_time >= p_from) AND (p_to IS NULL OR start_time <= p_to) AND (p_tids IS NULL OR arrays_overlap(tids, p_tids))"""
_TICKS = """coalesce(greatest(0, ceil((unix_millis(p_from) - unix_millis(start_time)) / si_ms)), 0) AS first_tick,
 coalesce(least(n_ticks - 1, floor((unix_millis(p_to) - unix_millis(start_time)) / si_ms)), n_ticks - 1) AS last_tick"""
_POINTS = f"""SELECT tid, timestamp_millis(unix_millis(start_time) + i * si_ms) AS ts, coalesce(vals[i * size(tids) + pos], cast(b + a * (i * si_ms) AS float)) AS value
 FROM (SELECT *, posexplode(tids) AS (pos, tid) FROM (SELECT *, explode(sequence(first_tick, last_tick)) AS i FROM (
 SELECT tids, start_time, si_ms, a, b, {_TICKS}, stored_values(mtid, CASE WHEN mtid NOT IN {schema.CLOSED_FORM} THEN payload END, n_ticks * size(tids)) AS vals
 FROM segment_group WHERE {_KEPT}) WHERE first_tick <= last_tick)) WHERE p_tids IS NULL OR array_contains(p_tids, tid)"""
_BOUNDS = "p_tids ARRAY<INT> DEFAULT NULL, p_from TIMESTAMP DEFAULT NULL, p_to TIMESTAMP DEFAULT NULL"
_SEGMENT_AGGREGATES = {"count_s": "count(value)", "min_s": "min(cast(value AS double))", "max_s": "max(cast(value AS double))", "sum_s": "sum(cast(value AS double))",
                       "avg_s": "avg(cast(value AS double))"}


def register_functions(groups: DataFrame) -> None:
    """SQL table functions over a store in the stored scale, each with (tids, from, to) as optional SQL arguments.

    datapoints(...) gives (tid, ts, value); segments(...) gives (tid, start_time, end_time, n_ticks, mtid) cut to the bounds;
    count_s, min_s, max_s, sum_s and avg_s give (tid, result) within the bounds. The bounds stand in the body as predicates on
    the columns of the store, so literal arguments reach its scan and prune its periods, and only segments that overlap them are decoded.
    """
    spark = groups.sparkSession
    groups.createOrReplaceTempView("segment_group")
    spark.udf.register("stored_values", decoder())
    cut = f"""SELECT tid, timestamp_millis(unix_millis(start_time) + first_tick * si_ms), timestamp_millis(unix_millis(start_time) + last_tick * si_ms),
 cast(last_tick - first_tick + 1 AS int), mtid FROM (SELECT *, explode(tids) AS tid FROM (SELECT tids, start_time, si_ms, mtid, {_TICKS} FROM segment_group WHERE {_KEPT})
 WHERE first_tick <= last_tick) WHERE p_tids IS NULL OR array_contains(p_tids, tid)"""
    functions = {"datapoints": ("tid INT, ts TIMESTAMP, value FLOAT", _POINTS), "segments": ("tid INT, start_time TIMESTAMP, end_time TIMESTAMP, n_ticks INT, mtid INT", cut)}
    for name, aggregate in _SEGMENT_AGGREGATES.items():
        kind = "BIGINT" if name == "count_s" else "DOUBLE"
        functions[name] = (f"tid INT, result {kind}", f"SELECT tid, {aggregate} FROM ({_POINTS}) GROUP BY tid")
    period = " AND (p_to IS NULL OR period <= to_date(p_to))" if "period" in groups.columns else ""
    for name, (columns, body) in functions.items():
        body = body.replace(_KEPT, _KEPT + period)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({_BOUNDS}) RETURNS TABLE({columns}) RETURN {body}")
