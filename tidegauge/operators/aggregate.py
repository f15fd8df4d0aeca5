"""Aggregates on points and, without reconstructing points, on segments."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from tidegauge import schema
from tidegauge.functions.calendar import UNIT_MS, calendar_key, calendar_unit
from tidegauge.operators.view import members, stored_values, values_of, with_offsets
from tidegauge.plans.lookup import required
from tidegauge.plans.quantile import exact_median

AGGREGATES = ("count", "min", "max", "sum", "avg")


def point_aggregate(points: DataFrame, keys: Sequence[str] = (), **columns: Column) -> DataFrame:
    return points.groupBy(*keys).agg(*[c.alias(n) for n, c in columns.items()])


def value() -> Column:
    return F.col("value").cast("double")


def std(population: bool = False) -> Column:
    return F.stddev_pop(value()) if population else F.stddev_samp(value())


def median_approx(accuracy: int = 10_000) -> Column:
    return F.percentile_approx("value", 0.5, accuracy)


def median_exact(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return exact_median(points, keys, "value")


def decoded(segments: DataFrame, cut: Column, models: tuple = ()) -> DataFrame:
    """Add the stored values of the segments where `cut` holds and no closed form exists."""
    needed = cut & ~F.col("mtid").isin(*schema.CLOSED_FORM)
    return segments.withColumn("vals", values_of(F.col("mtid"), F.when(needed, F.col("payload")),
                                                 F.col("n_stored") * F.col("width"), models))


def with_stats(segments: DataFrame, clipped: bool = False, models: tuple = ()) -> DataFrame:
    """Set vmin, vmax and vsum of member segments, in the stored scale.

    Closed-form models and whole segments need only expressions. With `clipped`, the other
    segments that lost ticks are decoded (unless they carry `vals` already), and only those.
    """
    first, last = "(b + a * (skip * si_ms))", "(b + a * ((skip + n_ticks - 1) * si_ms))"
    closed = {"vmin": f"least(cast({first} AS float), cast({last} AS float))",
              "vmax": f"greatest(cast({first} AS float), cast({last} AS float))",
              "vsum": f"n_ticks * ({first} + {last}) / 2"}
    piece = ("CASE WHEN width = 1 THEN slice(vals, skip + 1, n_ticks) ELSE "
             "transform(sequence(skip, skip + n_ticks - 1), i -> element_at(vals, i * width + pos + 1)) END")
    cut = {"vmin": f"array_min({piece})", "vmax": f"array_max({piece})",
           "vsum": f"aggregate({piece}, 0D, (acc, x) -> acc + x)"}
    when = f"WHEN mtid IN {schema.CLOSED_FORM} THEN"
    if not clipped:
        return segments.selectExpr("* EXCEPT (vmin, vmax, vsum)", *[f"CASE {when} {closed[c]} ELSE {c} END AS {c}" for c in closed])
    d = segments if "vals" in segments.columns else decoded(segments, F.expr("n_ticks < n_stored"), models)
    return d.selectExpr("* EXCEPT (vmin, vmax, vsum, vals)", *[
        f"CASE {when} {closed[c]} WHEN n_ticks < n_stored THEN {cut[c]} ELSE {c} END AS {c}" for c in closed])


def aggregate_columns(aggs: Sequence[str], scaling: Column | None = None, suffix: str = "") -> list[Column]:
    """COUNT, MIN, MAX, SUM and AVG over rows of with_stats; every value is divided by `scaling`."""
    def scaled(c):
        v = F.col(c).cast("double")
        return v if scaling is None else v / scaling
    count, total = F.sum("n_ticks"), F.sum(scaled("vsum"))
    known = {"count": F.coalesce(count, F.lit(0)), "min": F.min(scaled("vmin")), "max": F.max(scaled("vmax")),
             "sum": total, "avg": total / count}
    return [known[a].alias(a + suffix) for a in aggs]


def agg_segments(segments: DataFrame, keys: Sequence = (), aggs: Sequence[str] = AGGREGATES,
                 scaling: Column | None = None, clipped: bool = False, models: tuple = ()) -> DataFrame:
    return with_stats(segments, clipped, models).groupBy(*keys).agg(*aggregate_columns(aggs, scaling))


def rollup_segments(segments: DataFrame, series: DataFrame, levels: Sequence[str],
                    aggs: Sequence[str] = AGGREGATES, clipped: bool = False) -> DataFrame:
    """Aggregates for every prefix of a dimension hierarchy; one partial row per series is rolled up."""
    per_tid = with_stats(segments, clipped).groupBy("tid").agg(
        F.sum("n_ticks").alias("n_ticks"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"),
        F.sum("vsum").alias("vsum"))
    return required(per_tid, series.select("tid", *levels), ["tid"], "series").rollup(*levels).agg(*aggregate_columns(aggs))


def _stop() -> Column:
    """End of a segment, not before its start: Spark may cut segments that `clip` left empty before it drops them."""
    return F.greatest("start_time", "end_time")


def calendar_pieces(segments: DataFrame, unit: str) -> DataFrame:
    """Member segments cut at the boundaries of `unit`, with the calendar field in `field`.

    A sampling interval of at least one unit is cut at every tick instead, so that a piece is
    never empty by construction.
    """
    unit_ms = UNIT_MS[unit]
    start, end, si = F.unix_millis("start_time"), F.unix_millis(_stop()), F.col("si_ms")
    if unit_ms is None:
        step = F.expr(f"INTERVAL 1 {unit}")
        bounds = F.sequence(F.date_trunc(unit, "start_time"), F.date_trunc(unit, _stop()), step)
        d = segments.select("*", F.explode(bounds).alias("__u"))
        d = d.withColumns({"__lo": F.unix_millis("__u"), "__hi": F.unix_millis(F.col("__u") + step)})
    else:
        per_tick = si >= unit_ms
        low = F.when(per_tick, start).otherwise(F.floor(start / unit_ms) * unit_ms)
        d = segments.select("*", F.explode(F.sequence(low, end, F.greatest(si, F.lit(unit_ms)))).alias("__lo"))
        d = d.withColumn("__hi", F.col("__lo") + F.when(per_tick, F.lit(1)).otherwise(F.lit(unit_ms)))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("__lo") - start) / si))
    last = F.least(F.col("n_ticks").cast("long") - 1, F.ceil((F.col("__hi") - start) / si) - 1)
    d = (d.withColumns({"__f": first, "__l": last}).where("__l >= __f")
         .withColumns({"skip": (F.col("skip") + F.col("__f")).cast("int"),
                       "n_ticks": (F.col("__l") - F.col("__f") + 1).cast("int"),
                       "start_time": F.timestamp_millis(start + F.col("__f") * si),
                       "end_time": F.timestamp_millis(start + F.col("__l") * si)}))
    return d.withColumn("field", calendar_key(unit, F.col("start_time"))).drop("__u", "__lo", "__hi", "__f", "__l")


def calendar_agg(segments: DataFrame, agg: str, unit: str, keys: Sequence[str] = (), as_map: bool = False,
                 scaling: Column | None = None, models: tuple = ()) -> DataFrame:
    """COUNT, MIN, MAX, SUM or AVG of segments per calendar field, as rows or as one map per key."""
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}")
    if agg != "count":
        # decode before cutting: once per segment, however many pieces it gives
        several = calendar_unit(unit, F.col("start_time")) != calendar_unit(unit, F.col("end_time"))
        segments = decoded(segments, several | (F.col("n_ticks") < F.col("n_stored")), models)
    pieces = calendar_pieces(segments, unit)
    if agg != "count":
        pieces = with_stats(pieces, clipped=True)
    rows = pieces.groupBy(*keys, "field").agg(*aggregate_columns([agg], scaling))
    if not as_map:
        return rows
    entries = F.sort_array(F.collect_list(F.struct("field", agg)))
    return rows.groupBy(*keys).agg(F.map_from_entries(entries).alias(agg))


_STATS = T.ArrayType(T.StructType([T.StructField("mins", T.ArrayType(T.FloatType())), T.StructField("maxs", T.ArrayType(T.FloatType())),
                                   T.StructField("sums", T.ArrayType(T.DoubleType()))]))
_DECODED = 1 << 22  # values of one worker in memory at a time


def _piece_stats(models: tuple):
    """A function (mtid, payload, n_stored, width, firsts, end): extremes and sum of every member in every piece of a group segment.

    A piece is the ticks from one of `firsts` to the next, the last one to `end`. NULL where there is no payload.
    """
    @arrow_udf(_STATS)
    def stats(mtid: pa.Array, payload: pa.Array, n_stored: pa.Array, width: pa.Array, firsts: pa.Array, end: pa.Array) -> pa.Array:
        ids, ticks, widths, ends = (a.to_numpy(zero_copy_only=False) for a in (mtid, n_stored, width, end))
        known = payload.is_valid().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(known)
        counts = ticks.astype(np.int64) * widths
        parts = [[np.empty(0, np.float32)], [np.empty(0, np.float32)], [np.empty(0, np.float64)]]
        n_pieces, lengths = np.zeros(len(ids), dtype=np.int64), [np.empty(0, np.int64)]
        share = np.cumsum(counts[rows]) // _DECODED
        for portion in np.split(rows, np.flatnonzero(np.diff(share)) + 1):
            flat, starts = stored_values(ids[portion], payload.take(pa.array(portion)).to_pylist(), counts[portion], models)
            for i, at in zip(portion, starts):
                values = flat[at:at + counts[i]].reshape(ticks[i], widths[i])[:ends[i]]
                first = np.asarray(firsts[int(i)].as_py(), dtype=np.int64)
                for found, reduce in zip(parts, (np.minimum, np.maximum, np.add)):
                    found.append(reduce.reduceat(values.astype(np.float64) if reduce is np.add else values, first, axis=0).ravel())
                n_pieces[i] = len(first)
                lengths.append(np.full(len(first), widths[i]))
        inner = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(lengths)))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(inner, pa.array(np.concatenate(found))) for found in parts]
        outer = np.concatenate(([0], np.cumsum(n_pieces))).astype(np.int32)
        pieces = pa.StructArray.from_arrays(lists, names=["mins", "maxs", "sums"])
        return pa.ListArray.from_arrays(pa.array(outer, mask=np.concatenate((~known, [False]))), pieces)

    return stats


def _bounds(unit: str) -> Column:
    """First and last tick, counted from the start of the row, of every piece at the boundaries of `unit`; some may be empty."""
    unit_ms = UNIT_MS[unit]
    start, si, last = F.unix_millis("start_time"), F.col("si_ms"), F.col("n_ticks").cast("long") - 1
    stop = _stop()

    def piece(low, high):
        return F.struct(F.greatest(F.lit(0).cast("long"), F.ceil((low - start) / si)).alias("first"),
                        F.least(last, F.ceil((high - start) / si) - 1).alias("last"))
    if unit_ms is None:
        step = F.expr(f"INTERVAL 1 {unit}")
        units = F.sequence(F.date_trunc(unit, "start_time"), F.date_trunc(unit, stop), step)
        return F.transform(units, lambda u: piece(F.unix_millis(u), F.unix_millis(u + step)))
    per_tick = si >= unit_ms
    low = F.when(per_tick, start).otherwise(F.floor(start / unit_ms) * unit_ms)
    return F.transform(F.sequence(low, F.unix_millis(stop), F.greatest(si, F.lit(unit_ms))),
                       lambda u: piece(u, u + F.when(per_tick, F.lit(1)).otherwise(F.lit(unit_ms))))


def group_pieces(groups: DataFrame, unit: str | None = None, values: bool = True, models: tuple = ()) -> DataFrame:
    """Segments of groups, whole or clipped, with the statistics of all members for just the ticks that are left, and without payload.

    With `unit` they are cut at its boundaries and have the calendar field in `field`. What is stored is decoded once for a group
    segment, whatever its number of members and pieces; closed forms and whole segments are not. Without `values` nothing is.
    """
    d = groups if "skip" in groups.columns else with_offsets(groups)
    d = d.withColumn("width", F.size("tids"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("n_ticks") - 1).cast("long").alias("last")))
    pieces = whole if unit is None else F.filter(_bounds(unit), lambda p: p["last"] >= p["first"])
    d = d.withColumn("__pieces", pieces)
    if values:
        cut = ~F.col("mtid").isin(*schema.CLOSED_FORM) & ((F.col("n_ticks") < F.col("n_stored")) | (F.size("__pieces") > 1))
        firsts = F.transform("__pieces", lambda p: (F.col("skip") + p["first"]).cast("int"))
        d = d.withColumn("__stats", _piece_stats(models)("mtid", F.when(cut, F.col("payload")), "n_stored", "width", firsts, F.col("skip") + F.col("n_ticks")))
    d = d.drop("payload", "width").select("*", F.posexplode("__pieces").alias("__i", "__p"))
    new = {"skip": "cast(skip + __p.first AS int)", "n_ticks": "cast(__p.last - __p.first + 1 AS int)",
           "start_time": "timestamp_millis(unix_millis(start_time) + __p.first * si_ms)",
           "end_time": "timestamp_millis(unix_millis(start_time) + __p.last * si_ms)"}
    if values:
        new |= {c: f"coalesce(__stats[__i].{c}, {c})" for c in ("mins", "maxs", "sums")}
    d = d.withColumns({name: F.expr(text) for name, text in new.items()})
    if unit is not None:
        d = d.withColumn("field", calendar_key(unit, F.col("start_time")))
    return d.drop("__pieces", "__i", "__p", "__stats")


def agg_groups(groups: DataFrame, keys: Sequence = ("tid",), aggs: Sequence[str] = AGGREGATES, unit: str | None = None,
               scaling: Column | None = None, models: tuple = ()) -> DataFrame:
    """Aggregates of the members of groups, whole or clipped, per calendar field of `unit` if given: the way for wide groups."""
    pieces = group_pieces(groups, unit, any(a != "count" for a in aggs), models)
    by = [*keys, *(["field"] if unit is not None else [])]
    return with_stats(members(pieces)).groupBy(*by).agg(*aggregate_columns(aggs, scaling))
