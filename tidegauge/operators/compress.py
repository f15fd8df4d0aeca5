"""Compression: points -> segments, one Spark group per (group of series, chunk of time).

Greedy segmentation is sequential, so the time line is cut into chunks of a bounded number of
points: a hot series or a wide group becomes many small tasks. A chunk edge costs at most one
extra segment per group and never affects the error bound.
"""

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidegauge import schema
from tidegauge.functions.models import Constant, Linear, Xor, correlated_members, members_apart, segment_run
from tidegauge.plans.lookup import required
from tidegauge.plans.ordered import consecutive_runs, positions

CHUNK_TICKS = 4096
LENGTH_BOUND = 50
GROUP_WIDTH = 1024


def default_models(length_bound: int = LENGTH_BOUND) -> tuple:
    return Constant(), Linear(), Xor(length_bound)


def check_options(eps: Iterable[float], length_bound: int, chunk_ticks: int, split_fraction: float = 0.0,
                  maximum_latency: int = 0) -> None:
    if any(not 0.0 <= e <= 100.0 for e in eps):
        raise ValueError("an error bound is a percentage from 0 to 100")
    if length_bound <= 0:
        raise ValueError("length_bound must be positive")
    if chunk_ticks <= 0:
        raise ValueError("chunk_ticks must be positive")
    if split_fraction < 0 or maximum_latency < 0:
        raise ValueError("split_fraction and maximum_latency must not be negative")


def with_group(points: DataFrame, series: DataFrame | None, si_ms: int | None) -> DataFrame:
    """Add gid, part, si_ms and group_size; without `series` each series is its own group.

    A group of more than GROUP_WIDTH members is stored in parts of that many, so that the width of
    a group cannot grow the work of a task; group_size counts the members of the part.
    """
    if series is None:
        if si_ms is None:
            raise ValueError("pass si_ms or a series table")
        return points.withColumns({"gid": F.col("tid"), "part": F.lit(0), "si_ms": F.lit(si_ms).cast("long"),
                                   "group_size": F.lit(1)})
    return required(points, _parts(series).drop("pos"), ["tid"], "series")


def _parts(series: DataFrame) -> DataFrame:
    """(gid, part, tid, si_ms, pos, group_size): members in order of their ids, GROUP_WIDTH a part, `pos` within the part."""
    meta = series.select("tid", "gid", F.col("si_ms").cast("long").alias("si_ms"))
    placed = positions(meta, ["gid"], ["tid"], F.floor(F.col("tid") / 65_536))
    at = F.col("rn") - 1
    parts = placed.select("tid", "gid", "si_ms", F.floor(at / GROUP_WIDTH).cast("int").alias("part"), (at % GROUP_WIDTH).cast("int").alias("pos"))
    sizes = parts.groupBy("gid", "part").agg(F.count(F.lit(1)).cast("int").alias("group_size"))
    return parts.join(sizes, ["gid", "part"])


def chunk_ms(si_ms: Column, group_size: Column, chunk_ticks: int) -> Column:
    """Chunks hold about `chunk_ticks` points, so wide groups get fewer ticks per chunk."""
    wide = F.greatest(F.lit(64), F.floor(F.lit(chunk_ticks) / group_size))
    return si_ms * F.when(group_size == 1, F.lit(chunk_ticks)).otherwise(wide)


def chunk_of(ts: Column, si_ms: Column, group_size: Column, chunk_ticks: int) -> Column:
    return F.floor(F.unix_millis(ts) / chunk_ms(si_ms, group_size, chunk_ticks)).cast("long")


def compress(points: DataFrame, eps: float | Iterable[float] = 0.0, si_ms: int | None = None,
             series: DataFrame | None = None, models: tuple | None = None, length_bound: int = LENGTH_BOUND,
             chunk_ticks: int = CHUNK_TICKS, split_fraction: float = 0.0) -> DataFrame:
    """Segments of `points` for one or several error bounds (percent), see schema.SEGMENT_GROUPS.

    With `series` (tid, gid, si_ms) the members of a group share one model per segment. With
    `split_fraction` > 0 a chunk whose ratio is below that fraction of what its correlated
    sub-groups reach is stored by sub-group. A chunk is one task, and a fixed part of the layout: a segment
    ends at its edge.
    """
    bounds = [float(e) for e in (eps if isinstance(eps, Iterable) else [eps])]
    check_options(bounds, length_bound, chunk_ticks, split_fraction)
    models = models or default_models(length_bound)
    d = with_group(points, series, si_ms)
    # a series that is its own group is named by the key: only its times and values travel
    alone = series is None
    keys, known = (["gid", "chunk"], []) if alone else (["gid", "part", "chunk"], ["tid", "si_ms", "group_size"])
    chunk = chunk_of(F.col("ts"), F.col("si_ms"), F.col("group_size"), chunk_ticks)
    keyed = d.withColumns({"chunk": chunk, "ms": F.unix_millis("ts"), "value": F.col("value").cast("float")}).select(*keys, "ms", "value", *known)
    arrow_schema = to_arrow_schema(schema.SEGMENT_GROUPS)

    def fit_chunk(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = [k.as_py() for k in key]
        if alone:
            group.insert(1, 0)
            for name, value in (("tid", pa.scalar(group[0], pa.int32())), ("si_ms", pa.scalar(si_ms)), ("group_size", pa.scalar(1))):
                table = table.append_column(name, pa.repeat(value, len(table)))
        # the points travel once, whatever the number of bounds
        found = segment_chunk(table, bounds, models, length_bound, split_fraction)
        return segment_table(found, bounds, group, arrow_schema)

    return keyed.groupBy(*keys).applyInArrow(fit_chunk, schema.SEGMENT_GROUPS)


def compress_groups(points: DataFrame, series: DataFrame, **options) -> DataFrame:
    return compress(points, series=series, **options)


def correlated_subgroups(points: DataFrame, series: DataFrame, eps: float,
                         chunk_ticks: int = CHUNK_TICKS) -> DataFrame:
    """(gid, chunk, tid, leader): members that stay within twice the bound of their leader."""
    d = with_group(points, series, None)
    keyed = d.select("gid", "part", chunk_of(F.col("ts"), F.col("si_ms"), F.col("group_size"), chunk_ticks).alias("chunk"),
                     F.unix_millis("ts").alias("ms"), "tid", "value")

    def split(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, tids, values = tick_matrix(*_columns(table))
        rows = [(key[0].as_py(), key[2].as_py(), int(tids[i]), int(tids[group[0]]))
                for group in correlated_members(values, eps) for i in group]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.int32()))],
                        names=["gid", "chunk", "tid", "leader"])

    return keyed.groupBy("gid", "part", "chunk").applyInArrow(split, "gid int, chunk long, tid int, leader int")


def lasting_subgroups(points: DataFrame, series: DataFrame, eps: float, chunk_ticks: int = CHUNK_TICKS) -> DataFrame:
    """(gid, part, tid, leader): members within twice the bound of their leader at every shared tick of the whole time.

    The smallest member left leads, repeatedly. A chunk tells which members are apart in it, as bits of 64 members a row; Spark
    joins the bits of all chunks, so what meets in one task is one row per 64 members, whatever the length of the series.
    Members without points have no row. Members of different parts of a wide group are not compared.
    """
    parts = _parts(series)
    keyed = required(points, parts, ["tid"], "series").select(
        "gid", "part", chunk_of(F.col("ts"), F.col("si_ms"), F.col("group_size"), chunk_ticks).alias("chunk"),
        F.unix_millis("ts").alias("ms"), "tid", "value", "pos")

    def far(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, tids, values = tick_matrix(*_columns(table))
        _, at = np.unique(table["tid"].to_numpy(), return_index=True)
        pos = table["pos"].to_numpy()[at]
        flags = np.zeros((len(tids), GROUP_WIDTH), dtype=bool)
        flags[:, pos] = members_apart(values, eps)
        words = np.packbits(flags, axis=1, bitorder="little").view("<i8")
        kept = words != 0
        kept[:, 0] = True  # a row for each member that has points
        row, word = np.nonzero(kept)
        n = len(row)
        return pa.table({"gid": pa.repeat(pa.scalar(key[0].as_py(), pa.int32()), n), "part": pa.repeat(pa.scalar(key[1].as_py(), pa.int32()), n),
                         "pos": pa.array(pos[row], pa.int32()), "word": pa.array(word, pa.int32()), "bits": pa.array(words[row, word], pa.int64())})

    apart = (keyed.groupBy("gid", "part", "chunk").applyInArrow(far, "gid int, part int, pos int, word int, bits long")
             .groupBy("gid", "part", "pos", "word").agg(F.bit_or("bits").alias("bits")))
    rows = apart.join(parts.select("gid", "part", "pos", "tid"), ["gid", "part", "pos"])

    def lead(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pos, first = np.unique(table["pos"].to_numpy(), return_index=True)
        tids = table["tid"].to_numpy()[first]
        words = np.zeros((GROUP_WIDTH, GROUP_WIDTH // 64), dtype="<i8")
        words[table["pos"].to_numpy(), table["word"].to_numpy()] = table["bits"].to_numpy()
        flags = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(bool)
        left, leader = np.arange(len(pos)), np.empty(len(pos), dtype=np.int64)
        while len(left):
            same = ~flags[pos[left[0]], pos[left]]
            same[0] = True
            leader[left[same]] = tids[left[0]]
            left = left[~same]
        n = len(pos)
        return pa.table({"gid": pa.repeat(pa.scalar(key[0].as_py(), pa.int32()), n), "part": pa.repeat(pa.scalar(key[1].as_py(), pa.int32()), n),
                         "tid": pa.array(tids, pa.int32()), "leader": pa.array(leader, pa.int32())})

    return rows.groupBy("gid", "part").applyInArrow(lead, "gid int, part int, tid int, leader int")


def rejoined_subgroups(points: DataFrame, series: DataFrame, eps: float, chunk_ticks: int = CHUNK_TICKS) -> DataFrame:
    """(gid, tid, leader, first_chunk, last_chunk, n_chunks): the time in which a member follows one leader without a break.

    A member that leaves its leader and comes back later has a row for each time; a chunk without points of the member ends one.
    """
    d = correlated_subgroups(points, series, eps, chunk_ticks).withColumn("one", F.lit(1).cast("long"))
    times = consecutive_runs(d, ["gid", "tid", "leader"], "chunk", "one", F.floor(F.col("chunk") / 4096))
    return times.select("gid", "tid", "leader", F.col("first").alias("first_chunk"), F.col("last").alias("last_chunk"), F.col("n").alias("n_chunks"))


def _columns(table: pa.Table):
    return (table[c].to_numpy() for c in ("ms", "tid", "value"))


def tick_matrix(ms, tid, value) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, tids and a float32 matrix (ticks x tids, NaN = gap) of one chunk.

    Two readings of a series in one millisecond, or a reading without a number, can't be stored and raise;
    regularize.split_readings sorts them out beforehand.
    """
    ticks, row = np.unique(ms, return_inverse=True)
    tids, col = np.unique(tid, return_inverse=True)
    value = np.asarray(value, dtype=np.float32)
    lost = np.flatnonzero(np.isnan(value))
    if len(lost):
        raise ValueError(f"series {tid[lost[0]]} has no number at {ms[lost[0]]} ms")
    slots, counts = np.unique(row * len(tids) + col, return_counts=True)
    if len(slots) < len(row):
        twice = slots[counts > 1][0]
        raise ValueError(f"series {tids[twice % len(tids)]} has several readings at {ticks[twice // len(tids)]} ms")
    values = np.full((len(ticks), len(tids)), np.nan, dtype=np.float32)
    values[row, col] = value
    return ticks, tids, values


def runs(ticks, values, si_ms):
    """(first, end, active columns) of the runs in which the same members have every tick."""
    present = ~np.isnan(values)
    breaks = (np.diff(ticks) != si_ms) | (present[1:] != present[:-1]).any(axis=1)
    edges = np.concatenate(([0], np.flatnonzero(breaks) + 1, [len(ticks)]))
    for first, end in zip(edges[:-1], edges[1:]):
        yield first, end, np.flatnonzero(present[first])


def segment_chunk(table, bounds, models, length_bound, split_fraction=0.0) -> list[list[tuple]]:
    """(start_ms, si_ms, mtid, Fit, tids, n_gaps, values) of every segment of one chunk, for each bound."""
    si_ms, group_size = table["si_ms"][0].as_py(), table["group_size"][0].as_py()
    ticks, tids, values = tick_matrix(*_columns(table))
    return [_segment_bound(ticks, tids, values, si_ms, group_size, eps, models, length_bound, split_fraction) for eps in bounds]


def _segment_bound(ticks, tids, values, si_ms, group_size, eps, models, length_bound, split_fraction):
    whole = _segment_members(ticks, tids, values, si_ms, group_size, eps, models, length_bound)
    if split_fraction <= 0 or len(tids) == 1:
        return whole
    parts = [s for cols in correlated_members(values, eps)
             for s in _segment_members(ticks, tids[cols], values[:, cols], si_ms, group_size, eps, models,
                                       length_bound)]
    return parts if _ratio(whole) < split_fraction * _ratio(parts) else whole


def _ratio(segments) -> float:
    points = sum(fit.length * len(tids) for _, _, _, fit, tids, _, _ in segments)
    stored = sum(schema.SEGMENT_METADATA_BYTES + fit.size + schema.GAP_BYTES * gaps
                 for _, _, _, fit, _, gaps, _ in segments)
    return schema.POINT_BYTES * points / stored


def _segment_members(ticks, tids, values, si_ms, group_size, eps, models, length_bound):
    some = ~np.isnan(values).all(axis=1)
    ticks, values = ticks[some], values[some]
    out = []
    for first, end, active in runs(ticks, values, si_ms):
        run, gaps = values[first:end][:, active], group_size - len(active)
        for at, mtid, fit in segment_run(run, si_ms, eps, models, length_bound, gaps)[0]:
            out.append((int(ticks[first + at]), si_ms, mtid, fit, tids[active], gaps, run[at:at + fit.length]))
    return out


def segment_table(found, bounds, group, arrow_schema) -> pa.Table:
    """The segments found for each bound as one table."""
    rows = []
    for eps, (start, si_ms, mtid, fit, tids, gaps, values) in ((eps, s) for eps, segments in zip(bounds, found) for s in segments):
        stats = (None, None, None)
        if mtid not in schema.CLOSED_FORM:
            stats = (values.min(axis=0).tolist(), values.max(axis=0).tolist(),
                     values.sum(axis=0, dtype=np.float64).tolist())
        rows.append((eps, *group, start * 1000, (start + (fit.length - 1) * si_ms) * 1000, si_ms, fit.length,
                     mtid, fit.a, fit.b, fit.payload, tids.tolist(), gaps, *stats, int(fit.size)))
    columns = zip(*rows) if rows else [[]] * len(arrow_schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)
