"""Compression, views over segments, and aggregates on segments."""

import numpy as np
from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import Catalog, dbl, sql
from tidegauge import schema
from tidegauge.functions.calendar import UNITS
from tidegauge.functions.models import Constant, Fit, Linear, Xor
from tidegauge.operators import aggregate, quality, view
from tidegauge.operators.compress import CHUNK_TICKS, compress, compress_groups, lasting_subgroups, rejoined_subgroups
from tidegauge.session import work_dir
from tidegauge.sources import store as stores

CATALOG = Catalog()
add = CATALOG.add

V = "CAST(value AS DOUBLE)"


# ---- compression ----

def invariants(table, keys="tid", *more):
    """Every point is represented, nothing else is, and no error exceeds the bound."""
    return sql(table, *more, body=f"""SELECT {keys}, count(*) n_points, CAST(0 AS BIGINT) n_missing, CAST(0 AS BIGINT) n_extra,
 CAST(0 AS BIGINT) n_violations FROM {table} GROUP BY {keys}""")


def check(points, groups, eps, **options):
    return quality.alignment_counts(quality.align(points, view.points(groups, **options)), eps)


SHORT = 256  # ticks per chunk where the SQL repeats the segmentation tick by tick

# The state of one tick: where its segment starts, ticks so far, running sum and extremes. A tick
# that does not fit, or starts a chunk, opens the next segment.
PMC = """SELECT tid, chunk, i, v, i s, 1 n, CAST(v AS DOUBLE) total, v lo, v hi FROM p WHERE i = first
 UNION ALL SELECT tid, chunk, i, v, CASE WHEN fits THEN s ELSE i END, CASE WHEN fits THEN n + 1 ELSE 1 END,
 CASE WHEN fits THEN total + v ELSE v END, CASE WHEN fits THEN lo2 ELSE v END, CASE WHEN fits THEN hi2 ELSE v END FROM (
 SELECT *, (m = lo2 OR abs((CAST(lo2 AS DOUBLE) - m) / lo2) * 100 <= 5) AND (m = hi2 OR abs((CAST(hi2 AS DOUBLE) - m) / hi2) * 100 <= 5) fits
 FROM (SELECT q.tid, q.chunk, q.i, q.v, r.s, r.n, r.total, least(lo, q.v) lo2, greatest(hi, q.v) hi2,
 CAST((total + q.v) / (n + 1) AS FLOAT) m FROM r JOIN p q ON q.tid = r.tid AND q.chunk = r.chunk AND q.i = r.i + 1))"""

TICKS = """SELECT *, min(i) OVER (PARTITION BY tid, chunk) first FROM (
 SELECT tid, epoch_ms(ts) // 512000 chunk, epoch_ms(ts) // 2000 i, value v FROM pts_smooth)"""


@add("pmc_segments", sql("pts_smooth", p=TICKS, r=PMC, recursive=True, body="""SELECT tid, make_timestamp(s * 2000000) start_time,
 make_timestamp(max(i) * 2000000) end_time, CAST(max(n) AS INT) n_ticks,
 round(CAST(CAST(arg_max(total, n) / max(n) AS FLOAT) AS DOUBLE), 4) model FROM r GROUP BY tid, chunk, s"""))
def pmc_segments(spark, sf_dir):
    g = compress(fx.points(spark, sf_dir, "pts_smooth"), 5.0, si_ms=2000, models=(Constant(),), chunk_ticks=SHORT)
    return g.select("gid", "start_time", "end_time", "n_ticks", F.round("b", 4).alias("model")).withColumnRenamed("gid", "tid")


@add("pmc_sizes", sql("pts_smooth", p=TICKS, r=PMC, recursive=True, body="""SELECT tid, points, 4 * n models_size, 24 * n metadata_size,
 CAST(0 AS BIGINT) gaps_size, 28 * n expected_size, round(points * 16 / (28 * n), 6) compression_factor FROM
 (SELECT tid, count(*) points, count(*) FILTER (WHERE n = 1) n FROM r GROUP BY tid)"""))
def pmc_sizes(spark, sf_dir):
    """Sizes and factor of the segments that the SQL finds tick by tick."""
    g = compress(fx.points(spark, sf_dir, "pts_smooth"), 5.0, si_ms=2000, models=(Constant(),), chunk_ticks=SHORT)
    return quality.model_sizes(g, ["gid"]).withColumnRenamed("gid", "tid").withColumn("compression_factor", F.round("compression_factor", 6))


def repeat_model():
    """A model type as a user writes one: a run of equal values, kept as one of them."""
    class Repeat:  # a local class travels to the executors with the tasks
        mtid = 100

        def fit(self, values, si_ms, eps):
            other = (values != values[0, 0]).any(axis=1)
            length = int(other.argmax()) if other.any() else len(values)
            return Fit(length, 4.0, payload=values[:1, :1].astype("<f4").tobytes()) if length else Fit(0, float("nan"))

        def decode(self, payload, count):
            return np.full(count, np.frombuffer(payload, dtype="<f4")[0])

    return Repeat()


# the chunks of an hourly series, and its runs of equal values in them
REPEATS = """SELECT *, sum(new) OVER (PARTITION BY tid, chunk ORDER BY ts) run FROM (SELECT *, CASE WHEN lag(value) OVER (
 PARTITION BY tid, chunk ORDER BY ts) = value THEN 0 ELSE 1 END new FROM (SELECT *, epoch_ms(ts) // 14745600000 chunk FROM pts_cnt))"""


@add("user_model_segments", sql("pts_cnt", runs=REPEATS, body=f"""SELECT tid, min(ts) start_time, max(ts) end_time, CAST(count(*) AS INT) n_ticks,
 min({V}) low, sum({V}) total FROM runs GROUP BY tid, chunk, run"""))
def user_model_segments(spark, sf_dir):
    g = compress(fx.points(spark, sf_dir, "pts_cnt"), 0.0, si_ms=fx.SI["pts_cnt"], models=(repeat_model(),))
    return g.select(F.col("gid").alias("tid"), "start_time", "end_time", "n_ticks", F.col("mins")[0].cast("double").alias("low"),
                    F.col("sums")[0].alias("total"))


@add("user_model_points", sql("pts_cnt", body=f"SELECT tid, CAST(day(ts) AS INT) field, count(*) n, sum({V}) total FROM pts_cnt WHERE ts >= TIMESTAMP '2024-01-02 05:30:00' GROUP BY 1, 2"))
def user_model_points(spark, sf_dir):
    """Points and clipped aggregates through the model's own decoding agree."""
    models = (repeat_model(),)
    g = compress(fx.points(spark, sf_dir, "pts_cnt"), 0.0, si_ms=fx.SI["pts_cnt"], models=models)
    shown = view.points(g, ts_from="2024-01-02 05:30:00", models=models).groupBy("tid", F.dayofmonth("ts").alias("field")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("double")).alias("total"))
    clipped = view.clip(view.with_offsets(g), "2024-01-02 05:30:00")
    known = aggregate.agg_groups(clipped, aggs=["count", "sum"], unit="day_of_month", models=models)
    return shown.join(known, ["tid", "field"]).where("n = count AND total = sum").select("tid", "field", "n", "total")


SWING = """SELECT tid, chunk, i, v, i s, 1 n, v v0, CAST('infinity' AS DOUBLE) up, CAST('-infinity' AS DOUBLE) lo FROM p WHERE i = first
 UNION ALL SELECT tid, chunk, i, v, CASE WHEN fits THEN s ELSE i END, CASE WHEN fits THEN n + 1 ELSE 1 END,
 CASE WHEN fits THEN v0 ELSE v END, CASE WHEN fits THEN least(up, (x + d - v0) / dt) ELSE 'infinity' END,
 CASE WHEN fits THEN greatest(lo, (x - d - v0) / dt) ELSE '-infinity' END FROM (
 SELECT *, n = 1 OR NOT (x - d > v0 + up * dt OR x + d < v0 + lo * dt) fits FROM (
 SELECT q.tid, q.chunk, q.i, q.v, r.s, r.n, r.v0, r.up, r.lo, CAST(q.v AS DOUBLE) x, CAST((q.i - r.s) * 2000 AS DOUBLE) dt,
 abs(CAST(q.v AS DOUBLE) * (CAST(5 AS DOUBLE) / CAST(100.1 AS DOUBLE))) d
 FROM r JOIN p q ON q.tid = r.tid AND q.chunk = r.chunk AND q.i = r.i + 1))"""


@add("swing_segments", sql("pts_smooth", p=TICKS, r=SWING, recursive=True, body="""SELECT tid, make_timestamp(s * 2000000) start_time,
 make_timestamp(max(i) * 2000000) end_time, CAST(max(n) AS INT) n_ticks, CASE WHEN max(n) = 1 THEN 1 ELSE 3 END mtid,
 CASE WHEN max(n) = 1 THEN 0 ELSE round((arg_max(up, n) + arg_max(lo, n)) / 2, 6) END slope FROM r GROUP BY tid, chunk, s"""))
def swing_segments(spark, sf_dir):
    g = compress(fx.points(spark, sf_dir, "pts_smooth"), 5.0, si_ms=2000, models=(Linear(),), chunk_ticks=SHORT)
    return g.select(F.col("gid").alias("tid"), "start_time", "end_time", "n_ticks", "mtid", F.round("a", 6).alias("slope"))


BLOCKS = """SELECT tid, ts, value, (row_number() OVER (PARTITION BY tid, chunk, run ORDER BY ts) - 1) // 50 block, chunk, run FROM (
 SELECT *, sum(new) OVER (PARTITION BY tid, chunk ORDER BY ts) run FROM (SELECT *, epoch_ms(ts) // 353894400000 chunk,
 CASE WHEN date_diff('day', lag(ts) OVER (PARTITION BY tid, epoch_ms(ts) // 353894400000 ORDER BY ts), ts) = 1 THEN 0 ELSE 1 END new
 FROM pts_ship))"""
XOR_SEGMENTS = """SELECT tid, min(ts) start_time, max(ts) end_time, CAST(count(*) AS INT) n_ticks, CAST(min(value) AS DOUBLE) low,
 CAST(max(value) AS DOUBLE) high, sum(CAST(value AS DOUBLE)) total FROM blocks GROUP BY tid, chunk, run, block"""


def xor_store(spark, sf_dir):
    return fx.store(spark, sf_dir, "pts_ship", 0.0, models=(Xor(50),))


@add("gorilla_segments", sql("pts_ship", blocks=BLOCKS, body=XOR_SEGMENTS))
def gorilla_segments(spark, sf_dir):
    return xor_store(spark, sf_dir).select(
        F.col("gid").alias("tid"), "start_time", "end_time", "n_ticks", F.col("mins")[0].cast("double").alias("low"),
        F.col("maxs")[0].cast("double").alias("high"), F.col("sums")[0].alias("total"))


@add("compress", invariants("pts_smooth"))
def compress_points(spark, sf_dir):
    p = fx.points(spark, sf_dir, "pts_smooth")
    return check(p, compress(p, 1.0, si_ms=2000), 1.0)


@add("compress_gaps", invariants("pts_ship"))
def compress_gaps(spark, sf_dir):
    """Runs end at gaps: no segment covers a tick without a point."""
    p = fx.points(spark, sf_dir, "pts_ship")
    return check(p, compress(p, 10.0, si_ms=fx.SI["pts_ship"]), 10.0)


@add("compression_ratio", sql("pts_smooth", body=f"SELECT tid, count(*) points, true above_one, true factor_matches FROM pts_smooth GROUP BY tid"))
def compression_ratio(spark, sf_dir):
    """Per series: the ratio of its segments, and the factor recomputed from the single ratios."""
    g = fx.store(spark, sf_dir, "pts_smooth", 5.0)
    sizes = quality.model_sizes(g, ["gid"])
    single = g.groupBy("gid").agg((F.sum(F.col("n_ticks") * 16) / F.sum(F.col("n_ticks") * 16 / quality.compression_ratio())).alias("again"))
    return sizes.join(single, "gid").select(
        F.col("gid").alias("tid"), "points", (F.col("compression_factor") > 1).alias("above_one"),
        (F.abs(F.col("compression_factor") - F.col("again")) < 1e-9).alias("factor_matches"))


SWEEP = (0.0, 0.01, 0.05, 5.0)


@add("error_bound_sweep", sql("pts_smooth", body="""SELECT eps, tid, count(*) n_points, CAST(0 AS BIGINT) n_missing, CAST(0 AS BIGINT) n_extra,
 CAST(0 AS BIGINT) n_violations FROM pts_smooth, (SELECT CAST(unnest([0, 0.01, 0.05, 5]) AS DOUBLE) eps) GROUP BY 1, 2"""))
def error_bound_sweep(spark, sf_dir):
    p = fx.points(spark, sf_dir, "pts_smooth")
    g = fx.store(spark, sf_dir, "pts_smooth", SWEEP)
    approx = view.points(g, keep=["eps"])
    real = p.select(F.explode(F.array(*map(F.lit, SWEEP))).alias("eps"), "*")
    aligned = quality.align(real, approx, ["eps", "tid"])
    return aligned.groupBy("eps", "tid").agg(
        F.count("real").alias("n_points"), F.count_if(F.col("approx").isNull()).alias("n_missing"),
        F.count_if(F.col("real").isNull()).alias("n_extra"), F.count_if(quality.error() > F.col("eps")).alias("n_violations"))


def grouped(spark, sf_dir):
    return fx.series_ship(spark, sf_dir).drop("gid").withColumnRenamed("region_gid", "gid")


def group_store(spark, sf_dir, eps, **options):
    def build(path):
        g = compress_groups(fx.points(spark, sf_dir, "pts_ship"), grouped(spark, sf_dir), eps=eps, **options)
        stores.write_segments(g, path, "year")
    path = fx.once(spark, (sf_dir, "groups", eps, repr(options)), "segments-groups", build)
    return stores.read_segments(spark, path, period="year")


@add("compress_groups", invariants("pts_ship"))
def compress_grouped(spark, sf_dir):
    return check(fx.points(spark, sf_dir, "pts_ship"), group_store(spark, sf_dir, 10.0), 10.0)


@add("compress_groups_split", invariants("pts_ship"))
def compress_split(spark, sf_dir):
    """Chunks are stored by correlated sub-group where that beats the whole group."""
    return check(fx.points(spark, sf_dir, "pts_ship"), group_store(spark, sf_dir, 10.0, split_fraction=1.0), 10.0)


# Repeatedly the smallest remaining series leads; those within 2 * 10 % of it at all shared ticks follow.
LEADERS = """SELECT region_gid, 0 step, CAST(NULL AS INT) leader, CAST([] AS INT[]) taken, list(DISTINCT tid) remaining, CAST([] AS INT[]) got
 FROM ship GROUP BY 1 UNION ALL SELECT region_gid, step + 1, lead, list_concat(taken, got2), list_filter(remaining, lambda t: NOT list_contains(got2, t)), got2
 FROM (SELECT r.region_gid, r.step, r.taken, r.remaining, list_min(r.remaining) lead,
 list_filter(r.remaining, lambda t: t = list_min(r.remaining) OR NOT list_contains(b.far, list_min(r.remaining) * 1000 + t)) got2
 FROM l r JOIN apart b USING (region_gid) WHERE len(r.remaining) > 0)"""


def leaders(ship):
    """Tables of SQL: the members that are apart at a tick of `ship`, then the leaders of its groups."""
    return {"ship": ship, "apart": """SELECT region_gid, list_concat(list(DISTINCT far) FILTER (WHERE far IS NOT NULL), [CAST(-1 AS INT)]) far FROM (
 SELECT a.region_gid, CASE WHEN abs((CAST(b.value AS DOUBLE) - a.value) / b.value) * 100 > 20 THEN a.tid * 1000 + b.tid END far
 FROM ship a JOIN ship b ON a.region_gid = b.region_gid AND a.ts = b.ts) GROUP BY 1""", "l": LEADERS}


@add("correlated_subgroups", sql("pts_ship", "series_ship", recursive=True,
     **leaders("SELECT p.*, region_gid FROM pts_ship p JOIN series_ship USING (tid)"),
     body="""SELECT region_gid gid, unnest(got) tid, leader FROM l WHERE step > 0"""))
def subgroups(spark, sf_dir):
    """Sub-groups over the whole time, from what the chunks tell about each pair."""
    return lasting_subgroups(fx.points(spark, sf_dir, "pts_ship"), grouped(spark, sf_dir), 10.0).select("gid", "tid", "leader")


PER_CHUNK = 320  # points: 64 days of the five members of a region


@add("rejoined_subgroups", sql("pts_ship", "series_ship", recursive=True,
     **leaders("""SELECT p.tid, p.ts, p.value, CAST(region_gid * 100000 + epoch_ms(ts) // 5529600000 AS INT) region_gid
 FROM pts_ship p JOIN series_ship USING (tid)"""),
     follows="SELECT CAST(region_gid // 100000 AS INT) gid, CAST(region_gid % 100000 AS BIGINT) chunk, unnest(got) tid, leader FROM l WHERE step > 0",
     islands="SELECT *, chunk - row_number() OVER (PARTITION BY gid, tid, leader ORDER BY chunk) island FROM follows",
     body="""SELECT gid, tid, leader, min(chunk) first_chunk, max(chunk) last_chunk, count(*) n_chunks FROM islands GROUP BY gid, tid, leader, island"""))
def rejoined(spark, sf_dir):
    """When members follow which leader, chunk by chunk."""
    return rejoined_subgroups(fx.points(spark, sf_dir, "pts_ship"), grouped(spark, sf_dir), 10.0, PER_CHUNK)


@add("explode_groups", sql("pts_ship", body="SELECT tid, count(*) n_points, true placed FROM pts_ship GROUP BY tid"))
def explode_groups(spark, sf_dir):
    """Members of group segments: lengths add up and positions follow the order of tids."""
    m = view.members(group_store(spark, sf_dir, 10.0))
    placed = F.bool_and((F.col("pos") < F.col("width")) & (F.col("skip") == 0))
    return m.groupBy("tid").agg(F.sum("n_ticks").alias("n_points"), placed.alias("placed"))


# ---- views ----

def _plain(points):
    return points.select("tid", "ts", F.col("value").cast("double").alias("value"))


@add("reconstruct_lossless", sql("pts_seq", body=f"SELECT tid, ts, {V} AS value FROM pts_seq"))
def reconstruct_lossless(spark, sf_dir):
    return _plain(view.points(fx.store(spark, sf_dir, "pts_seq")))


@add("reconstruct_bounded", invariants("pts_smooth"))
def reconstruct_bounded(spark, sf_dir):
    return check(fx.points(spark, sf_dir, "pts_smooth"), fx.store(spark, sf_dir, "pts_smooth", 5.0), 5.0)


@add("count_points", sql("pts_smooth", body="SELECT count(*) n FROM pts_smooth"))
def count_points(spark, sf_dir):
    return view.count_points(fx.store(spark, sf_dir, "pts_smooth", 5.0))


@add("project_dims", sql("pts_seq", "series_seq", body="SELECT region, nation, tid, ts, CAST(CAST(value AS FLOAT) / scaling AS DOUBLE) AS value FROM pts_seq JOIN series_seq USING (tid)"))
def project_dims(spark, sf_dir):
    d = view.points(fx.store(spark, sf_dir, "pts_seq"), fx.series_seq(spark, sf_dir))
    return d.select("region", "nation", "tid", "ts", F.col("value").cast("double").alias("value"))


CHUNK_MS = CHUNK_TICKS * fx.SI["pts_seq"]  # no segment of this store covers more


def _filter(name, condition, table="pts_seq"):
    return add(name, sql(table, body=f"SELECT tid, ts, {V} AS value FROM {table} WHERE {condition}"))


def _of_tids(spark, sf_dir, tids):
    gids = view.gids_of(fx.stored_series(spark, sf_dir), tids)
    return _plain(view.points(fx.store(spark, sf_dir, "pts_seq"), tids=tids, gids=gids))


@_filter("filter_tid_eq", "tid = 7")
def filter_tid_eq(spark, sf_dir):
    return _of_tids(spark, sf_dir, [7])


@_filter("filter_tid_in", "tid IN (1, 3, 8)")
def filter_tid_in(spark, sf_dir):
    return _of_tids(spark, sf_dir, [1, 3, 8])


def _by_series(spark, sf_dir, condition):
    series = fx.series_seq(spark, sf_dir).withColumn("scaling", F.lit(1.0))
    return _plain(view.points_by_member(fx.store(spark, sf_dir, "pts_seq"), series, condition))


@_filter("filter_tid_range", "tid > 3 AND tid <= 9")
def filter_tid_range(spark, sf_dir):
    return _by_series(spark, sf_dir, (F.col("tid") > 3) & (F.col("tid") <= 9))


@_filter("filter_tid_missing", "tid = 123456789")
def filter_tid_missing(spark, sf_dir):
    return _of_tids(spark, sf_dir, [123456789])


@_filter("filter_ts_range", "ts > TIMESTAMP '2024-01-01 00:03:00' AND ts <= TIMESTAMP '2024-01-01 00:10:01'")
def filter_ts_range(spark, sf_dir):
    d = view.points(fx.store(spark, sf_dir, "pts_seq"), ts_from="2024-01-01 00:03:00", ts_to="2024-01-01 00:10:01", longest_ms=CHUNK_MS)
    return _plain(d.where(F.col("ts") > F.lit("2024-01-01 00:03:00").cast("timestamp")))


@_filter("filter_ts_point", "ts = TIMESTAMP '2024-01-01 00:05:00'")
def filter_ts_point(spark, sf_dir):
    at = "2024-01-01 00:05:00"
    return _plain(view.points(fx.store(spark, sf_dir, "pts_seq"), ts_from=at, ts_to=at, longest_ms=CHUNK_MS))


@add("segment_scan_range", sql("pts_ship", blocks=BLOCKS, s=XOR_SEGMENTS, body="""SELECT tid, start_time, end_time, n_ticks FROM s
 WHERE start_time >= TIMESTAMP '1996-02-01' AND end_time <= TIMESTAMP '1998-06-30'"""))
def segment_scan_range(spark, sf_dir):
    d = stores.scan_range(xor_store(spark, sf_dir), "year", "1996-02-01", "1998-06-30")
    return d.select(F.col("gid").alias("tid"), "start_time", "end_time", "n_ticks")


@add("filter_member", sql("pts_seq", "series_seq", body=f"SELECT tid, ts, {V} AS value FROM pts_seq JOIN series_seq USING (tid) WHERE region = 'ASIA'"))
def filter_member(spark, sf_dir):
    return _by_series(spark, sf_dir, F.col("region") == "ASIA")


@_filter("filter_value_nonzero", "value <> 0", "pts_cnt")
def filter_value_nonzero(spark, sf_dir):
    return _plain(view.points(fx.store(spark, sf_dir, "pts_cnt"))).where("value <> 0")


@_filter("filter_value_range", "value >= 60000 AND value <= 70000", "pts_smooth")
def filter_value_range(spark, sf_dir):
    """Segments are skipped by their extremes before they are decoded."""
    return _plain(view.points(fx.store(spark, sf_dir, "pts_smooth"), low=60_000, high=70_000))


@_filter("filter_and_or", "(tid = 2 OR ts < TIMESTAMP '2024-01-01 00:01:00') AND NOT (value < 5000 AND tid > 50)")
def filter_and_or(spark, sf_dir):
    """Segments that neither belong to series 2 nor begin early are not read."""
    wanted = view.touches(view.gids_of(fx.stored_series(spark, sf_dir), [2])) | view.touches(ts_to="2024-01-01 00:01:00")
    d = _plain(view.points(fx.store(spark, sf_dir, "pts_seq").where(wanted)))
    early = F.col("ts") < F.lit("2024-01-01 00:01:00").cast("timestamp")
    return d.where(((F.col("tid") == 2) | early) & ~((F.col("value") < 5000) & (F.col("tid") > 50)))


# segments clipped to [from, to]: the ticks of a segment that the point filter keeps
CLIPPED = """SELECT tid, min(ts) FILTER (WHERE {0}) start_time, max(ts) FILTER (WHERE {0}) end_time, CAST(count(*) FILTER (WHERE {0}) AS INT) n_ticks,
 CAST(count(*) AS INT) n_stored, CAST(count(*) FILTER (WHERE NOT ({0}) AND ts < TIMESTAMP '1997-01-01') AS INT) skip
 FROM blocks GROUP BY tid, chunk, run, block HAVING count(*) FILTER (WHERE {0}) > 0"""


def _clip(name, condition, **bounds):
    @add(name, sql("pts_ship", blocks=BLOCKS, body=CLIPPED.format(condition)))
    def clip(spark, sf_dir):
        d = view.clip(view.members(xor_store(spark, sf_dir)), **bounds)
        return d.select("tid", "start_time", "end_time", "n_ticks", "n_stored", "skip")


_clip("clip_start", "ts >= TIMESTAMP '1996-12-24 07:30:00'", ts_from="1996-12-24 07:30:00")
_clip("clip_end", "ts <= TIMESTAMP '1998-03-03 07:30:00'", ts_to="1998-03-03 07:30:00")
_clip("clip_interval", "ts BETWEEN TIMESTAMP '1996-12-24 07:30:00' AND TIMESTAMP '1998-03-03 07:30:00'",
      ts_from="1996-12-24 07:30:00", ts_to="1998-03-03 07:30:00")


@add("points_of_series", sql("pts_ev", "series_ev", body=f"SELECT ts, {V} AS value FROM pts_ev JOIN series_ev USING (tid) WHERE source = 'click'"))
def points_of_series(spark, sf_dir):
    series = fx.series_ev(spark, sf_dir).withColumn("scaling", F.lit(1.0))
    return _plain(view.points_by_member(fx.store(spark, sf_dir, "pts_ev"), series, F.col("source") == "click")).select("ts", "value")


@add("point_topk", sql("pts_seq", body=f"SELECT tid, ts, {V} AS value FROM pts_seq WHERE tid = 1 ORDER BY ts LIMIT 10"))
def point_topk(spark, sf_dir):
    return _of_tids(spark, sf_dir, [1]).orderBy("ts").limit(10)


# ---- stores ----

@add("segment_sink_roundtrip", invariants("pts_ship"))
def segment_sink_roundtrip(spark, sf_dir):
    """Two appends of an ORC store: even and odd groups."""
    path = work_dir(spark, "sink")
    g = xor_store(spark, sf_dir).drop("period")
    stores.write_segments(g.where("gid % 2 = 0"), path, "year", "orc")
    stores.write_segments(g.where("gid % 2 = 1"), path, "year", "orc")
    return check(fx.points(spark, sf_dir, "pts_ship"), stores.read_segments(spark, path, "orc", "year"), 0.0)


@add("compact_segments", invariants("pts_ship"))
def compact_segments(spark, sf_dir):
    path, target = work_dir(spark, "small-files"), work_dir(spark, "compacted")
    stores.write_segments(xor_store(spark, sf_dir).drop("period").repartition(16, "gid", "start_time"), path, "year")
    stores.compact(spark, path, target, 4, "year")
    return check(fx.points(spark, sf_dir, "pts_ship"), stores.read_segments(spark, target, period="year"), 0.0)


MERGED = """SELECT tid, gid, count(*) n, round(sum(CAST(value AS DOUBLE)), 4) total FROM (
 SELECT tid, tid gid, value FROM pts_ev UNION ALL
 SELECT tid + (SELECT max(tid) FROM series_ev), tid + (SELECT max(tid) FROM series_ev), value FROM pts_ship) GROUP BY 1, 2"""


@add("merge_stores", sql("pts_ev", "pts_ship", "series_ev", body=MERGED))
def merge_stores(spark, sf_dir):
    types = spark.createDataFrame(list(schema.MODEL_NAMES.items()), "mtid int, name string")
    stores.check_model_types(types, types)
    series, groups = stores.merge_stores(
        fx.series_ev(spark, sf_dir), fx.store(spark, sf_dir, "pts_ev"),
        fx.series_ship(spark, sf_dir).drop("region_gid"), fx.store(spark, sf_dir, "pts_ship"))
    d = view.points(groups).join(series.select("tid", "gid"), "tid")
    return d.groupBy("tid", "gid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(aggregate.value()), 4).alias("total"))


@add("dedup_segments", invariants("pts_ship"))
def dedup_segments(spark, sf_dir):
    g = xor_store(spark, sf_dir)
    return check(fx.points(spark, sf_dir, "pts_ship"), stores.deduplicate(stores.union_stores(g, g)), 0.0)


@add("stored_bytes")
def stored_bytes(spark, sf_dir):
    return stores.stored_bytes(spark, sf_dir, "*.parquet")


# ---- joins ----

RANGES = """SELECT o_orderkey range_id, CAST(o_orderdate AS TIMESTAMP) range_start, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 3 DAY range_end
 FROM orders"""
YEAR_MS = 31_536_000_000


@add("interval_overlap_join", sql("pts_ship", blocks=BLOCKS, s=XOR_SEGMENTS, ranges=RANGES, body="""SELECT range_id, count(*) segments,
 CAST(sum(n_ticks) AS BIGINT) ticks, count(DISTINCT tid) series FROM s JOIN ranges ON start_time <= range_end AND end_time >= range_start GROUP BY 1"""))
def interval_overlap_join(spark, sf_dir):
    start = F.col("o_orderdate").cast("timestamp")
    orders = fx.load(spark, sf_dir, "orders").select("o_orderkey", start.alias("range_start"))
    # orders of one day ask the same: each distinct range is met once, then handed to its orders
    ranges = orders.select("range_start", (F.col("range_start") + F.expr("INTERVAL 3 DAYS")).alias("range_end")).distinct()
    m = view.members(xor_store(spark, sf_dir)).select("tid", "start_time", "end_time", "n_ticks")
    met = view.overlapping(m, ranges, 30 * 86_400_000, salts=4).groupBy("range_start").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("n_ticks").alias("ticks"), F.countDistinct("tid").alias("series"))
    return orders.join(met, "range_start").select(F.col("o_orderkey").alias("range_id"), "segments", "ticks", "series")


REQUESTS = """SELECT DISTINCT CAST(c_nationkey + 1 AS INT) tid, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) ts
 FROM orders JOIN customer ON o_custkey = c_custkey"""


@add("point_lookup", sql("pts_ship", requests=REQUESTS, body=f"SELECT r.tid, r.ts, {V} AS value FROM requests r LEFT JOIN pts_ship p ON p.tid = r.tid AND p.ts = r.ts"))
def point_lookup(spark, sf_dir):
    customer = fx.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    requests = fx.load(spark, sf_dir, "orders").join(customer, "o_custkey").select(
        (F.col("c_nationkey") + 1).cast("int").alias("tid"),
        F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("ts")).distinct()
    return _plain(view.point_lookup(view.members(fx.store(spark, sf_dir, "pts_ship")), requests, 30 * 86_400_000))


# ---- aggregates on segments ----

def seg(spark, sf_dir, name="pts_seq"):
    return view.members(fx.store(spark, sf_dir, name))


SEG_AGGS = {"count_s": ("count", "count(*)", 0), "min_s": ("min", f"min({V})", 6), "max_s": ("max", f"max({V})", 6),
            "sum_s": ("sum", f"sum({V})", 3), "avg_s": ("avg", f"avg({V})", 6)}


def _register_segment_aggregates():
    for name, (agg, expression, digits) in SEG_AGGS.items():
        text = expression if agg == "count" else f"round({expression}, {digits})"

        def whole(spark, sf_dir, agg=agg, digits=digits):
            d = aggregate.agg_segments(seg(spark, sf_dir), aggs=[agg])
            return d if agg == "count" else d.select(dbl(agg, digits))

        CATALOG.queries[name] = whole
        CATALOG.oracles[name] = sql("pts_seq", body=f"SELECT {text} AS {agg} FROM pts_seq")


_register_segment_aggregates()
ALL = f'count(*) "count", round(min({V}), 6) "min", round(max({V}), 6) "max", round(sum({V}), 4) "sum", round(avg({V}), 6) "avg"'


def _rounded(d, *keys):
    return d.select(*keys, "count", dbl("min"), dbl("max"), dbl("sum", 4), dbl("avg"))


@add("sum_s_by_tid", sql("pts_ev", body=f"SELECT tid, {ALL} FROM pts_ev GROUP BY tid"))
def sum_s_by_tid(spark, sf_dir):
    return _rounded(aggregate.agg_segments(seg(spark, sf_dir, "pts_ev"), ["tid"]), "tid")


@add("agg_s_scaled", sql("pts_ev", "series_ev", body=f"SELECT tid, round(sum({V} / scaling), 4) total, round(max({V} / scaling), 6) high FROM pts_ev JOIN series_ev USING (tid) GROUP BY tid"))
def agg_s_scaled(spark, sf_dir):
    d = seg(spark, sf_dir, "pts_ev").join(fx.series_ev(spark, sf_dir).select("tid", "scaling"), "tid")
    d = aggregate.agg_segments(d, ["tid"], ["sum", "max"], scaling=F.col("scaling"))
    return d.select("tid", F.round("sum", 4).alias("total"), F.round("max", 6).alias("high"))


@add("rollup_members", sql("pts_seq", "series_seq", body=f"SELECT region, nation, {ALL.replace('4)', '3)')} FROM pts_seq JOIN series_seq USING (tid) GROUP BY ROLLUP (region, nation)"))
def rollup_members(spark, sf_dir):
    d = aggregate.rollup_segments(seg(spark, sf_dir), fx.series_seq(spark, sf_dir), ["region", "nation"])
    return d.select("region", "nation", "count", dbl("min"), dbl("max"), dbl("sum", 3), dbl("avg"))


@add("segment_point_equivalence", sql("pts_seq", body="SELECT tid, true equivalent FROM pts_seq GROUP BY tid"))
def segment_point_equivalence(spark, sf_dir):
    g = fx.store(spark, sf_dir, "pts_seq")
    by_segment = aggregate.agg_segments(view.members(g), ["tid"])
    v = aggregate.value()
    by_point = aggregate.point_aggregate(view.points(g), ["tid"], n=F.count(F.lit(1)), low=F.min(v), high=F.max(v),
                                         total=F.sum(v), mean=F.avg(v))
    def close(a, b):
        return F.col(a).cast("float") == F.col(b).cast("float")
    same = (F.col("count") == F.col("n")) & close("min", "low") & close("max", "high") & close("sum", "total") & close("avg", "mean")
    return by_segment.join(by_point, "tid").select("tid", same.alias("equivalent"))


@add("sum_s_range", sql("pts_ship", body=f"SELECT tid, {ALL} FROM pts_ship WHERE ts BETWEEN TIMESTAMP '1996-12-24 07:30:00' AND TIMESTAMP '1998-03-03 07:30:00' GROUP BY tid"))
def sum_s_range(spark, sf_dir):
    d = view.clip(seg(spark, sf_dir, "pts_ship"), "1996-12-24 07:30:00", "1998-03-03 07:30:00")
    return _rounded(aggregate.agg_segments(d, ["tid"], clipped=True), "tid")


@add("group_agg_s", sql("pts_ship", body=f"SELECT tid, {ALL} FROM pts_ship GROUP BY tid"))
def group_agg_s(spark, sf_dir):
    """The same aggregates from lossless group segments."""
    return _rounded(aggregate.agg_segments(view.members(group_store(spark, sf_dir, 0.0)), ["tid"]), "tid")


@add("sql_views", sql("pts_ev", "series_ev", body=f"""SELECT source, count(*) n, round(max({V} / scaling) FILTER (WHERE value / scaling > 0), 4) high,
 round(sum({V} / scaling), 3) total, count(*) n_s, round(sum({V} / scaling), 3) total_s, round(min({V} / scaling), 4) low_s
 FROM pts_ev JOIN series_ev USING (tid) GROUP BY source"""))
def sql_views(spark, sf_dir):
    """SQL over both views: the point route and the segment route side by side."""
    view.register_views(fx.store(spark, sf_dir, "pts_ev"), fx.series_ev(spark, sf_dir))
    return spark.sql("""
        SELECT source, n, high, total, n_s, total_s, low_s
        FROM (SELECT source, count(*) n, round(max(CASE WHEN value > 0 THEN cast(value AS double) END), 4) high,
                     round(sum(cast(value AS double)), 3) total FROM datapoint GROUP BY source)
        JOIN (SELECT source, sum(n_ticks) n_s, round(sum(vsum), 3) total_s, round(min(vmin), 4) low_s FROM segment GROUP BY source)
        USING (source)""")


SQL_RANGE = "ts > TIMESTAMP '2024-01-01 00:03:00' AND ts <= TIMESTAMP '2024-01-01 00:10:01' AND tid IN (2, 5)"


@add("sql_datapoint_range", sql("pts_seq", "series_seq", body=f"""SELECT tid, count(*) n, round(sum({V} / scaling), 3) total, round(max({V} / scaling), 4) high
 FROM pts_seq JOIN series_seq USING (tid) WHERE {SQL_RANGE} GROUP BY tid"""))
def sql_datapoint_range(spark, sf_dir):
    """SQL over views with bounds: other groups and periods are not read."""
    view.register_views(fx.store(spark, sf_dir, "pts_seq"), fx.series_seq(spark, sf_dir), tids=[2, 5], ts_from="2024-01-01 00:03:00",
                        ts_to="2024-01-01 00:10:01", longest_ms=CHUNK_MS)
    return spark.sql(f"""SELECT tid, count(*) n, round(sum(cast(value AS double)), 3) total, round(max(cast(value AS double)), 4) high
                         FROM datapoint WHERE {SQL_RANGE} GROUP BY tid""")


@add("sql_segment_range", sql("pts_ship", "series_ship", body=f"""SELECT nation, count(*) n, round(sum({V}), 3) total, round(min({V}), 4) low, round(max({V}), 4) high
 FROM pts_ship JOIN series_ship USING (tid) WHERE tid IN (1, 4, 9) AND ts BETWEEN TIMESTAMP '1996-12-24' AND TIMESTAMP '1998-03-03' GROUP BY nation"""))
def sql_segment_range(spark, sf_dir):
    """The segment route of START_END bounds in SQL."""
    view.register_views(fx.store(spark, sf_dir, "pts_ship"), fx.series_ship(spark, sf_dir), tids=[1, 4, 9], ts_from="1996-12-24", ts_to="1998-03-03")
    return spark.sql("""SELECT nation, sum(n_ticks) n, round(sum(vsum), 3) total, round(min(vmin), 4) low, round(max(vmax), 4) high
                        FROM segment GROUP BY nation""")


# ---- calendar ----

UNIT_SQL = {
    "year": "year(ts)", "month": "month(ts) - 1", "day_of_month": "day(ts)", "am_pm": "hour(ts) // 12", "hour": "hour(ts) % 12",
    "hour_of_day": "hour(ts)", "minute": "minute(ts)", "second": "second(ts)"}
# units finer than a day are exercised on the 2 s and hourly series
UNIT_POINTS = {"year": "pts_ship", "month": "pts_ship", "day_of_month": "pts_ship", "am_pm": "pts_ev", "hour": "pts_ev",
               "hour_of_day": "pts_ev", "minute": "pts_seq", "second": "pts_seq"}


def _register_calendar():
    for unit in UNITS:
        table = UNIT_POINTS[unit]
        for agg in aggregate.AGGREGATES:
            digits = 4 if agg == "sum" else 6
            expression = "count(*)" if agg == "count" else f"round({agg}({V}), {digits})"

            def query(spark, sf_dir, agg=agg, unit=unit, table=table, digits=digits):
                d = aggregate.calendar_agg(seg(spark, sf_dir, table), agg, unit, ["tid"])
                return d if agg == "count" else d.select("tid", "field", dbl(agg, digits))

            name = f"{agg}_cal_{unit}"
            CATALOG.queries[name] = query
            CATALOG.oracles[name] = sql(table, body=f'SELECT tid, CAST({UNIT_SQL[unit]} AS INT) field, {expression} AS "{agg}" FROM {table} GROUP BY 1, 2')


_register_calendar()


def _register_group_calendar():
    for unit in ("year", "month", "day_of_month", "minute"):
        def query(spark, sf_dir, unit=unit):
            return _rounded(aggregate.agg_groups(group_store(spark, sf_dir, 0.0), unit=unit), "tid", "field")

        CATALOG.queries[f"groups_cal_{unit}"] = query
        CATALOG.oracles[f"groups_cal_{unit}"] = sql("pts_ship", body=f"SELECT tid, CAST({UNIT_SQL[unit]} AS INT) field, {ALL} FROM pts_ship GROUP BY 1, 2")


_register_group_calendar()


@add("groups_range_s", sql("pts_ship", body=f"SELECT tid, {ALL} FROM pts_ship WHERE ts BETWEEN TIMESTAMP '1996-12-24 07:30:00' AND TIMESTAMP '1998-03-03 07:30:00' GROUP BY tid"))
def groups_range_s(spark, sf_dir):
    """A range of group segments: those at its ends are decoded once for all members."""
    d = view.clip(view.with_offsets(group_store(spark, sf_dir, 0.0)), "1996-12-24 07:30:00", "1998-03-03 07:30:00")
    return _rounded(aggregate.agg_groups(d), "tid")


@add("sql_cal_views", sql("pts_ship", "series_ship", body=f"""SELECT a.tid, a.field, n AS "count", total AS "sum" FROM
 (SELECT tid, year(ts) field, count(*) n, round(sum({V}), 3) total FROM pts_ship GROUP BY 1, 2) a WHERE a.tid IN (SELECT tid FROM series_ship)"""))
def sql_cal_views(spark, sf_dir):
    """Calendar aggregates by their SQL names."""
    view.register_calendar_views(fx.store(spark, sf_dir, "pts_ship"), fx.series_ship(spark, sf_dir), ["year"], ["count", "sum"])
    return spark.sql("SELECT tid, field, count, round(sum, 3) AS sum FROM cal_count_year JOIN cal_sum_year USING (tid, field)")


@add("count_cal_map", sql("pts_ev", body="""SELECT tid, string_agg(field || ':' || n, ',' ORDER BY field) fields FROM (
 SELECT tid, hour(ts) field, count(*) n FROM pts_ev GROUP BY 1, 2) GROUP BY tid"""))
def count_cal_map(spark, sf_dir):
    d = aggregate.calendar_agg(seg(spark, sf_dir, "pts_ev"), "count", "hour_of_day", ["tid"], as_map=True)
    text = F.array_join(F.transform(F.map_entries("count"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return d.select("tid", text.alias("fields"))


# ---- SQL table functions ----

BETWEEN = "ts BETWEEN TIMESTAMP '1996-12-24 07:30:00' AND TIMESTAMP '1998-03-03 07:30:00'"
ARGUMENTS = "p_from => TIMESTAMP '1996-12-24 07:30:00', p_to => TIMESTAMP '1998-03-03 07:30:00'"
FUNCTIONS = {"count_s": "count(*)", "min_s": "min(CAST(value AS DOUBLE))", "max_s": "max(CAST(value AS DOUBLE))", "sum_s": "sum(CAST(value AS DOUBLE))",
             "avg_s": "avg(CAST(value AS DOUBLE))"}


@add("sql_functions", sql("pts_ship", body=" UNION ALL ".join(
     f"SELECT '{name}' AS function, tid, round(CAST({aggregate} AS DOUBLE), 6) result FROM pts_ship WHERE {BETWEEN} GROUP BY tid" for name, aggregate in FUNCTIONS.items())))
def sql_functions(spark, sf_dir):
    """Every aggregate as a SQL table function with its bounds as SQL arguments."""
    view.register_functions(xor_store(spark, sf_dir))
    return spark.sql(" UNION ALL ".join(f"SELECT '{name}' AS function, tid, round(cast(result AS double), 6) result FROM {name}({ARGUMENTS})" for name in FUNCTIONS))


@add("sql_datapoints", sql("pts_ship", body=f"SELECT tid, ts, {V} AS value FROM pts_ship WHERE tid IN (3, 4, 9) AND {BETWEEN}"))
def sql_datapoints(spark, sf_dir):
    view.register_functions(xor_store(spark, sf_dir))
    return spark.sql(f"SELECT tid, ts, cast(value AS double) AS value FROM datapoints(p_tids => array(3, 4, 9), {ARGUMENTS})")


@add("sql_segments", sql("pts_ship", blocks=BLOCKS, body=f"""SELECT tid, min(ts) start_time, max(ts) end_time, CAST(count(*) AS INT) n_ticks
 FROM blocks WHERE {BETWEEN} GROUP BY tid, chunk, run, block"""))
def sql_segments(spark, sf_dir):
    view.register_functions(xor_store(spark, sf_dir))
    return spark.sql(f"SELECT tid, start_time, end_time, n_ticks FROM segments({ARGUMENTS})")
