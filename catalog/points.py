"""Sources, regularisation and aggregates on points."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import Catalog, dbl, sql
from tidegauge.functions.errors import percentage_error
from tidegauge.operators import aggregate, regularize as rg, view
from tidegauge.operators.compress import compress
from tidegauge.session import work_dir, written
from tidegauge.sources import dimensions, readings

CATALOG = Catalog()
add = CATALOG.add

PLAIN = "SELECT tid, ts, CAST(value AS DOUBLE) AS value FROM {}"


def _plain(points):
    return points.select("tid", "ts", F.col("value").cast("double").alias("value"))


# ---- sources ----

def _as_files(spark, sf_dir, file_format):
    """The hourly event series, one folder of files per series."""
    named = fx.points(spark, sf_dir, "pts_ev").join(fx.series_ev(spark, sf_dir).select("tid", "source"), "tid").drop("tid")
    path = work_dir(spark, f"readings-{file_format}")
    if file_format == "csv":
        named.select("source", F.unix_millis("ts").alias("ms"), "value").write.partitionBy("source").csv(path, compression="gzip")
    else:
        named.write.partitionBy("source").format(file_format).save(path)
    return path


def _numbered(read):
    return _plain(readings.assign_tids(read, readings.number_sources(read)))


@add("read_csv_readings", sql("pts_ev", body=PLAIN.format("pts_ev")))
def read_csv_readings(spark, sf_dir):
    return _numbered(readings.read_csv(spark, _as_files(spark, sf_dir, "csv"), date_format="java"))


@add("read_orc_readings", sql("pts_ev", body=PLAIN.format("pts_ev")))
def read_orc_readings(spark, sf_dir):
    return _numbered(readings.read_orc(spark, _as_files(spark, sf_dir, "orc")))


@add("read_parquet_readings", sql("pts_ev", body=PLAIN.format("pts_ev")))
def read_parquet_readings(spark, sf_dir):
    return _numbered(readings.read_parquet(spark, _as_files(spark, sf_dir, "parquet")))


@add("assign_tids", """SELECT CAST(dense_rank() OVER (ORDER BY s_name) AS INT) tid, s_name AS source FROM supplier""")
def assign_tids(spark, sf_dir):
    return readings.number_sources(fx.load(spark, sf_dir, "supplier").withColumnRenamed("s_name", "source")).select("tid", "source")


_WIDE = """SELECT CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) datetime, sum(l_quantity) quantity,
 max(l_extendedprice) price, count(*) n FROM lineitem GROUP BY 1"""


@add("unpivot_signals", sql(wide=_WIDE, body="""SELECT datetime ts, 'quantity' AS source,
 CAST(CAST(quantity AS FLOAT) AS DOUBLE) AS value FROM wide
 UNION ALL SELECT datetime, 'price', CAST(CAST(price AS FLOAT) AS DOUBLE) FROM wide
 UNION ALL SELECT datetime, 'n', CAST(CAST(n AS FLOAT) AS DOUBLE) FROM wide"""))
def unpivot_signals(spark, sf_dir):
    day = F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("datetime")
    wide = fx.load(spark, sf_dir, "lineitem").groupBy(day).agg(
        F.sum("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("price"), F.count(F.lit(1)).alias("n"),
        F.max("l_linenumber").alias(readings.INDEX_NAME))
    return readings.unpivot_signals(wide).select("source", "ts", F.col("value").cast("double").alias("value"))


# one reading a minute, a hundredth without a number, one series not listed: what a store can take and what not
_RAW = """SELECT CAST(dense_rank() OVER (ORDER BY event_type) AS INT) tid, date_trunc('minute', ts) ts, CAST(CASE WHEN event_id % 97 = 0 THEN 'nan'::FLOAT
 ELSE value END AS FLOAT) AS value FROM events"""
_SPLIT = """SELECT tid, ts, value, CASE WHEN tid = 3 THEN 'unknown' WHEN isnan(value) THEN 'no number'
 WHEN row_number() OVER (PARTITION BY tid, ts, tid <> 3 AND NOT isnan(value) ORDER BY value) > 1 THEN 'repeated' END reason FROM raw"""


def _raw_readings(spark, sf_dir):
    ids = fx.series_ev(spark, sf_dir)
    value = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value")).cast("float")
    named = fx.events(spark, sf_dir).join(ids.select("tid", F.col("source").alias("event_type")), "event_type")
    return named.select("tid", F.date_trunc("minute", "ts").alias("ts"), value.alias("value")), ids.where("tid <> 3")


@add("reject_readings", sql(raw=_RAW, split=_SPLIT, body="SELECT tid, coalesce(reason, 'taken') reason, count(*) n FROM split GROUP BY 1, 2"))
def reject_readings(spark, sf_dir):
    """Repeated times, missing numbers and unlisted series are counted, none is lost."""
    taken, refused = rg.split_readings(*_raw_readings(spark, sf_dir))
    return taken.withColumn("reason", F.lit("taken")).unionByName(refused).groupBy("tid", "reason").agg(F.count(F.lit(1)).alias("n"))


@add("compress_taken", sql(raw=_RAW, split=_SPLIT, body="SELECT tid, ts, CAST(value AS DOUBLE) AS value FROM split WHERE reason IS NULL"))
def compress_taken(spark, sf_dir):
    """All readings that were taken come back from lossless segments."""
    points, series = _raw_readings(spark, sf_dir)
    taken, _ = rg.split_readings(points, series)
    minutes = series.withColumn("si_ms", F.lit(60_000).cast("long"))
    return _plain(view.points(compress(taken, series=minutes)))


_PIVOT = ", ".join(f"CAST(max(CASE WHEN tid = {i} THEN value END) AS DOUBLE) s{i}" for i in range(1, 6))


@add("pivot_signals", sql("pts_ev", body=f"SELECT ts, {_PIVOT} FROM pts_ev GROUP BY ts"))
def pivot_signals(spark, sf_dir):
    signals = [r.tid for r in fx.series_ev(spark, sf_dir).orderBy("tid").collect()]
    wide = readings.pivot_signals(fx.points(spark, sf_dir, "pts_ev"), signals)
    return wide.select("ts", *[F.col(str(i)).cast("double").alias(f"s{i}") for i in signals])


@add("load_dimensions", """SELECT s_name AS source, r_name AS region, n_name AS nation, CAST(s_suppkey AS INT) supplier
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def load_dimensions(spark, sf_dir):
    rows = fx.series_seq(spark, sf_dir).select(
        (F.col("tid") + 10).alias("line"), F.concat_ws(", ", "source", "region", "nation", F.col("tid").cast("string")).alias("value"))
    head = spark.createDataFrame([(0, "Location, Region string, Nation string"), (1, "Company, Supplier int, 2.0"), (2, "")],
                                 "line int, value string")
    path = work_dir(spark, "dimensions")
    # a dimension file is one ordered text file of series metadata
    head.unionByName(rows).repartition(1).sortWithinPartitions("line").select("value").write.text(path)
    return dimensions.load_dimensions(spark, path)[1]


@add("result_json", sql("pts_ev", body="""SELECT '{"tid":' || tid || ',"n":' || n || ',"day":"' || d || '"}' AS json
 FROM (SELECT tid, CAST(CAST(ts AS DATE) AS VARCHAR) d, count(*) n FROM pts_ev GROUP BY 1, 2)"""))
def result_json(spark, sf_dir):
    daily = fx.points(spark, sf_dir, "pts_ev").groupBy("tid", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return readings.result_json(daily.select("tid", "n", "day"))


# ---- regularisation ----

@add("regularize", """SELECT event_type, date_trunc('hour', ts) ts, CAST(CAST(max(value) AS FLOAT) AS DOUBLE) AS value,
 CAST(CAST(arg_max(value, ts) AS FLOAT) AS DOUBLE) last_value, CAST(count(*) AS DOUBLE) n FROM events GROUP BY 1, 2""")
def regularize(spark, sf_dir):
    ev = fx.events(spark, sf_dir)
    parts = [rg.regularize(ev, "event_type", "hour", how).withColumnRenamed("value", name)
             for how, name in (("max", "value"), ("last", "last_value"), ("count", "n"))]
    joined = parts[0].join(parts[1], ["event_type", "ts"]).join(parts[2], ["event_type", "ts"])
    return joined.select("event_type", "ts", *[F.col(c).cast("double").alias(c) for c in ("value", "last_value", "n")])


@add("infer_si", sql("pts_ev", body="""SELECT tid, CAST(arg_max(si, n * 1e15 - si) AS BIGINT) si_ms FROM (
 SELECT tid, si, count(*) n FROM (SELECT tid, epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY tid ORDER BY ts)) si
 FROM pts_ev) WHERE si IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""))
def infer_si(spark, sf_dir):
    return rg.infer_si(fx.points(spark, sf_dir, "pts_ev"))


@add("align_grid", sql("pts_ship", "series_ship", body="""SELECT s.region_gid gid, s.tid, g.ts, CAST(p.value AS DOUBLE) AS value
 FROM (SELECT region_gid, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) ts FROM (SELECT region_gid, min(ts) lo, max(ts) hi
 FROM pts_ship JOIN series_ship USING (tid) GROUP BY 1)) g JOIN series_ship s USING (region_gid)
 LEFT JOIN pts_ship p ON p.tid = s.tid AND p.ts = g.ts"""))
def align_grid(spark, sf_dir):
    series = fx.series_ship(spark, sf_dir).drop("gid").withColumnRenamed("region_gid", "gid")
    d = rg.align_grid(fx.points(spark, sf_dir, "pts_ship"), series, grid_ticks=512)
    return d.select("gid", "tid", "ts", F.col("value").cast("double").alias("value"))


@add("gap_intervals", sql("pts_ship", body="""SELECT tid, before + INTERVAL 1 DAY gap_start, ts - INTERVAL 1 DAY gap_end,
 CAST(date_diff('day', before, ts) - 1 AS BIGINT) missing FROM (SELECT tid, ts, lag(ts) OVER (PARTITION BY tid ORDER BY ts) before
 FROM pts_ship) WHERE date_diff('day', before, ts) > 1"""))
def gap_intervals(spark, sf_dir):
    return rg.gap_intervals(fx.points(spark, sf_dir, "pts_ship"), fx.SI["pts_ship"])


@add("gapfree_runs", sql("pts_ship", body="""SELECT tid, min(ts) run_start, max(ts) run_end, count(*) n FROM (
 SELECT tid, ts, sum(CASE WHEN date_diff('day', before, ts) = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY tid ORDER BY ts) run
 FROM (SELECT tid, ts, lag(ts) OVER (PARTITION BY tid ORDER BY ts) before FROM pts_ship)) GROUP BY tid, run"""))
def gapfree_runs(spark, sf_dir):
    return rg.gapfree_runs(fx.points(spark, sf_dir, "pts_ship"), fx.SI["pts_ship"])


def down_sql(picked):
    """Bins of k * 2 s, closed and labelled on the right, anchored at the first timestamp."""
    return f"""SELECT k AS factor, tid, s + to_seconds(CAST(2 * k * n AS BIGINT)) ts, CAST({picked} AS FLOAT) AS value FROM (
 SELECT k, p.tid, s, p.ts, value, ceil((epoch_ms(p.ts) - epoch_ms(s)) / (2000.0 * k)) n FROM pts_seq p
 JOIN (SELECT tid, min(ts) s FROM pts_seq GROUP BY tid) USING (tid), (SELECT unnest([3, 5, 15, 30, 300]) k)) GROUP BY k, tid, s, n"""


FACTORS = (3, 5, 15, 30, 300)
DOWN = "SELECT factor, tid, ts, round(CAST(value AS DOUBLE), 3) AS value FROM down"


def downsampled(spark, sf_dir, how="mean"):
    return rg.downsample(fx.points(spark, sf_dir, "pts_seq"), fx.SI["pts_seq"], FACTORS, how)


@add("downsample_mean", sql("pts_seq", down=down_sql("avg(CAST(value AS DOUBLE))"), body=DOWN))
def downsample_mean(spark, sf_dir):
    return downsampled(spark, sf_dir).select("factor", "tid", "ts", dbl("value", 3))


@add("downsample_last", sql("pts_seq", down=down_sql("arg_max(value, ts)"), body=DOWN))
def downsample_last(spark, sf_dir):
    return downsampled(spark, sf_dir, "last").select("factor", "tid", "ts", dbl("value", 3))


@add("downsample_rows", sql("pts_ev", body="""SELECT tid, max(ts) ts, round(CAST(CAST(avg(CAST(value AS DOUBLE)) AS FLOAT) AS DOUBLE), 4) AS value
 FROM (SELECT *, (row_number() OVER (PARTITION BY tid ORDER BY ts) - 1) // 7 w FROM pts_ev) GROUP BY tid, w"""))
def downsample_rows(spark, sf_dir):
    d = rg.downsample_rows(fx.points(spark, sf_dir, "pts_ev"), 7, bucket_ms=86_400_000)
    return d.select("tid", "ts", dbl("value", 4))


FILLED = """SELECT factor, tid, ts, value, last_value(approx IGNORE NULLS) OVER (PARTITION BY factor, tid ORDER BY ts) approx
 FROM (SELECT k factor, p.tid, p.ts, p.value, d.value approx FROM (SELECT pts_seq.*, unnest([3, 5, 15, 30, 300]) k FROM pts_seq) p
 LEFT JOIN down d ON d.factor = p.k AND d.tid = p.tid AND d.ts = p.ts)"""


def filled(spark, sf_dir):
    """Every raw point next to its downsampled value, filled forward, per factor."""
    return rg.ffill_join(fx.points(spark, sf_dir, "pts_seq"), downsampled(spark, sf_dir), ["factor", "tid"], bucket_ms=600_000, factors=FACTORS)


@add("ffill_join", sql("pts_seq", down=down_sql("avg(CAST(value AS DOUBLE))"), filled=FILLED, body="""SELECT factor, tid, ts,
 CAST(value AS DOUBLE) AS value, round(CAST(approx AS DOUBLE), 3) approx FROM filled"""))
def ffill_join(spark, sf_dir):
    return filled(spark, sf_dir).select("factor", "tid", "ts", F.col("value").cast("double").alias("value"), dbl("approx", 3))


@add("scaling_roundtrip", sql("pts_ev", "series_ev", body="""SELECT tid, ts, CAST(value * scaling AS DOUBLE) stored,
 CAST((value * scaling) / scaling AS DOUBLE) AS value FROM pts_ev JOIN series_ev USING (tid)"""))
def scaling_roundtrip(spark, sf_dir):
    series = fx.series_ev(spark, sf_dir)
    stored = rg.scale(fx.points(spark, sf_dir, "pts_ev"), series)
    back = rg.unscale(stored, series)
    return stored.withColumnRenamed("value", "stored").join(back, ["tid", "ts"]).select(
        "tid", "ts", F.col("stored").cast("double").alias("stored"), F.col("value").cast("double").alias("value"))


PRECISIONS = (1, 2)
QUANT = """SELECT p AS "precision", tid, ts, CAST(round(CAST(value AS DOUBLE) * pow(10, p)) AS BIGINT) q,
 CAST(CAST(round(CAST(value AS DOUBLE) * pow(10, p)) AS BIGINT) / pow(10, p) AS FLOAT) AS value
 FROM pts_seq, (SELECT unnest([1, 2]) p)"""


def quantized(spark, sf_dir):
    return rg.quantize(fx.points(spark, sf_dir, "pts_seq"), PRECISIONS)


@add("quantize", sql("pts_seq", quant=QUANT, body="""SELECT "precision", tid, ts, q, CAST(value AS DOUBLE) AS value FROM quant"""))
def quantize(spark, sf_dir):
    return quantized(spark, sf_dir).select("precision", "tid", "ts", "q", F.col("value").cast("double").alias("value"))


@add("quantize_delta_bytes", sql("pts_seq", quant=QUANT, body="""SELECT "precision", tid, count(*) n,
 CAST(sum(ceil(length(bin(abs(d2) * 2)) / 8.0)) AS BIGINT) bytes FROM (
 SELECT "precision", tid, coalesce(d1 - lag(d1) OVER w, d1) d2 FROM (
 SELECT "precision", tid, ts, coalesce(q - lag(q) OVER (PARTITION BY "precision", tid ORDER BY ts), q) d1 FROM quant)
 WINDOW w AS (PARTITION BY "precision", tid ORDER BY ts)) GROUP BY 1, 2"""))
def quantize_delta_bytes(spark, sf_dir):
    return rg.delta_bytes(quantized(spark, sf_dir))


@add("pct_error", sql("pts_seq", materialized=True, quant=QUANT, body="""SELECT q."precision", p.tid, p.ts, round(CASE WHEN q.value = p.value THEN 0
 WHEN p.value = 0 THEN 'infinity'::DOUBLE ELSE abs((CAST(p.value AS DOUBLE) - q.value) / CAST(p.value AS DOUBLE)) * 100 END, 9) error
 FROM pts_seq p JOIN quant q USING (tid, ts)"""))
def pct_error(spark, sf_dir):
    approx = quantized(spark, sf_dir).withColumnRenamed("value", "approx")
    d = fx.points(spark, sf_dir, "pts_seq").join(approx, ["tid", "ts"])
    error = percentage_error(F.col("approx"), F.col("value"))
    return d.select("precision", "tid", "ts", F.round(error, 9).alias("error"))


# ---- aggregates on points ----

V = "CAST(value AS DOUBLE)"


def _by_tid(name, table, columns, where=""):
    return add(name, sql(table, body=f"SELECT tid, {columns} FROM {table} {where} GROUP BY tid"))


@_by_tid("count_by_tid", "pts_seq", "count(*) n, count(value) n_values")
def count_by_tid(spark, sf_dir):
    return aggregate.point_aggregate(fx.points(spark, sf_dir, "pts_seq"), ["tid"], n=F.count(F.lit(1)), n_values=F.count("value"))


@add("count_all", sql("pts_seq", body="SELECT count(*) n, count(value) n_values FROM pts_seq"))
def count_all(spark, sf_dir):
    return aggregate.point_aggregate(fx.points(spark, sf_dir, "pts_seq"), n=F.count(F.lit(1)), n_values=F.count("value"))


@_by_tid("sum_by_tid", "pts_seq", f"round(sum({V}), 4) total")
def sum_by_tid(spark, sf_dir):
    return aggregate.point_aggregate(fx.points(spark, sf_dir, "pts_seq"), ["tid"], total=F.round(F.sum(aggregate.value()), 4))


@add("sum_all", sql("pts_seq", body=f"SELECT round(sum({V}), 3) total FROM pts_seq"))
def sum_all(spark, sf_dir):
    return aggregate.point_aggregate(fx.points(spark, sf_dir, "pts_seq"), total=F.round(F.sum(aggregate.value()), 3))


@_by_tid("minmax_pos_by_tid", "pts_cnt", f"min({V}) low, max({V}) high", "WHERE value > 0")
def minmax_pos_by_tid(spark, sf_dir):
    positive = fx.points(spark, sf_dir, "pts_cnt").where("value > 0")
    return aggregate.point_aggregate(positive, ["tid"], low=F.min(aggregate.value()), high=F.max(aggregate.value()))


@add("minmax_all", sql("pts_cnt", body=f"SELECT min({V}) low, max({V}) high FROM pts_cnt"))
def minmax_all(spark, sf_dir):
    return aggregate.point_aggregate(fx.points(spark, sf_dir, "pts_cnt"), low=F.min(aggregate.value()), high=F.max(aggregate.value()))


@_by_tid("avg_by_tid", "pts_cnt", f"round(avg({V}), 6) mean, round(avg({V}) FILTER (WHERE value <> 0), 6) mean_nonzero")
def avg_by_tid(spark, sf_dir):
    v = aggregate.value()
    return aggregate.point_aggregate(fx.points(spark, sf_dir, "pts_cnt"), ["tid"], mean=F.round(F.avg(v), 6),
                                     mean_nonzero=F.round(F.avg(F.when(v != 0, v)), 6))


@_by_tid("std_by_tid", "pts_seq", f"round(stddev_samp({V}), 4) std, round(stddev_pop({V}), 4) std_pop")
def std_by_tid(spark, sf_dir):
    return aggregate.point_aggregate(fx.points(spark, sf_dir, "pts_seq"), ["tid"], std=F.round(aggregate.std(), 4),
                                     std_pop=F.round(aggregate.std(population=True), 4))


@add("median_approx", sql("pts_seq", body="SELECT tid, count(*) n, true in_bound FROM pts_seq GROUP BY tid"))
def median_approx(spark, sf_dir):
    """The rank of the answer is within n / accuracy of the middle."""
    accuracy = 10_000
    p = fx.points(spark, sf_dir, "pts_seq")
    answers = aggregate.point_aggregate(p, ["tid"], answer=aggregate.median_approx(accuracy))
    ranks = p.join(answers, "tid").groupBy("tid").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < F.col("answer")).alias("below"),
        F.count_if(F.col("value") <= F.col("answer")).alias("upto"))
    slack = F.col("n") / accuracy + 1
    within = (F.col("below") <= F.col("n") / 2 + slack) & (F.col("upto") >= F.col("n") / 2 - slack)
    return ranks.select("tid", "n", within.alias("in_bound"))


@_by_tid("median_exact", "pts_seq", f"round(median({V}), 6) median")
def median_exact(spark, sf_dir):
    return aggregate.median_exact(fx.points(spark, sf_dir, "pts_seq"), ["tid"]).select("tid", dbl("median"))
