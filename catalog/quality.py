"""Errors of points and queries, sizes, reports."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import Catalog, dbl, sql
from catalog.points import FACTORS, FILLED, PRECISIONS, QUANT, down_sql, downsampled, filled, quantized
from catalog.segments import xor_store
from tidegauge.operators import quality, view
from tidegauge.sources.store import stored_bytes

CATALOG = Catalog()
add = CATALOG.add

V = "CAST(value AS DOUBLE)"
MEAN = "avg(CAST(value AS DOUBLE))"


# ---- alignment and point errors ----

SIDES = dict(quant=QUANT,
             aligned="""SELECT q."precision", tid, ts, CAST(p.value AS DOUBLE) AS real, CAST(q.value AS DOUBLE) AS approx FROM pts_seq p JOIN quant q USING (tid, ts)""")


def aligned(spark, sf_dir):
    real = fx.points(spark, sf_dir, "pts_seq").select(F.explode(F.array(*map(F.lit, PRECISIONS))).alias("precision"), "*")
    return quality.align(real, quantized(spark, sf_dir), ["precision", "tid"])


@add("align_real_approx", sql("pts_ev", "pts_cnt", body="""SELECT coalesce(r.tid, a.tid) tid, count(r.value) n_points,
 count(*) FILTER (WHERE a.value IS NULL) n_missing, count(*) FILTER (WHERE r.value IS NULL) n_extra,
 count(*) FILTER (WHERE r.value IS NOT NULL AND a.value IS NOT NULL AND a.value <> r.value) n_violations
 FROM pts_ev r FULL JOIN pts_cnt a ON r.tid = a.tid AND r.ts = a.ts GROUP BY 1"""))
def align_real_approx(spark, sf_dir):
    """Hourly maxima against hourly counts, which have no gaps: missing, extra and differing points."""
    real, approx = fx.points(spark, sf_dir, "pts_ev"), fx.points(spark, sf_dir, "pts_cnt")
    return quality.alignment_counts(quality.align(real, approx), 0.0)


ERROR = """CASE WHEN approx = real THEN 0 WHEN real = 0 THEN CAST('infinity' AS DOUBLE) ELSE abs((real - approx) / real) * 100 END"""


@add("error_table", sql("pts_seq", **SIDES, body=f"""SELECT "precision", tid, round(CASE WHEN count(*) FILTER (WHERE e <> 0) > 0
 THEN sum(e) / count(*) FILTER (WHERE e <> 0) ELSE 0 END, 9) average_error, round(max(e), 9) maximum_error,
 count(*) FILTER (WHERE e <> 0) difference_count, count(*) AS "count", round(sum(e) / count(*), 9) mean_absolute_error
 FROM (SELECT *, {ERROR} e FROM aligned) GROUP BY 1, 2"""))
def error_table(spark, sf_dir):
    d = quality.error_table(aligned(spark, sf_dir), ["precision", "tid"])
    return d.select("precision", "tid", dbl("average_error", 9), dbl("maximum_error", 9), "difference_count", "count",
                    dbl("mean_absolute_error", 9))


@add("error_table_models", sql("pts_smooth", body="""SELECT tid, count(*) AS "count", true bounded, true consistent FROM pts_smooth GROUP BY tid"""))
def error_table_models(spark, sf_dir):
    """The error table of compressed series keeps to the bound and is consistent in itself."""
    real, approx = fx.points(spark, sf_dir, "pts_smooth"), view.points(fx.store(spark, sf_dir, "pts_smooth", 5.0))
    d = quality.error_table(quality.align(real, approx))
    consistent = F.abs(F.col("average_error") * F.col("difference_count") - F.col("mean_absolute_error") * F.col("count")) < 1e-6
    return d.select("tid", "count", (F.col("maximum_error") <= 5.0).alias("bounded"), consistent.alias("consistent"))


@add("verify", sql("pts_seq", materialized=True, **SIDES, body=f"""SELECT "precision", tid, ts, real, approx, round(e, 9) error, 'outside' kind
 FROM (SELECT *, {ERROR} e FROM aligned) WHERE e > 0.0001"""))
def verify(spark, sf_dir):
    d = quality.violations(aligned(spark, sf_dir), 0.0001)
    return d.select("precision", "tid", "ts", F.col("real").cast("double").alias("real"), F.col("approx").cast("double").alias("approx"), dbl("error", 9), "kind")


@add("verify_models", sql("pts_smooth", body="SELECT tid, ts, 0.0::DOUBLE error FROM pts_smooth WHERE false"))
def verify_models(spark, sf_dir):
    """No violation by compressed series; strict mode would raise."""
    real, approx = fx.points(spark, sf_dir, "pts_smooth"), view.points(fx.store(spark, sf_dir, "pts_smooth", 5.0))
    return quality.violations(quality.align(real, approx), 5.0, strict=True).select("tid", "ts", "error")


HIST_EPS = 0.001


@add("error_histogram", sql("pts_seq", **SIDES, body=f"""SELECT round((b + 1) * w, 9) bin, count(slot) AS "value" FROM (
 SELECT unnest(range(10)) b, 0.001::DOUBLE / 10 + 0.000001::DOUBLE w) LEFT JOIN (
 SELECT least(floor(e / (0.001::DOUBLE / 10 + 0.000001::DOUBLE)), 9) slot FROM (SELECT {ERROR} e FROM aligned)) ON slot = b GROUP BY 1"""))
def error_histogram(spark, sf_dir):
    return quality.error_histogram(aligned(spark, sf_dir), HIST_EPS).select(dbl("bin", 9), "value")


@add("error_ceil_hist", sql("pts_seq", **SIDES, body=f"""SELECT coalesce(error, b) error, coalesce(n, 0) n FROM (SELECT unnest(range(11)) b)
 FULL JOIN (SELECT CAST(ceil(e) AS BIGINT) error, count(*) n FROM (SELECT {ERROR} e FROM aligned) GROUP BY 1) ON b = error"""))
def error_ceil_hist(spark, sf_dir):
    return quality.error_ceil_histogram(aligned(spark, sf_dir))


# ---- sizes ----

@add("segment_size", sql("pts_ship", blocks="""SELECT tid, ts, value, (row_number() OVER (PARTITION BY tid, chunk, run ORDER BY ts) - 1) // 50 block, chunk, run FROM (
 SELECT *, sum(new) OVER (PARTITION BY tid, chunk ORDER BY ts) run FROM (SELECT *, epoch_ms(ts) // 353894400000 chunk,
 CASE WHEN date_diff('day', lag(ts) OVER (PARTITION BY tid, epoch_ms(ts) // 353894400000 ORDER BY ts), ts) = 1 THEN 0 ELSE 1 END new
 FROM pts_ship))""", s="SELECT tid, 'gorilla' model_type, count(*) n FROM blocks GROUP BY tid, chunk, run, block", body="""SELECT t.tid, m.model_type,
 CAST(coalesce(sum(n), 0) AS BIGINT) data_point, count(n) segment, coalesce(median(n), 0) median_segment_length
 FROM (SELECT DISTINCT tid FROM s) t CROSS JOIN (SELECT unnest(['pmc_mean', 'swing', 'gorilla']) model_type) m
 LEFT JOIN s ON s.tid = t.tid AND s.model_type = m.model_type GROUP BY 1, 2"""))
def segment_size(spark, sf_dir):
    return quality.segment_size(view.members(xor_store(spark, sf_dir)))


@add("segment_size_models", sql("pts_smooth", body="SELECT tid, count(*) data_point, true enough FROM pts_smooth GROUP BY tid"))
def segment_size_models(spark, sf_dir):
    d = quality.segment_size(view.members(fx.store(spark, sf_dir, "pts_smooth", 5.0)))
    return d.groupBy("tid").agg(F.sum("data_point").alias("data_point"), (F.sum("segment") > 0).alias("enough"))


@add("theoretical_bytes", sql("pts_ship", body="""SELECT CAST(sum(n) * 4 + arg_min(n, tid) * 8 AS BIGINT) theoretical_size FROM (
 SELECT tid, count(*) n FROM pts_ship GROUP BY 1)"""))
def theoretical_bytes(spark, sf_dir):
    return quality.theoretical_bytes(fx.points(spark, sf_dir, "pts_ship"))


@add("file_size", sql("pts_smooth", body="""SELECT count(*) points, (SELECT CAST(sum(n) * 4 + arg_min(n, tid) * 8 AS BIGINT) FROM (
 SELECT tid, count(*) n FROM pts_smooth GROUP BY 1)) theoretical_size, true adds_up, true smaller FROM pts_smooth"""))
def file_size(spark, sf_dir):
    g = fx.store(spark, sf_dir, "pts_smooth", 5.0)
    raw = stored_bytes(spark, sf_dir, "lineitem.parquet")
    kept = stored_bytes(spark, fx.path_of(spark, sf_dir, "pts_smooth", 5.0), "*.parquet")
    d = quality.file_size(fx.points(spark, sf_dir, "pts_smooth"), g, raw, kept)
    adds_up = F.col("expected_size") == F.col("models_size") + F.col("metadata_size") + F.col("gaps_size")
    smaller = (F.col("compressed_size") < F.col("actual_file_size")) & (F.col("expected_size") < F.col("theoretical_size"))
    return d.select("points", "theoretical_size", adds_up.alias("adds_up"), smaller.alias("smaller"))


# the segment order of a series, with short runs of constant hours between coded ones
GORILLA = """SELECT tid, n run_length, first start_index, last < (SELECT max(idx) FROM numbered m WHERE m.tid = r.tid) closed FROM (
 SELECT tid, min(idx) first, max(idx) last, count(*) n FROM (SELECT tid, idx, idx - row_number() OVER (PARTITION BY tid ORDER BY idx) g
 FROM numbered WHERE mtid = 4) GROUP BY tid, g) r WHERE n >= 2"""


@add("gorilla_runs", sql("pts_cnt", numbered="""SELECT tid, row_number() OVER (PARTITION BY tid ORDER BY ts) - 1 idx,
 CASE WHEN value >= 3 THEN 4 ELSE 2 END mtid FROM pts_cnt""", body=GORILLA))
def gorilla_runs(spark, sf_dir):
    """Runs over one-tick segments whose type follows from the hourly count."""
    d = fx.points(spark, sf_dir, "pts_cnt").select("tid", F.col("ts").alias("start_time"), F.when(F.col("value") >= 3, 4).otherwise(2).alias("mtid"))
    return quality.model_runs(d, 7 * 86_400_000)


@add("gorilla_runs_models", sql("pts_smooth", body="SELECT tid, true valid FROM pts_smooth GROUP BY tid"))
def gorilla_runs_models(spark, sf_dir):
    """Runs of a compressed table never hold more segments than there are."""
    m = view.members(fx.store(spark, sf_dir, "pts_smooth", 1.0))
    coded = m.groupBy("tid").agg(F.count_if(F.col("mtid") == 4).alias("coded"))
    runs = quality.model_runs(m, 100_000).groupBy("tid").agg(F.sum("run_length").alias("in_runs"))
    return coded.join(runs, "tid", "left").select("tid", (F.coalesce("in_runs", F.lit(0)) <= F.col("coded")).alias("valid"))


# ---- errors of approximations ----

REL = "CASE WHEN real = 0 AND approx = 0 THEN NULL WHEN real = 0 THEN CAST('infinity' AS DOUBLE) ELSE abs((real - approx) / real) END"


@add("mape_agg", sql("pts_seq", down=down_sql(MEAN), filled=FILLED, body=f"""SELECT factor, tid, round(avg(x) * 100, 6) mape, round(max(x), 6) max_error,
 round(avg((real - approx) * (real - approx)), 2) mse, round(sqrt(avg((real - approx) * (real - approx))), 4) rmse, round(avg(abs(real - approx)), 4) mae FROM (
 SELECT factor, tid, real, approx, CASE WHEN coalesce(r, 0) = CAST('infinity' AS DOUBLE) THEN 0 ELSE coalesce(r, 0) END x FROM (
 SELECT *, {REL} r FROM (SELECT factor, tid, CAST(value AS DOUBLE) AS real, CAST(approx AS DOUBLE) AS approx FROM filled))) GROUP BY 1, 2"""))
def mape_agg(spark, sf_dir):
    d = quality.mape(filled(spark, sf_dir).withColumnRenamed("value", "real"), ["factor", "tid"])
    return d.select("factor", "tid", dbl("mape"), dbl("max_error"), dbl("mse", 2), dbl("rmse", 4), dbl("mae", 4))


@add("mape_drop", sql("pts_cnt", body=f"""SELECT false nonzero, round(avg(r) FILTER (WHERE r < CAST('infinity' AS DOUBLE)), 9) mape,
 count(*) FILTER (WHERE r = CAST('infinity' AS DOUBLE)) inf_count FROM (SELECT {REL} r FROM (SELECT CAST(value AS DOUBLE) AS real,
 lag(CAST(value AS DOUBLE)) OVER (PARTITION BY tid ORDER BY ts) AS approx FROM pts_cnt) WHERE approx IS NOT NULL)
 UNION ALL SELECT true, round(avg(r) FILTER (WHERE r < CAST('infinity' AS DOUBLE)), 9),
 count(*) FILTER (WHERE r = CAST('infinity' AS DOUBLE)) FROM (SELECT {REL} r FROM (SELECT CAST(value AS DOUBLE) AS real,
 lag(CAST(value AS DOUBLE)) OVER (PARTITION BY tid ORDER BY ts) AS approx FROM pts_cnt) WHERE approx IS NOT NULL AND real <> 0)"""))
def mape_drop(spark, sf_dir):
    """Every hourly count against the one before it: has zeros on both sides."""
    p = fx.points(spark, sf_dir, "pts_cnt")
    before = p.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    d = quality.align(p, before).where("real IS NOT NULL AND approx IS NOT NULL")
    parts = [quality.mape_pooled(d, nonzero).select(F.lit(nonzero).alias("nonzero"), dbl("mape", 9), "inf_count") for nonzero in (False, True)]
    return parts[0].unionByName(parts[1])


def agg_sql(table, keys, std, factor=None):
    """One row per key and query; MIN and MAX see positive values only."""
    v = "CAST(value AS DOUBLE)"
    total = f"sum({v})" + (f" * {factor}" if factor else "")
    parts = [("MIN", f"min({v}) FILTER (WHERE value > 0)"), ("MAX", f"max({v}) FILTER (WHERE value > 0)"), ("AVG", f"avg({v})"),
             ("SUM", total), ("MEDIAN", f"median({v})"), ("STD", f"{std}({v})"), ("COUNT", "CAST(count(value) AS DOUBLE)")]
    select = ", ".join(f'{e} AS "{q}"' for q, e in parts)
    return f"""UNPIVOT (SELECT {keys}, {select} FROM {table} GROUP BY {keys}) ON {', '.join(f'"{q}"' for q, _ in parts)} INTO NAME query VALUE result"""


RQE = """CASE WHEN r.result = a.result THEN 0 WHEN r.result = 0 THEN NULL ELSE abs((r.result - a.result) / r.result) END"""


def rqe_sql(key):
    return f"SELECT a.{key}, a.tid, a.query, {RQE} rqe FROM approx a JOIN real r ON r.tid = a.tid AND r.query = a.query"


_PREC = dict(quant=QUANT, real=agg_sql("pts_seq", "tid", "stddev_samp"), approx=agg_sql("quant", '"precision", tid', "stddev_samp"))
_DOWN = dict(down=down_sql(MEAN), real=agg_sql("pts_seq", "tid", "stddev_pop"), approx=agg_sql("down", "factor, tid", "stddev_pop", "factor"))


def quantized_rqe(spark, sf_dir):
    return quality.rqe(fx.points(spark, sf_dir, "pts_seq"), quantized(spark, sf_dir), "precision", population_std=False)


def downsampled_rqe(spark, sf_dir):
    return quality.rqe(fx.points(spark, sf_dir, "pts_seq"), downsampled(spark, sf_dir), "factor", scale_sum=True)


@add("rqe_quantized", sql("pts_seq", **_PREC, rqe=rqe_sql('"precision"'), body='SELECT "precision", tid, query, round(rqe, 9) rqe FROM rqe'))
def rqe_quantized(spark, sf_dir):
    return quantized_rqe(spark, sf_dir).select("precision", "tid", "query", dbl("rqe", 9))


@add("rqe_by_series", sql("pts_cnt", daily="""SELECT tid, date_trunc('day', ts) ts, CAST(avg(CAST(value AS DOUBLE)) AS FLOAT) AS value, 24 factor FROM pts_cnt GROUP BY 1, 2""",
     kept="SELECT * FROM pts_cnt WHERE value > 0", kept_daily="SELECT * FROM daily WHERE value > 0",
     real=agg_sql("kept", "tid", "stddev_pop"), approx=agg_sql("kept_daily", "factor, tid", "stddev_pop"), rqe=rqe_sql("factor"),
     body="SELECT tid, query, round(rqe, 9) rqe FROM rqe"))
def rqe_by_series(spark, sf_dir):
    """All queries on positive values only: hourly counts against daily means."""
    p = fx.points(spark, sf_dir, "pts_cnt")
    daily = p.groupBy("tid", F.date_trunc("day", "ts").alias("ts")).agg(F.avg(F.col("value").cast("double")).cast("float").alias("value"))
    approx = daily.withColumn("factor", F.lit(24))
    return quality.rqe(p, approx, "factor", positive=True).select("tid", "query", dbl("rqe", 9))


@add("rqe_downsampled", sql("pts_seq", **_DOWN, rqe=rqe_sql("factor"), body="SELECT factor, tid, query, round(rqe, 8) rqe FROM rqe"))
def rqe_downsampled(spark, sf_dir):
    return downsampled_rqe(spark, sf_dir).select("factor", "tid", "query", dbl("rqe", 8))


@add("rqe_summary", sql("pts_seq", **_DOWN, rqe=rqe_sql("factor"), body="""SELECT factor, query, round(min(rqe), 8) min_rqe, round(max(rqe), 8) max_rqe,
 round(median(rqe), 8) median_rqe, count(*) FILTER (WHERE rqe IS NULL) undefined FROM rqe GROUP BY 1, 2"""))
def rqe_summary(spark, sf_dir):
    d = quality.rqe_summary(downsampled_rqe(spark, sf_dir), ["factor", "query"])
    return d.select("factor", "query", dbl("min_rqe", 8), dbl("max_rqe", 8), dbl("median_rqe", 8), "undefined")


# ---- reports ----

@add("device_split", """SELECT split_part(f, '_', 1) device, replace(replace(replace(f, split_part(f, '_', 1) || '_', ''), '.orc', ''), '.', '') measurement
 FROM (SELECT replace(s_name, '#', '') || '_wind.speed.orc' f FROM supplier)""")
def device_split(spark, sf_dir):
    names = fx.load(spark, sf_dir, "supplier").select(F.concat(F.replace("s_name", F.lit("#"), F.lit("")), F.lit("_wind.speed.orc")).alias("f"))
    device, measurement = quality.split_device(F.col("f"))
    return names.select(device.alias("device"), measurement.alias("measurement"))


@add("olap_report", sql("pts_ev", "series_ev", body=f"""SELECT 'events' dataset, source signal, CAST(0 AS DOUBLE) error_bound, query, round(result, 4) result, datapoint_cnt FROM (
 UNPIVOT (SELECT source, count(*) datapoint_cnt, max({V}) FILTER (WHERE value > 0) "MAX", min({V}) FILTER (WHERE value > 0) "MIN", avg({V}) "AVG",
 stddev_samp({V}) "STD", CAST(list_sort(list({V}))[CAST(ceil(count(*) * 0.5) AS BIGINT)] AS DOUBLE) "MEDIAN" FROM pts_ev JOIN series_ev USING (tid) GROUP BY 1)
 ON "MAX", "MIN", "AVG", "STD", "MEDIAN" INTO NAME query VALUE result)"""))
def olap_report(spark, sf_dir):
    p = view.points(fx.store(spark, sf_dir, "pts_ev"))
    d = quality.olap_report(p, fx.series_ev(spark, sf_dir), 0.0, "events")
    return d.select("dataset", "signal", "error_bound", "query", dbl("result", 4), "datapoint_cnt")
