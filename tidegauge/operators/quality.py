"""What compression and sampling cost: stored bytes, errors of points, errors of queries."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidegauge import schema
from tidegauge.functions.errors import percentage_error, query_error, relative_error
from tidegauge.plans.lookup import required
from tidegauge.plans.ordered import consecutive_runs, positions
from tidegauge.plans.quantile import exact_median, median_of_counts
from tidegauge.session import written

QUERIES = ("MIN", "MAX", "AVG", "SUM", "MEDIAN", "STD", "COUNT")
HISTOGRAM_BINS = 10


def align(real: DataFrame, approx: DataFrame, keys: Sequence[str] = ("tid",)) -> DataFrame:
    """(keys, ts, real, approx) of both sides; NULL = missing (no approx) or extra (no real).

    Both sides are points, so they meet by sorting. Spark takes points that are generated from segments for as few bytes as the
    segments, and would broadcast all of them once a later filter makes this an inner join.
    """
    r = real.select(*keys, "ts", F.col("value").alias("real"))
    a = approx.select(*keys, "ts", F.col("value").alias("approx"))
    return r.join(a.hint("merge"), [*keys, "ts"], "full_outer")


def error() -> Column:
    return percentage_error(F.col("approx"), F.col("real"))


def alignment_counts(aligned: DataFrame, eps: float, keys: Sequence[str] = ("tid",)) -> DataFrame:
    """(keys, n_points, n_missing, n_extra, n_violations)."""
    return aligned.groupBy(*keys).agg(
        F.count("real").alias("n_points"), F.count_if(F.col("approx").isNull()).alias("n_missing"),
        F.count_if(F.col("real").isNull()).alias("n_extra"), F.count_if(error() > eps).alias("n_violations"))


def error_table(aligned: DataFrame, keys: Sequence[str] = ("tid",)) -> DataFrame:
    """Per series: mean non-zero error, maximum, number of differences, points, mean over all points."""
    e = F.col("e")
    hits = F.count_if(e != 0)
    total = F.sum(e)
    return (aligned.where("real IS NOT NULL AND approx IS NOT NULL").withColumn("e", error())
            .groupBy(*keys)
            # fixed values: the column names of this and the following result tables
            .agg(F.when(hits > 0, total / hits).otherwise(0.0).alias("average_error"),
                 F.max(e).alias("maximum_error"), hits.alias("difference_count"), F.count(e).alias("count"),
                 (total / F.count(e)).alias("mean_absolute_error")))


def violations(aligned: DataFrame, eps: float, strict: bool = False) -> DataFrame:
    """Points that are missing, extra or outside the bound; `strict` raises when there is one."""
    kind = (F.when(F.col("approx").isNull(), "missing").when(F.col("real").isNull(), "extra")
            .when(error() > eps, "outside"))
    bad = aligned.withColumns({"error": error(), "kind": kind}).where("kind IS NOT NULL")
    if strict:
        first = bad.limit(1).take(1)
        if first:
            raise ValueError(f"approximation cannot be verified: {first[0]}")
    return bad


def error_histogram(aligned: DataFrame, eps: float) -> DataFrame:
    """(bin, value): counts of errors below 10 upper bounds; larger errors fall into the last bin."""
    width = (eps if eps else 1.0) / HISTOGRAM_BINS + 1e-6
    slot = F.least(F.floor(F.col("e") / width), F.lit(HISTOGRAM_BINS - 1))
    slot = F.when(F.col("e") >= width * HISTOGRAM_BINS, F.lit(HISTOGRAM_BINS - 1)).otherwise(slot)
    counts = (aligned.where("real IS NOT NULL AND approx IS NOT NULL").withColumn("e", error())
              .groupBy(slot.cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n")))
    bins = aligned.sparkSession.range(HISTOGRAM_BINS)
    return bins.join(counts, "id", "left").select(
        ((F.col("id") + 1) * F.lit(width)).alias("bin"), F.coalesce("n", F.lit(0)).alias("value"))


def error_ceil_histogram(aligned: DataFrame) -> DataFrame:
    """(error, n): errors rounded up; 0 to 10 are always present, infinite errors count under NULL."""
    up = F.when(F.col("e") < float("inf"), F.ceil("e"))
    counts = (aligned.where("real IS NOT NULL AND approx IS NOT NULL").withColumn("e", error())
              .groupBy(up.alias("error")).agg(F.count(F.lit(1)).alias("n")))
    bins = aligned.sparkSession.range(11).withColumnRenamed("id", "error")
    return bins.join(counts, "error", "full_outer").select("error", F.coalesce("n", F.lit(0)).alias("n"))


def segment_size(members: DataFrame, mtids: Sequence[int] = (2, 3, 4)) -> DataFrame:
    """Per series and model type: points, segments, median segment length (0 without segments)."""
    hist = members.groupBy("tid", "mtid", "n_ticks").agg(F.count(F.lit(1)).alias("c"))
    sums = hist.groupBy("tid", "mtid").agg(F.sum(F.col("n_ticks") * F.col("c")).alias("data_point"),
                                           F.sum("c").alias("segment"))
    medians = median_of_counts(hist, ["tid", "mtid"], "n_ticks", "c", "median_segment_length")
    slots = members.select("tid").distinct().select(
        "tid", F.explode(F.array(*map(F.lit, mtids))).alias("mtid"))
    name = F.element_at(F.create_map(*[F.lit(x) for m in mtids for x in (m, schema.MODEL_NAMES[m])]), F.col("mtid"))
    return (slots.join(sums, ["tid", "mtid"], "left").join(medians, ["tid", "mtid"], "left")
            .select("tid", name.alias("model_type"), *[F.coalesce(c, F.lit(0)).alias(c) for c in
                                                       ("data_point", "segment", "median_segment_length")]))


def theoretical_bytes(points: DataFrame) -> DataFrame:
    """One table of all series: 8-byte time and 4-byte value for the first, 4 bytes for the others."""
    counts = points.groupBy("tid").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.sum("n") * 4 + F.min_by("n", "tid") * 8).alias("theoretical_size"))


def model_sizes(groups: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Expected bytes of models, metadata and gaps, and the resulting compression factor."""
    meta = F.count(F.lit(1)) * schema.SEGMENT_METADATA_BYTES
    models, gaps = F.sum("model_bytes"), F.sum("n_gaps") * schema.GAP_BYTES
    points = F.sum(F.col("n_ticks").cast("long") * F.size("tids"))
    total = meta + models + gaps
    return groups.groupBy(*keys).agg(
        points.alias("points"), models.alias("models_size"), meta.alias("metadata_size"), gaps.alias("gaps_size"),
        total.alias("expected_size"), (points * schema.POINT_BYTES / total).alias("compression_factor"))


def compression_ratio() -> Column:
    """Ratio of one segment-group row, counting ticks as the model selection does."""
    stored = F.col("model_bytes") + schema.SEGMENT_METADATA_BYTES + F.col("n_gaps") * schema.GAP_BYTES
    return F.col("n_ticks") * schema.POINT_BYTES / stored


def file_size(points: DataFrame, groups: DataFrame, raw_bytes: DataFrame, stored_bytes: DataFrame) -> DataFrame:
    """One row with all sizes; `raw_bytes` and `stored_bytes` are single-value frames (column bytes)."""
    return (model_sizes(groups)
            .withColumns({"theoretical_size": theoretical_bytes(points).scalar(),
                          "actual_file_size": raw_bytes.select("bytes").scalar(),
                          "compressed_size": stored_bytes.select("bytes").scalar()}))


def model_runs(members: DataFrame, bucket_ms: int, mtid: int = schema.XOR) -> DataFrame:
    """(tid, run_length, start_index, closed): runs of at least two consecutive segments of one type.

    `closed` is false for a run that reaches the last segment of its series.
    """
    d = positions(members.select("tid", "start_time", "mtid"), ["tid"], ["start_time"],
                  F.floor(F.unix_millis("start_time") / bucket_ms))
    d = d.withColumns({"idx": F.col("rn").cast("long") - 1, "step": F.lit(1).cast("long")})
    ends = d.groupBy("tid").agg(F.max("idx").alias("end"))
    runs = consecutive_runs(d.where(F.col("mtid") == mtid), ["tid"], "idx", "step", F.floor(F.col("idx") / 4096))
    return runs.where("n >= 2").join(ends, "tid").select(
        "tid", F.col("n").alias("run_length"), F.col("first").alias("start_index"),
        (F.col("last") < F.col("end")).alias("closed"))


def mape(aligned: DataFrame, keys: Sequence[str] = ("tid",)) -> DataFrame:
    """MAPE in percent and maximum relative error with undefined errors as 0; MSE, RMSE, MAE."""
    real, approx = F.col("real").cast("double"), F.col("approx").cast("double")
    rel = relative_error(approx, real)
    zeroed = F.when(rel.isNull() | (rel == float("inf")), 0.0).otherwise(rel)
    mse = F.avg((real - approx) * (real - approx))
    return aligned.groupBy(*keys).agg(
        (F.avg(zeroed) * 100).alias("mape"), F.max(zeroed).alias("max_error"), mse.alias("mse"),
        F.sqrt(mse).alias("rmse"), F.avg(F.abs(real - approx)).alias("mae"))


def mape_pooled(aligned: DataFrame, nonzero: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """MAPE as a fraction over all series with undefined errors dropped and infinite ones counted."""
    d = aligned.where(F.col("real") != 0) if nonzero else aligned
    rel = relative_error(F.col("approx"), F.col("real"))
    finite = F.when(rel < float("inf"), rel)
    return d.groupBy(*keys).agg(F.avg(finite).alias("mape"), F.count_if(rel == float("inf")).alias("inf_count"))


def series_aggregates(points: DataFrame, keys: Sequence[str], population_std: bool = True,
                      positive: bool = False) -> DataFrame:
    """(keys, query, result) for QUERIES; MIN and MAX, or all with `positive`, see only values > 0."""
    v = F.col("value").cast("double")
    pos = F.when(v > 0, v)
    x = pos if positive else v
    spread = F.stddev_pop(x) if population_std else F.stddev_samp(x)
    base = points.groupBy(*keys).agg(F.min(pos).alias("MIN"), F.max(pos).alias("MAX"), F.avg(x).alias("AVG"),
                                     F.sum(x).alias("SUM"), spread.alias("STD"),
                                     F.count(x).cast("double").alias("COUNT"))
    medians = exact_median(points.where("value > 0") if positive else points, keys, "value", "MEDIAN")
    return (base.join(medians, list(keys), "left")
            .unpivot(list(keys), list(QUERIES), "query", "result"))


_RAW = -1  # marks the raw points among the values of a sweep, which are not negative


def rqe(points: DataFrame, approx: DataFrame, sweep: str, population_std: bool = True, positive: bool = False,
        scale_sum: bool = False) -> DataFrame:
    """(sweep, tid, query, rqe): errors of queries on `approx`, which has a column named by `sweep`.

    Raw and approximate points are aggregated together, and each answer meets the raw one in a
    window over the few rows of its series and query. `scale_sum` multiplies sums by the sweep. The points are
    written once to the shared folder, as the aggregates and both passes of the median read them.
    """
    columns = [sweep, "tid", "value"]
    both = points.withColumn(sweep, F.lit(_RAW)).select(*columns).unionByName(approx.select(*columns))
    both = written(both.sparkSession, both, "rqe")
    answers = series_aggregates(both, [sweep, "tid"], population_std, positive)
    raw = F.col(sweep) == _RAW
    result = F.col("result")
    if scale_sum:
        result = F.when((F.col("query") == "SUM") & ~raw, result * F.col(sweep)).otherwise(result)
    real = F.max(F.when(raw, F.col("result"))).over(W.partitionBy("tid", "query"))
    return (answers.withColumn("rqe", query_error(real, result)).where(~raw).select(sweep, "tid", "query", "rqe"))


def rqe_summary(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Minimum, maximum and median error over series, and how many are undefined."""
    medians = exact_median(errors, keys, "rqe", "median_rqe")
    return (errors.groupBy(*keys).agg(F.min("rqe").alias("min_rqe"), F.max("rqe").alias("max_rqe"),
                                      F.count_if(F.col("rqe").isNull()).alias("undefined"))
            .join(medians, list(keys), "left"))


def split_device(name: Column) -> tuple[Column, Column]:
    """Device and measurement of a file name `<device>_<measurement>.orc`."""
    device = F.substring_index(name, "_", 1)
    rest = F.replace(name, F.concat(device, F.lit("_")), F.lit(""))
    return device, F.regexp_replace(F.regexp_replace(rest, r"\.orc", ""), r"\.", "")


def olap_report(points: DataFrame, series: DataFrame, eps: float, dataset: str, nonzero: bool = False) -> DataFrame:
    """(dataset, signal, error_bound, query, result, datapoint_cnt) for MAX, MIN, AVG, STD, MEDIAN."""
    v = F.col("value").cast("double")
    pos, kept = F.when(v > 0, v), F.when(v != 0, v) if nonzero else v
    base = points.groupBy("tid").agg(
        F.max(pos).alias("MAX"), F.min(pos).alias("MIN"), F.avg(kept).alias("AVG"), F.stddev_samp(kept).alias("STD"),
        F.percentile_approx(kept, 0.5).alias("MEDIAN"), F.count(F.lit(1)).alias("datapoint_cnt"))
    return (required(base, series.select("tid", F.col("source").alias("signal")), ["tid"], "series")
            .unpivot(["signal", "datapoint_cnt"], ["MAX", "MIN", "AVG", "STD", "MEDIAN"], "query", "result")
            .select(F.lit(dataset).alias("dataset"), "signal", F.lit(eps).alias("error_bound"), "query", "result",
                    "datapoint_cnt"))
