"""Headline timings: python bench.py prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Ingestion is timed as `compress`; the
queries then run on the stored points and segments, each timed on its second run.
"""

import json
import os
import time

from pyspark.sql import SparkSession, functions as F

from catalog import fixtures as fx, quality as cq, segments as cs
from tidegauge.operators import aggregate, quality, view
from tidegauge.sources.store import stored_bytes


def per_signal(groups, segments, series, tids) -> dict[str, float]:
    """One sequential query per signal and aggregate, as an interactive client sends them."""
    v = aggregate.value()

    def point(column, tid, condition=None):
        d = view.points(groups, tids=[tid], gids=view.gids_of(series, [tid]))
        return (d if condition is None else d.where(condition)).agg(column).first()

    queries = {
        "max": lambda t: point(F.max(v), t, "value > 0"), "min": lambda t: point(F.min(v), t, "value > 0"),
        "avg": lambda t: aggregate.agg_segments(segments.where((F.col("gid") == t) & (F.col("tid") == t)), aggs=["avg"]).first(),
        "std": lambda t: point(aggregate.std(), t), "median": lambda t: point(aggregate.median_approx(), t)}
    out, start = {}, time.perf_counter()
    for name, run in queries.items():
        begin = time.perf_counter()
        for tid in tids:
            run(tid)
        out[f"{name}_mean"] = round((time.perf_counter() - begin) / len(tids), 3)
    out["total"], out["n"] = round(time.perf_counter() - start, 3), len(queries) * len(tids)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        result = run()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    def warm(name, run):
        run()
        timed(name, run)

    def rows(df):
        df.write.format("noop").mode("overwrite").save()

    table = "pts_seq"
    points = fx.points(spark, sf_dir, table)
    n = points.count()
    fx.points(spark, sf_dir, "pts_smooth").count()
    # one small compressed table starts the Python workers
    rows(fx.store(spark, sf_dir, "pts_ev"))
    timed("compress", lambda: fx.path_of(spark, sf_dir, table, 0.0))
    timed("compress_eps5_smooth", lambda: fx.path_of(spark, sf_dir, "pts_smooth", 5.0))
    groups = fx.store(spark, sf_dir, table)
    segments = view.members(groups)
    v = aggregate.value()
    positive = F.when(v > 0, v)

    def by_point(**columns):
        return aggregate.point_aggregate(view.points(groups), ["tid"], **columns)

    rows(aggregate.agg_segments(segments, aggs=["count"]))
    warm("count_s", lambda: rows(aggregate.agg_segments(segments, aggs=["count"])))
    warm("sum_s_by_tid", lambda: rows(aggregate.agg_segments(segments, ["tid"], ["sum"])))
    warm("all_s_by_tid", lambda: rows(aggregate.agg_segments(segments, ["tid"])))
    warm("sum_by_tid_from_points", lambda: rows(by_point(total=F.sum(v))))
    warm("minmax_pos_by_tid", lambda: rows(by_point(low=F.min(positive), high=F.max(positive))))
    warm("avg_by_tid", lambda: rows(by_point(mean=F.avg(v))))
    warm("std_by_tid", lambda: rows(by_point(std=aggregate.std())))
    warm("median_approx", lambda: rows(by_point(median=aggregate.median_approx())))
    warm("median_exact", lambda: rows(aggregate.median_exact(points, ["tid"])))
    warm("olap_report", lambda: rows(quality.olap_report(view.points(groups), fx.series_seq(spark, sf_dir), 0.0, table)))
    warm("reconstruct_lossless", lambda: rows(view.points(groups)))
    warm("filter_ts_range", lambda: rows(cs.filter_ts_range(spark, sf_dir)))
    warm("sum_cal_hour_of_day", lambda: rows(aggregate.calendar_agg(segments, "sum", "hour_of_day", ["tid"])))
    warm("sum_cal_minute", lambda: rows(aggregate.calendar_agg(segments, "sum", "minute", ["tid"])))
    warm("rqe_downsampled", lambda: rows(cq.rqe_downsampled(spark, sf_dir)))
    signals = per_signal(groups, segments, fx.stored_series(spark, sf_dir), [r.tid for r in groups.select(F.col("gid").alias("tid")).distinct().orderBy("tid").take(10)])
    stored = stored_bytes(spark, fx.path_of(spark, sf_dir, table, 0.0), "*.parquet").first()["bytes"]
    model = groups.agg(F.sum(F.col("model_bytes") + 24 + 4 * F.col("n_gaps")).alias("b")).first()["b"]
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "points": n, "compress_points_per_sec": round(n / seconds["compress"]),
        "reconstruct_points_per_sec": round(n / seconds["reconstruct_lossless"]),
        "stored_bytes_per_point": round(stored / n, 3), "model_bytes_per_point": round(model / n, 3),
        "signal_queries": signals, "segment_route_speedup": round(seconds["sum_by_tid_from_points"] / seconds["sum_s_by_tid"], 2)}))


if __name__ == "__main__":
    main()
