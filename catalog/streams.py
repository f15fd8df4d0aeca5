"""Streams over the events table, run to the end of the available data."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import Catalog, sql
from tidegauge.operators import quality, view
from tidegauge.session import prepare, work_dir
from tidegauge.sources import readings
from tidegauge.streaming import ingest, numbering, online, rejects, sink

CATALOG = Catalog()
add = CATALOG.add

DELAY = "2 hours"
CHUNK = 24  # hourly ticks per chunk: state leaves after a day
EPS = 10.0


def cores(spark):
    """State partitions: one per core that the session has."""
    return spark.sparkContext.defaultParallelism


def event_stream(spark, sf_dir):
    schema = fx.load(spark, sf_dir, "events").schema
    d = ingest.read_stream(spark, sf_dir, schema, glob="events.parquet")
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


@add("stream_ingest", """SELECT event_type, CAST(ts AS DATE) AS day, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2""")
def stream_ingest(spark, sf_dir):
    """Bulk mode: every reading is appended once."""
    path, checkpoint = work_dir(spark, "ingested"), work_dir(spark, "checkpoint")
    ingest.run(ingest.append_to(event_stream(spark, sf_dir).select("event_type", "ts", "value"), path, checkpoint))
    return spark.read.parquet(path).groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def to_the_end(spark, stream, write):
    """Runs a stream over all there is, then once more after its end mark. `write` starts the query of a stream."""
    marks = work_dir(spark, "end-marks")
    for last in (False, True):
        if last:
            ingest.end_stream(spark, marks)
        ingest.run(write(ingest.with_end_marks(stream, marks)))


def regular(spark, sf_dir):
    """Hourly points of a stream with series ids, all emitted by the stream; written once per session."""
    def build(path):
        emitted, checkpoint = work_dir(spark, "stream-windows"), work_dir(spark, "checkpoint")
        to_the_end(spark, event_stream(prepare(spark), sf_dir), lambda d: ingest.append_to(
            ingest.regularize_stream(d, "event_type", "1 hour", DELAY), emitted, checkpoint, state_partitions=cores(spark)))
        seen = spark.read.schema("event_type string, ts timestamp, value float").parquet(emitted)
        ids = fx.series_ev(spark, sf_dir).select("tid", F.col("source").alias("event_type"))
        seen.join(ids, "event_type").select("tid", "ts", "value").write.parquet(path)
    return fx.once(spark, (sf_dir, "stream_regular"), "stream-points", build)


POINTS_DDL = "tid int, ts timestamp, value float"


@add("stream_regularize", sql("pts_ev", body="SELECT tid, ts, CAST(value AS DOUBLE) AS value FROM pts_ev"))
def stream_regularize(spark, sf_dir):
    d = spark.read.schema(POINTS_DDL).parquet(regular(spark, sf_dir))
    return d.select("tid", "ts", F.col("value").cast("double").alias("value"))


def segmented(spark, sf_dir, latency, ended):
    """Segments of the stream of hourly points, with the micro-batch that emitted them; up to its end mark or without one."""
    def build(path):
        points, checkpoint = ingest.read_stream(spark, regular(spark, sf_dir), POINTS_DDL), work_dir(spark, "checkpoint")

        def write(d):
            out = online.segment_stream(d, EPS, fx.SI["pts_ev"], chunk_ticks=CHUNK, maximum_latency=latency)
            return ingest.append_batches(out, path, checkpoint, state_partitions=cores(spark))
        if ended:
            to_the_end(spark, points, write)
        else:
            ingest.run(write(points))
    path = fx.once(spark, (sf_dir, "stream_segments", latency, ended), "stream-segments", build)
    return spark.read.parquet(path)


INVARIANTS = """SELECT tid, count(*) n_points, CAST(0 AS BIGINT) n_missing, CAST(0 AS BIGINT) n_extra, CAST(0 AS BIGINT) n_violations FROM pts_ev GROUP BY tid"""


@add("stream_compress", sql("pts_ev", body=INVARIANTS))
def stream_compress(spark, sf_dir):
    """Finalized segments of a stream that has ended: every point is in one that the stream emitted."""
    points = spark.read.schema(POINTS_DDL).parquet(regular(spark, sf_dir))
    finals = segmented(spark, sf_dir, 0, True).where("is_final").drop("is_final", "batch")
    return quality.alignment_counts(quality.align(points, view.points(finals)), EPS)


def watermark(points):
    """The last tick that the watermark of a stream without end mark has passed: an hour before the newest time."""
    return points.agg(F.max("ts")).scalar() - F.expr("INTERVAL 1 HOUR")


@add("stream_latency", sql("pts_ev", body="SELECT tid, CAST(0 AS BIGINT) n_extra, CAST(0 AS BIGINT) n_violations, true AS some FROM pts_ev GROUP BY tid"))
def stream_latency(spark, sf_dir):
    """Provisional segments show only points there are, within the bound; `some`: they show any."""
    points = spark.read.schema(POINTS_DDL).parquet(regular(spark, sf_dir))
    temporary = segmented(spark, sf_dir, 1, False).where("NOT is_final").drop("is_final", "batch")
    counts = quality.alignment_counts(quality.align(points, view.points(temporary)), EPS)
    return counts.select("tid", "n_extra", "n_violations", F.lit(not temporary.isEmpty()).alias("some"))


@add("online_view", sql("pts_ev", body=INVARIANTS))
def online_view(spark, sf_dir):
    """Finalized and provisional segments show every tick once: the running stream those that its watermark has passed, and
    after its end mark it shows the others."""
    points = spark.read.schema(POINTS_DDL).parquet(regular(spark, sf_dir))
    running, ended = (view.points(online.online_view(segmented(spark, sf_dir, 1, last))) for last in (False, True))
    late = ended.where(F.col("ts") > watermark(points))
    return quality.alignment_counts(quality.align(points, running.unionByName(late)), EPS)


@add("stream_late_drop", """SELECT event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1""")
def stream_late_drop(spark, sf_dir):
    """A second delivery of the last hour is dropped as duplicate, one of the first day as late."""
    inbox, path, checkpoint = (work_dir(spark, d) for d in ("inbox", "deduplicated", "checkpoint"))
    ev = fx.events(spark, sf_dir).select("event_id", "event_type", "ts", "value")
    newest = ev.agg(F.max("ts")).scalar()
    oldest = ev.agg(F.min("ts")).scalar()

    def deliver(df):
        df.write.mode("append").parquet(inbox)
        d = ingest.drop_late_and_duplicates(ingest.read_stream(spark, inbox, ev.schema), ["event_id"], DELAY)
        ingest.run(ingest.append_to(d, path, checkpoint, state_partitions=cores(spark)))

    deliver(ev)
    again = ev.where(F.col("ts") > newest - F.expr("INTERVAL 1 HOUR"))
    late = ev.where(F.col("ts") < oldest + F.expr("INTERVAL 1 DAY")).withColumn("event_id", -1 - F.col("event_id"))
    deliver(again.unionByName(late))
    return spark.read.parquet(path).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@add("stream_rejects", """WITH edges AS (SELECT min(ts) oldest, max(ts) newest FROM events),
first_ones AS (SELECT event_type, ts, value, row_number() OVER (PARTITION BY event_type, epoch_ms(ts) ORDER BY value, ts) n FROM events)
SELECT event_type, ts, value, 'repeated' reason FROM first_ones WHERE n > 1
UNION ALL SELECT event_type, ts, value, 'repeated' FROM events, edges WHERE ts > newest - INTERVAL 1 HOUR
UNION ALL SELECT event_type, ts, CAST(NULL AS DOUBLE), 'no number' FROM events, edges WHERE ts > newest - INTERVAL 1 HOUR
UNION ALL SELECT event_type, ts, value, 'late' FROM events, edges WHERE ts < oldest + INTERVAL 1 DAY""")
def stream_rejects(spark, sf_dir):
    """Of a second delivery, the last hour again, the same without numbers and the first day, every row comes out with its reason."""
    inbox, path, checkpoint = (work_dir(spark, d) for d in ("inbox", "sorted", "checkpoint"))
    ev = fx.events(spark, sf_dir).select("event_type", "ts", "value")
    newest, oldest = ev.agg(F.max("ts")).scalar(), ev.agg(F.min("ts")).scalar()
    again = ev.where(F.col("ts") > newest - F.expr("INTERVAL 1 HOUR"))
    late = ev.where(F.col("ts") < oldest + F.expr("INTERVAL 1 DAY"))
    for rows in (ev, again.unionByName(again.withColumn("value", F.lit(None).cast("double"))).unionByName(late)):
        rows.write.mode("append").parquet(inbox)
        d = rejects.sort_stream(ingest.read_stream(spark, inbox, ev.schema), DELAY, "event_type")
        ingest.run(ingest.append_to(d, path, checkpoint, state_partitions=cores(spark)))
    out = spark.read.schema("event_type string, ts timestamp, value double, reason string").parquet(path)
    return out.where("reason IS NOT NULL")


@add("stream_text_readings", sql("pts_ev", waves="SELECT tid, dense_rank() OVER (ORDER BY tid % 2 DESC, tid) n FROM pts_ev GROUP BY tid",
                                 body="SELECT CAST(n AS INT) tid, ts, CAST(value AS DOUBLE) AS value FROM pts_ev JOIN waves USING (tid)"))
def stream_text_readings(spark, sf_dir):
    """Text files of two deliveries; series of the second one are numbered on from those of the first."""
    inbox, points, sources, checkpoint = (work_dir(spark, d) for d in ("texts", "text-points", "sources", "checkpoint"))
    named = fx.points(spark, sf_dir, "pts_ev").join(fx.series_ev(spark, sf_dir).select("tid", "source"), "tid")
    for odd in (1, 0):
        wave = named.where(F.col("tid") % 2 == odd)
        wave.select("source", F.unix_millis("ts").alias("ms"), "value").write.mode("append").partitionBy("source").csv(inbox, compression="gzip")
        d = readings.read_csv(spark, inbox, date_format="java", stream=True)
        ingest.run(numbering.append_numbered(d, points, sources, checkpoint))
    return spark.read.schema("tid int, ts timestamp, value float").parquet(points).select("tid", "ts", F.col("value").cast("double").alias("value"))


@add("stream_compacted", """SELECT event_type, CAST(ts AS DATE) AS day, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2""")
def stream_compacted(spark, sf_dir):
    """Online mode over many micro-batches: merged folders hold every row once."""
    inbox, path, checkpoint = (work_dir(spark, d) for d in ("inbox", "compacted", "checkpoint"))
    ev = fx.events(spark, sf_dir).select("event_type", "ts", "value")
    ev.repartitionByRange(8, "ts").write.parquet(inbox)
    stream = ingest.read_stream(spark, inbox, ev.schema, files_per_batch=1)
    ingest.run(sink.append_compacted(stream, path, checkpoint, fan=3))
    d = sink.read_compacted(spark, path, "event_type string, ts timestamp, value double", fan=3)
    return d.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
