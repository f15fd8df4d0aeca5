"""Streams in several deliveries give what a batch over the same points gives."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge import schema
from tidegauge.operators import quality, view
from tidegauge.operators.compress import compress
from tidegauge.sources import readings
from tidegauge.streaming import ingest, numbering, online, rejects, sink

POINTS = "tid int, ts timestamp, value float"
COLUMNS = [f.name for f in schema.SEGMENT_GROUPS.fields]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    rows = [(tid, i, float(v)) for tid in (1, 2, 3) for i, v in enumerate(np.round(50 + np.cumsum(rng.normal(0, 0.5, 200)), 1))
            if not (tid == 2 and 60 <= i < 75) and not 120 <= i < 123]
    start = F.unix_millis(F.lit(datetime(2024, 1, 1)).cast("timestamp"))
    return spark.createDataFrame(rows, "tid int, i long, v double").select(
        "tid", F.timestamp_millis(start + F.col("i") * 60_000).alias("ts"), F.col("v").cast("float").alias("value")).cache()


def deliver(spark, points, folder, options):
    """Four deliveries in time order, each followed by a run of the stream over what is new."""
    cuts = [datetime(2024, 1, 1, 0, 50), datetime(2024, 1, 1, 1, 10), datetime(2024, 1, 1, 2, 30), datetime(2024, 1, 2)]
    before = datetime(2023, 1, 1)
    for cut in cuts:
        points.where((F.col("ts") >= before) & (F.col("ts") < cut)).write.mode("append").parquet(f"{folder}/in")
        stream = ingest.read_stream(spark, f"{folder}/in", POINTS)
        out = online.segment_stream(stream, **options)
        ingest.run(ingest.append_batches(out, f"{folder}/out", f"{folder}/check"))
        before = cut
    return spark.read.parquet(f"{folder}/out")


def as_rows(df):
    return sorted(str(tuple(r)) for r in df.select("gid", "chunk", "start_time", "end_time", "mtid", "a", "b", "payload", "tids", "n_gaps", "sums").collect())


@pytest.mark.parametrize("grouped", [False, True])
def test_stream_equals_batch(spark, points, tmp_path, grouped):
    series = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "tid int, gid int").withColumn("si_ms", F.lit(60_000).cast("long"))
    options = dict(eps=2.0, chunk_ticks=64) | (dict(series=series) if grouped else dict(si_ms=60_000))
    finals = deliver(spark, points, str(tmp_path), options).where("is_final").select(*COLUMNS)
    rest = online.finish(points, finals, **options)
    assert finals.count() > 3 * rest.count() > 0
    assert as_rows(finals.unionByName(rest)) == as_rows(compress(points, **options))


def test_provisional_segments_cover_what_is_open(spark, points, tmp_path):
    options = dict(eps=2.0, si_ms=60_000, chunk_ticks=64, maximum_latency=5)
    segments = deliver(spark, points, str(tmp_path), options)
    assert segments.where("NOT is_final").count() > 0
    shown = view.points(online.online_view(segments))
    aligned = quality.align(points, shown)
    counts = quality.alignment_counts(aligned, 2.0).collect()
    assert all(r.n_extra == 0 and r.n_violations == 0 for r in counts)
    # at most maximum_latency ticks, and the last tick before the watermark, are not visible yet
    assert all(r.n_missing <= 5 + 1 for r in counts)
    assert shown.count() == shown.select("tid", "ts").distinct().count()


def test_new_provisional_segments_replace_old_ones(spark):
    def row(batch, first, ticks, final, payload=None):
        start = datetime(2024, 1, 1, 0, first)
        return (0.0, 1, 0, 0, start, datetime(2024, 1, 1, 0, first + ticks - 1), 60_000, ticks, 2, 0.0, 1.0, payload, [1], 0, None, None, None, 4, final, batch)
    ddl = ", ".join(f"{n} {t}" for n, t in ((f.name, f.dataType.simpleString()) for f in online.OUTPUT.fields)) + ", batch int"
    rows = [row(1, 0, 5, False), row(2, 0, 8, False), row(3, 0, 6, True)]
    d = spark.createDataFrame(rows, ddl)
    view_rows = online.online_view(d).orderBy("start_time").select("start_time", "n_ticks", "skip", "n_stored").collect()
    assert [tuple(r)[1:] for r in view_rows] == [(6, 0, 6), (2, 6, 8)] and view_rows[1].start_time == datetime(2024, 1, 1, 0, 6)
    gone = spark.createDataFrame([*rows, row(4, 6, 2, True)], ddl)
    assert [r.n_ticks for r in online.online_view(gone).orderBy("start_time").collect()] == [6, 2]


def test_bulk_append_runs_once_per_file(spark, points, tmp_path):
    points.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = ingest.read_stream(spark, str(tmp_path / "in"), POINTS)
        ingest.run(ingest.append_to(stream, str(tmp_path / "out"), str(tmp_path / "check"), partition_by=["tid"]))
    assert spark.read.parquet(str(tmp_path / "out")).count() == points.count()


def test_late_rows_are_counted(spark, points, tmp_path):
    def deliver(df):
        df.write.mode("append").parquet(str(tmp_path / "in"))
        d = ingest.drop_late_and_duplicates(ingest.read_stream(spark, str(tmp_path / "in"), POINTS), ["tid", "ts"], "10 minutes")
        query = ingest.append_to(d, str(tmp_path / "out"), str(tmp_path / "check"), state_partitions=2)
        return late.of(query)
    late = ingest.LateRows(spark)
    assert deliver(points) == 0
    again = points.where(F.col("ts") < datetime(2024, 1, 1, 0, 5))
    assert deliver(again) == again.count() == 15
    assert spark.read.parquet(str(tmp_path / "out")).count() == points.count()
    late.close()


def test_windows_open_at_the_end(spark, points, tmp_path):
    events = points.withColumnRenamed("tid", "key").withColumn("value", F.col("value").cast("double"))
    events.write.parquet(str(tmp_path / "in"))
    stream = ingest.read_stream(spark, str(tmp_path / "in"), events.schema)
    ingest.run(ingest.append_to(ingest.regularize_stream(stream, "key", "7 minutes", "20 minutes"), str(tmp_path / "out"), str(tmp_path / "check"), state_partitions=2))
    seen = spark.read.schema("key int, ts timestamp, value float").parquet(str(tmp_path / "out"))
    rest = ingest.open_windows(events, seen, "key", "7 minutes")
    want = events.groupBy("key", F.window("ts", "7 minutes").start.alias("ts")).agg(F.max("value").cast("float").alias("value"))
    assert rest.count() > 0 and sorted(map(tuple, seen.union(rest).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("grouped", [False, True])
def test_an_end_mark_closes_every_chunk(spark, points, tmp_path, grouped):
    series = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "tid int, gid int").withColumn("si_ms", F.lit(60_000).cast("long"))
    options = dict(eps=2.0, chunk_ticks=64) | (dict(series=series) if grouped else dict(si_ms=60_000))
    inbox, marks = str(tmp_path / "in"), str(tmp_path / "marks")

    def run():
        stream = ingest.with_end_marks(ingest.read_stream(spark, inbox, POINTS), marks)
        ingest.run(ingest.append_batches(online.segment_stream(stream, **options), str(tmp_path / "out"), str(tmp_path / "check"), state_partitions=2))
        return spark.read.parquet(str(tmp_path / "out")).where("is_final").select(*COLUMNS)
    half = F.col("ts") < datetime(2024, 1, 1, 1, 0)
    points.where(half).write.parquet(inbox)
    run()
    points.where(~half).write.mode("append").parquet(inbox)
    before = run().count()
    ingest.end_stream(spark, marks)
    ended = run()
    assert before < ended.count() and as_rows(ended) == as_rows(compress(points, **options))


def test_an_end_mark_within_time_leaves_later_windows_open(spark, points, tmp_path):
    events = points.withColumnRenamed("tid", "key").withColumn("value", F.col("value").cast("double"))
    inbox, marks = str(tmp_path / "in"), str(tmp_path / "marks")
    events.write.parquet(inbox)

    def run():
        stream = ingest.with_end_marks(ingest.read_stream(spark, inbox, events.schema), marks)
        ingest.run(ingest.append_to(ingest.regularize_stream(stream, "key", "7 minutes", "100 minutes"), str(tmp_path / "out"), str(tmp_path / "check"), state_partitions=2))
        return spark.read.schema("key int, ts timestamp, value float").parquet(str(tmp_path / "out"))
    want = events.groupBy("key", F.window("ts", "7 minutes").start.alias("ts")).agg(F.max("value").cast("float").alias("value"))
    first = run().count()
    ingest.end_stream(spark, marks, datetime(2024, 1, 1, 4, 0))  # less the delay: 02:20
    passed = F.col("ts") + F.expr("INTERVAL 7 MINUTES") <= datetime(2024, 1, 1, 2, 20)
    assert first < run().count() < want.count()
    assert sorted(map(tuple, run().collect())) == sorted(map(tuple, want.where(passed).collect()))
    ingest.end_stream(spark, marks)
    assert sorted(map(tuple, run().collect())) == sorted(map(tuple, want.collect()))


def test_starting_a_stream_leaves_the_settings_of_the_session(spark, points, tmp_path):
    keys = ["spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(k) for k in keys]
    points.write.parquet(str(tmp_path / "in"))
    out = online.segment_stream(ingest.read_stream(spark, str(tmp_path / "in"), POINTS), 1.0, 60_000)
    ingest.run(ingest.append_batches(out, str(tmp_path / "out"), str(tmp_path / "check"), state_partitions=3))
    assert [spark.conf.get(k) for k in keys] == before


def test_refused_readings_of_a_stream_come_out_with_reasons(spark, tmp_path):
    def at(minute, micro=0):
        return datetime(2024, 1, 1, 0, minute, 0, micro)
    deliveries = [
        [(1, at(10), 5.0), (1, at(10), 4.0), (1, at(10, 999), 4.5), (2, at(10), 7.0), (1, at(50), 1.0), (None, at(10), 1.0), (1, None, 1.0), (1, at(11), float("nan")), (1, at(11), None)],
        [(1, at(10), 4.0), (1, at(45), 2.0), (2, at(50), 3.0), (1, at(50), 9.0), (1, at(39), 8.0)],
        [(1, at(45), 2.0), (1, at(46), 2.5)]]
    ddl = "tid int, ts timestamp, value double"
    for rows in deliveries:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        d = rejects.sort_stream(ingest.read_stream(spark, str(tmp_path / "in"), ddl), "10 minutes")
        ingest.run(ingest.append_to(d, str(tmp_path / "out"), str(tmp_path / "check"), state_partitions=2))
    out = spark.read.schema(ddl + ", reason string").parquet(str(tmp_path / "out"))
    def plain(rows):
        return sorted((tuple(str(v) for v in r) for r in rows))
    assert plain(out.select("tid", "ts", "value").collect()) == plain(r for d in deliveries for r in d)  # input = kept + refused
    assert plain(out.where("reason IS NULL").select("tid", "ts", "value").collect()) == plain(
        [(1, at(10), 4.0), (2, at(10), 7.0), (1, at(50), 1.0), (1, at(45), 2.0), (2, at(50), 3.0), (1, at(46), 2.5)])
    reasons = {r.reason: r.n for r in out.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert reasons == {"no number": 4, "repeated": 4, "late": 2}


def test_sources_of_a_stream_are_numbered_on(spark, tmp_path):
    def deliver(named, use=None):
        for name, rows in named.items():
            folder = tmp_path / "in" / f"source={name}"
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"{len(list(folder.iterdir()))}.csv").write_text("".join(f"{t},{v}\n" for t, v in rows))
        d = readings.read_csv(spark, str(tmp_path / "in"), stream=True)
        ingest.run(numbering.append_numbered(d, str(tmp_path / "points"), str(tmp_path / "ids"), str(tmp_path / "check"), use=use))

    def ids():
        return {r.source: r.tid for r in numbering.known_sources(spark, str(tmp_path / "ids")).collect()}
    (tmp_path / "in").mkdir()
    deliver({"m": [(60, 1.5)], "c": [(60, 2.5)]})
    assert ids() == {"c": 1, "m": 2}

    def lost(points, batch_id):
        raise OSError("the executors are gone")
    with pytest.raises(Exception, match="executors are gone"):
        deliver({"a": [(60, 3.5)], "m": [(120, 4.5)]}, use=lost)
    numbered = ids()
    deliver({})  # the same batch again
    assert ids() == numbered == {"c": 1, "m": 2, "a": 3}
    got = spark.read.schema("tid int, ts timestamp, value float").parquet(str(tmp_path / "points"))
    assert sorted((r.tid, r.ts.minute, r.value) for r in got.collect()) == [(1, 1, 2.5), (2, 1, 1.5), (2, 2, 4.5), (3, 1, 3.5)]
    with pytest.raises(ValueError):
        readings.read_csv(spark, "x", files_per_batch=1)


def test_folders_of_a_number_of_batches():
    assert sink.folders(0, 3) == [] and sink.folders(14, 3) == ["0-8", "9-11", "12-12", "13-13"]
    for n in range(200):
        covered = [b for name in sink.folders(n, 4) for b in range(int(name.split("-")[0]), int(name.split("-")[1]) + 1)]
        assert covered == list(range(n)) and len(sink.folders(n, 4)) <= 3 * 4


def test_merged_folders_hold_every_row_once(spark, tmp_path, monkeypatch):
    path, most = str(tmp_path / "out"), 0
    assert sink.read_compacted(spark, path, "v long").count() == 0
    for i in range(28):
        batch = spark.range(i * 2, i * 2 + i % 3).select(F.col("id").alias("v")).coalesce(1)
        if i in (8, 13):  # lost after its folders are written: nothing of it is visible, and it comes again
            with monkeypatch.context() as lost:
                lost.setattr(sink, "_files", lambda *_: 1 / 0)
                lost.setattr(sink, "published", lambda *_: i)
                with pytest.raises(ZeroDivisionError):
                    sink.put_batch(batch, i, path, 3)
            assert sink.published(spark, path) == i
        for _ in range(2):
            sink.put_batch(batch, i, path, 3)
        most = max(most, len(list((tmp_path / "out").iterdir())))
        if i in (0, 8, 13, 27):
            want = [(b * 2 + k, b) for b in range(i + 1) for k in range(b % 3)]
            assert sorted(map(tuple, sink.read_compacted(spark, path, "v long", 3).collect())) == want
    assert most <= 16 and len(sink._names(spark, f"{path}/_published")) == 1
    with pytest.raises(ValueError):
        sink.put_batch(batch, 28, path, 1)


def test_online_view_shows_every_tick(spark, tmp_path):
    from catalog import streams
    events = spark.range(3 * 50).selectExpr("id AS event_id", "concat('type', id % 3) AS event_type", "timestamp_millis(1704067200000 + id div 3 * 3600000) AS ts",
                                            "cast(id * id % 17 + 1 AS double) AS value")
    events.toPandas().astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")  # streams read one file of that name
    rows = streams.online_view(spark, str(tmp_path)).collect()
    # the newest hour too, which no watermark passes before the end mark
    assert sorted(map(tuple, rows)) == [(tid, 50, 0, 0, 0) for tid in (1, 2, 3)]
