import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegauge import schema
from tidegauge.operators import regularize, view
from tidegauge.operators.compress import compress
from tidegauge.sources import readings, store


def test_csv_variants(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time;value\n1700000000;1.234,5\n1700000002;2,5\n")
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b"1700000000500 7.25\n"))
    (tmp_path / "c.csv").write_text("x,2024-03-01 12:00:00,-4\n")
    a = readings.read_csv(spark, str(tmp_path / "a.csv"), separator=";", header=True, locale="de")
    assert [(r.source, r.value) for r in a.orderBy("ts").collect()] == [("a.csv", 1234.5), ("a.csv", 2.5)]
    b = readings.read_csv(spark, str(tmp_path / "b.csv.gz"), separator=" ", date_format="java").first()
    assert (b.source, b.value, b.ts) == ("b.csv.gz", 7.25, datetime(2023, 11, 14, 22, 13, 20, 500000))
    c = readings.read_csv(spark, str(tmp_path / "c.csv"), n_columns=3, time_column=1, value_column=2,
                          date_format="yyyy-MM-dd HH:mm:ss", time_zone="Europe/Copenhagen").first()
    assert (c.ts, c.value) == (datetime(2024, 3, 1, 11), -4.0)


def test_numbers_of_locales(spark):
    def read(text, locale):
        return spark.range(1).select(readings.parse_number(F.lit(text), locale)).first()[0]
    for text, locale in (("1,234.5", "en"), ("1.234,5", "de"), ("1.234,5", "pt-BR"), ("1 234,5", "pl"), ("1\u202f234,5", "fr"), ("1'234.5", "de-CH"), ("1 234,5", "sv"), ("1.234,5", "da_DK")):
        assert read(text, locale) == 1234.5, locale
    assert read("\u22121,5", "sv") == read("-1,5", "nb") == -1.5
    for locale in ("xx", "", "fa"):
        with pytest.raises(ValueError):
            read("1", locale)


def test_files_of_one_name(spark, tmp_path):
    for folder, value in (("a", "1"), ("b", "2")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text(f"1700000000,{value}\n")
    d = readings.read_csv(spark, str(tmp_path / "*"))
    ids = readings.number_sources(d)
    assert [(r.tid, r.source, r.path[-7:]) for r in ids.orderBy("tid").collect()] == [(1, "x.csv", "a/x.csv"), (2, "x.csv", "b/x.csv")]
    assert sorted((r.tid, r.value) for r in readings.assign_tids(d, ids).collect()) == [(1, 1.0), (2, 2.0)]
    with pytest.raises(Exception, match="not among the listed sources"):
        readings.assign_tids(d, ids.where("tid = 1")).collect()


def test_readings_that_cannot_be_stored_raise(spark):
    def points(*rows):
        return spark.createDataFrame(rows, "tid int, ms long, value float").select("tid", F.timestamp_millis("ms").alias("ts"), "value")
    series = spark.createDataFrame([(1, 1, 1000)], "tid int, gid int, si_ms long")
    good = (1, 0, 1.0)
    for bad, text in (((1, 0, 2.0), "several readings"), ((1, 1000, float("nan")), "no number"), ((2, 0, 1.0), "not among the listed series")):
        d = points(good, bad)
        with pytest.raises(Exception, match=text):
            compress(d, series=series).collect()
        taken, refused = regularize.split_readings(d, series)
        assert refused.count() == 1 and len(rows(view.points(compress(taken, series=series)))) == 1
    assert {r.reason for r in regularize.split_readings(points(good, (1, 0, 1.0), (3, 0, 1.0), (1, 5, float("nan"))), series)[1].collect()} == {"repeated", "unknown", "no number"}


def test_malformed_csv_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1700000000,nonsense\n")
    with pytest.raises(Exception):
        readings.read_csv(spark, str(tmp_path / "a.csv")).collect()


@pytest.mark.parametrize("file_format", ["orc", "parquet"])
def test_columnar_files_get_ids_by_name(spark, tmp_path, file_format):
    spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 0, 123456), 1.5, 9)], "ts timestamp, value double, other int").coalesce(1).write.format(file_format).save(str(tmp_path / "d"))
    d = readings.read_columnar(spark, str(tmp_path / "d"), file_format, glob=f"*.{file_format}")
    row = readings.assign_tids(d, readings.number_sources(d, first_tid=5)).first()
    assert (row.tid, row.ts, row.value) == (5, datetime(2024, 1, 1, 0, 0, 0, 123000), 1.5)
    assert d.first().source.endswith(file_format)


@pytest.fixture
def points(spark):
    return spark.range(0, 1000).select(
        (F.col("id") % 2 + 1).cast("int").alias("tid"), F.timestamp_millis(F.floor(F.col("id") / 2) * 1000).alias("ts"),
        F.sin(F.col("id")).cast("float").alias("value"))


def rows(df):
    return sorted(map(tuple, df.select("tid", "ts", "value").collect()))


@pytest.mark.parametrize("file_format", ["orc", "parquet"])
def test_store_round_trip_and_compaction(spark, tmp_path, points, file_format):
    path, target = str(tmp_path / "s"), str(tmp_path / "t")
    g = compress(points, si_ms=1000, chunk_ticks=100)
    store.write_segments(g.where("gid = 1").repartition(5, "start_time"), path, "day", file_format)
    store.write_segments(g.where("gid = 2").repartition(5, "start_time"), path, "day", file_format)
    store.compact(spark, path, target, 1, "day", file_format)
    for p in (path, target):
        assert rows(view.points(store.read_segments(spark, p, file_format))) == rows(points)
    small, big = (store.stored_bytes(spark, p, f"*.{file_format}").first().bytes for p in (target, path))
    assert 0 < small < big


def test_duplicate_segments(points):
    g = compress(points, si_ms=1000)
    assert store.deduplicate(store.union_stores(g, g)).count() == g.count()


def test_model_types_must_agree(spark):
    server = spark.createDataFrame(list(schema.MODEL_NAMES.items()), "mtid int, name string")
    store.check_model_types(server.where("mtid < 4"), server)
    for client in ([(2, "other")], [(9, "raw")]):
        with pytest.raises(ValueError):
            store.check_model_types(spark.createDataFrame(client, "mtid int, name string"), server)
    with pytest.raises(ValueError):
        store.check_model_types(server, server.where("mtid < 4"))


def test_index_column_is_dropped(spark):
    wide = spark.createDataFrame([(datetime(2024, 1, 1), 1.0, 2.0, 0)], "datetime timestamp, `a.b` double, c double, __index_level_0__ int")
    assert sorted((r.source, r.value) for r in readings.unpivot_signals(wide).collect()) == [("a.b", 1.0), ("c", 2.0)]
