"""Point and series tables derived from the given tables, with the same definition in SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.operators.compress import compress
from tidegauge.operators.regularize import align_grid, regularize
from tidegauge.plans.ordered import positions
from tidegauge.session import prepare, work_dir
from tidegauge.sources.readings import number_sources
from tidegauge.sources.store import read_segments, write_segments, write_series

# Sampling intervals of the point tables in ms.
SI = {"pts_ev": 3_600_000, "pts_cnt": 3_600_000, "pts_ship": 86_400_000, "pts_seq": 2_000, "pts_smooth": 2_000}
PERIOD = {"pts_ev": "month", "pts_cnt": "month", "pts_ship": "year", "pts_seq": "day", "pts_smooth": "day"}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def series_ev(spark, sf_dir) -> DataFrame:
    def build(path):
        number_sources(events(spark, sf_dir), "event_type").write.parquet(path)
    ids = spark.read.schema("tid int, event_type string").parquet(once(spark, (sf_dir, "series_ev"), "series", build))
    return ids.select("tid", F.col("event_type").alias("source"), F.lit(SI["pts_ev"]).cast("long").alias("si_ms"), _scaling(),
                      F.col("tid").alias("gid"))


def _scaling():
    return (1 + (F.col("tid") % 3) * 0.5).cast("float").alias("scaling")


def pts_ev(spark, sf_dir) -> DataFrame:
    hourly = regularize(events(spark, sf_dir), "event_type", "hour", "max")
    return hourly.join(series_ev(spark, sf_dir).select("tid", F.col("source").alias("event_type")), "event_type").select(
        "tid", "ts", "value")


def pts_cnt(spark, sf_dir) -> DataFrame:
    hourly = regularize(events(spark, sf_dir), "event_type", "hour", "count")
    series = series_ev(spark, sf_dir)
    points = hourly.join(series.select("tid", F.col("source").alias("event_type")), "event_type").select("tid", "ts", "value")
    together = series.withColumn("gid", F.when(F.col("source").isNotNull(), 1))
    grid = align_grid(points, together)
    return grid.select("tid", "ts", F.coalesce("value", F.lit(0.0)).cast("float").alias("value"))


def series_ship(spark, sf_dir) -> DataFrame:
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    d = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return d.select((F.col("n_nationkey") + 1).cast("int").alias("tid"), F.col("n_name").alias("source"),
                    F.lit(SI["pts_ship"]).cast("long").alias("si_ms"), F.lit(1.0).cast("float").alias("scaling"),
                    (F.col("n_nationkey") + 1).cast("int").alias("gid"), F.col("r_name").alias("region"),
                    F.col("n_name").alias("nation"), (F.col("r_regionkey") + 1).cast("int").alias("region_gid"))


def pts_ship(spark, sf_dir) -> DataFrame:
    per_supplier = load(spark, sf_dir, "lineitem").groupBy(
        "l_suppkey", F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("ts")).agg(F.sum("l_quantity").alias("q"))
    supplier = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return (per_supplier.join(supplier, "l_suppkey").groupBy("s_nationkey", "ts").agg(F.sum("q").cast("float").alias("value"))
            .select((F.col("s_nationkey") + 1).cast("int").alias("tid"), "ts", "value"))


def _sequence(spark, sf_dir, order, bucket) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    d = positions(rows, ["l_suppkey"], order, bucket)
    start = F.unix_millis(F.lit("2024-01-01").cast("timestamp"))
    return d.select(F.col("l_suppkey").cast("int").alias("tid"),
                    F.timestamp_millis(start + (F.col("rn") - 1) * SI["pts_seq"]).alias("ts"),
                    F.col("l_extendedprice").cast("float").alias("value"))


def pts_seq(spark, sf_dir) -> DataFrame:
    return _sequence(spark, sf_dir, ["l_orderkey", "l_linenumber", "l_extendedprice"], F.floor(F.col("l_orderkey") / 65_536))


def pts_smooth(spark, sf_dir) -> DataFrame:
    return _sequence(spark, sf_dir, ["l_extendedprice", "l_orderkey", "l_linenumber"], F.floor(F.col("l_extendedprice") / 1024))


def series_seq(spark, sf_dir) -> DataFrame:
    d = load(spark, sf_dir, "supplier").join(
        series_ship(spark, sf_dir).select((F.col("gid") - 1).alias("s_nationkey"), "region", "nation"), "s_nationkey")
    tid = F.col("s_suppkey").cast("int")
    return d.select(tid.alias("tid"), F.col("s_name").alias("source"), F.lit(SI["pts_seq"]).cast("long").alias("si_ms"),
                    (1 + (tid % 3) * 0.5).cast("float").alias("scaling"), tid.alias("gid"), "region", "nation")


def stored_series(spark, sf_dir) -> DataFrame:
    """series_seq as it is kept beside its store, written once per session."""
    path = once(spark, (sf_dir, "series_seq"), "series", lambda p: write_series(series_seq(spark, sf_dir), p))
    return spark.read.schema(series_seq(spark, sf_dir).schema).parquet(path)


POINTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pts_ev": pts_ev, "pts_cnt": pts_cnt, "pts_ship": pts_ship, "pts_seq": pts_seq, "pts_smooth": pts_smooth}

_stored: dict[tuple, str] = {}


def once(spark: SparkSession, key: tuple, label: str, build: Callable[[str], None]) -> str:
    """Path of a table that is written at most once per session, in the shared folder."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _stored:
        path = work_dir(spark, label)
        build(path)
        _stored[key] = path
    return _stored[key]


def points(spark, sf_dir, name: str) -> DataFrame:
    """A point table ingested once per session, as every query but the ingestion itself reads it."""
    path = once(spark, (sf_dir, name), name, lambda p: POINTS[name](spark, sf_dir).write.parquet(p))
    return prepare(spark).read.schema("tid int, ts timestamp, value float").parquet(path)


def path_of(spark, sf_dir, name: str, eps=0.0, **options) -> str:
    """Folder of the segments of a point table, compressed once per session and partitioned by time."""
    def build(path):
        write_segments(compress(points(spark, sf_dir, name), eps, si_ms=SI[name], **options), path, PERIOD[name])
    return once(spark, (sf_dir, name, eps, repr(sorted(options.items(), key=str))), f"segments-{name}", build)


def store(spark, sf_dir, name: str, eps=0.0, **options) -> DataFrame:
    return read_segments(prepare(spark), path_of(spark, sf_dir, name, eps, **options), period=PERIOD[name])


_SEQ = """SELECT CAST(l_suppkey AS INT) tid, TIMESTAMP '2024-01-01' + (row_number() OVER (PARTITION BY l_suppkey
 ORDER BY {}) - 1) * INTERVAL 2 SECOND ts, CAST(l_extendedprice AS FLOAT) AS value FROM lineitem"""

SQL = {
    "series_ev": """SELECT tid, source, 3600000 si_ms, CAST(1 + (tid % 3) * 0.5 AS FLOAT) scaling, tid gid FROM (
 SELECT DISTINCT CAST(dense_rank() OVER (ORDER BY event_type) AS INT) tid, event_type source FROM events)""",
    "pts_ev": """SELECT CAST(dense_rank() OVER (ORDER BY event_type) AS INT) tid, h ts, CAST(v AS FLOAT) AS value
 FROM (SELECT event_type, date_trunc('hour', ts) h, max(value) v FROM events GROUP BY 1, 2)""",
    "pts_cnt": """SELECT t.tid, g.ts, CAST(coalesce(c.n, 0) AS FLOAT) AS value FROM (SELECT DISTINCT event_type,
 CAST(dense_rank() OVER (ORDER BY event_type) AS INT) tid FROM events) t CROSS JOIN (
 SELECT unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) ts FROM events) g
 LEFT JOIN (SELECT event_type, date_trunc('hour', ts) h, count(*) n FROM events GROUP BY 1, 2) c
 ON c.event_type = t.event_type AND c.h = g.ts""",
    "series_ship": """SELECT CAST(n_nationkey + 1 AS INT) tid, n_name source, 86400000 si_ms, CAST(1 AS FLOAT) scaling,
 CAST(n_nationkey + 1 AS INT) gid, r_name region, n_name nation, CAST(r_regionkey + 1 AS INT) region_gid
 FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "pts_ship": """SELECT CAST(s_nationkey + 1 AS INT) tid, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) ts,
 CAST(sum(l_quantity) AS FLOAT) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "pts_seq": _SEQ.format("l_orderkey, l_linenumber, l_extendedprice"),
    "pts_smooth": _SEQ.format("l_extendedprice, l_orderkey, l_linenumber"),
    "series_seq": """SELECT CAST(s_suppkey AS INT) tid, s_name source, 2000 si_ms,
 CAST(1 + (s_suppkey % 3) * 0.5 AS FLOAT) scaling, CAST(s_suppkey AS INT) gid, r_name region, n_name nation
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}


def sql(*names: str, body: str, recursive: bool = False, materialized: bool = False, **ctes: str) -> str:
    """A query over the named tables and further common table expressions."""
    kept = "AS MATERIALIZED" if materialized else "AS"
    parts = [f"{n} {kept} ({SQL[n]})" for n in names] + [f"{n} {kept} ({q})" for n, q in ctes.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


class Catalog:
    """Registered queries and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None):
        def register(f):
            self.queries[name] = f
            if oracle is not None:
                self.oracles[name] = oracle
            return f
        return register


def dbl(name: str, digits: int = 6):
    """A rounded DOUBLE column, as the SQL side rounds it."""
    return F.round(F.col(name).cast("double"), digits).alias(name)
