"""Segment stores: folders of Parquet or ORC files partitioned by time."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge import schema

PERIODS = ("day", "month", "year")


def write_segments(groups: DataFrame, path: str, period: str | None = "day", file_format: str = "parquet") -> None:
    """Append finalized segments, balanced by period so that a partition gets few files of even size.

    Rows are sorted inside each file so that min/max statistics prune by group and time.
    """
    if period is None:
        groups.sortWithinPartitions("gid", "start_time").write.mode("append").format(file_format).save(path)
        return
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}")
    d = groups.withColumn("period", F.to_date(F.date_trunc(period, "start_time"))).hint("rebalance", "period")
    (d.sortWithinPartitions("period", "gid", "start_time")
     .write.mode("append").partitionBy("period").format(file_format).save(path))


def read_segments(spark: SparkSession, path: str, file_format: str = "parquet", period: str | None = "day") -> DataFrame:
    layout = schema.SEGMENT_GROUPS if period is None else f"{_ddl()}, period date"
    return spark.read.schema(layout).format(file_format).load(path)


def _ddl() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.SEGMENT_GROUPS.fields)


def write_series(series: DataFrame, path: str) -> None:
    """The table of series beside a store, in order of ids, so that looking up a few of them reads few row groups."""
    series.repartitionByRange("tid").sortWithinPartitions("tid").write.parquet(path)


def scan_range(groups: DataFrame, period: str | None = None, start_from=None, end_to=None, gids=None) -> DataFrame:
    """Segments with start_time >= start_from and end_time <= end_to of some groups.

    With `period` the partitions before the first possible one are pruned as well.
    """
    d = groups
    if start_from is not None:
        bound = F.lit(start_from).cast("timestamp")
        d = d.where(F.col("start_time") >= bound)
        if period:
            d = d.where(F.col("period") >= F.to_date(F.date_trunc(period, bound)))
    if end_to is not None:
        bound = F.lit(end_to).cast("timestamp")
        d = d.where(F.col("end_time") <= bound)
        if period:
            d = d.where(F.col("period") <= F.to_date(F.date_trunc(period, bound)))
    if gids is not None:
        d = d.where(F.col("gid").isin([int(g) for g in gids]))
    return d


def compact(spark: SparkSession, path: str, target: str, files: int, period: str | None = "day",
            file_format: str = "parquet") -> None:
    """Rewrite a store into `target` with about `files` files, clustered by time, group and start.

    Readers switch to the new folder once this has returned; the old one stays until then.
    """
    d = read_segments(spark, path, file_format, period)
    order = [*(["period"] if period else []), "gid", "start_time"]
    ranged = d.repartitionByRange(files, *order).sortWithinPartitions(*order)
    writer = ranged.write.format(file_format)
    (writer.partitionBy("period") if period else writer).save(target)


def stored_bytes(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row `bytes`: total length of the files below a folder, without reading them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def deduplicate(groups: DataFrame) -> DataFrame:
    """One row per (gid, start_time, members)."""
    return groups.dropDuplicates(["eps", "gid", "start_time", "tids"])


def union_stores(*stores: DataFrame) -> DataFrame:
    first, *rest = stores
    for store in rest:
        first = first.unionByName(store, allowMissingColumns=True)
    return first


def check_model_types(client: DataFrame, server: DataFrame) -> None:
    """Every (mtid, name) of the client must be the server's; raises otherwise."""
    clash = client.join(server.withColumnRenamed("name", "server_name"), "mtid", "left").where(
        ~F.col("name").eqNullSafe(F.col("server_name"))).limit(1).take(1)
    if clash:
        raise ValueError(f"model types differ: {clash[0]}")


def merge_stores(server_series: DataFrame, server_groups: DataFrame, client_series: DataFrame,
                 client_groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Series and segments of both stores; ids of the client continue after those of the server."""
    def last(df, column):
        return F.coalesce(df.agg(F.max(column).alias(column)).scalar(), F.lit(0))

    tid0, gid0 = last(server_series, "tid"), last(server_series, "gid")
    series = client_series.withColumns({"tid": (F.col("tid") + tid0).cast("int"), "gid": (F.col("gid") + gid0).cast("int")})
    shift = last(server_series, "tid")
    groups = (client_groups.withColumn("__shift", shift)
              .withColumns({"gid": (F.col("gid") + gid0).cast("int"),
                            "tids": F.expr("transform(tids, t -> cast(t + __shift as int))")})
              .drop("__shift"))
    return union_stores(server_series, series), union_stores(server_groups, groups)
