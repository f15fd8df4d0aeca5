"""Online sink whose folders stay few, however many micro-batches it takes."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.streaming.ingest import start_batches

FAN = 10
_PUBLISHED = "_published"


def folders(n: int, fan: int = FAN) -> list[str]:
    """Names of the folders that hold the first n micro-batches: as many of every size fan ** k as the digits of n say."""
    names, at, size = [], 0, 1
    while size * fan <= n:
        size *= fan
    while size:
        for _ in range((n - at) // size):
            names.append(_name(at, size))
            at += size
        size //= fan
    return names


def _name(first: int, size: int) -> str:
    return f"{first}-{first + size - 1}"


def _files(spark: SparkSession, path: str):
    """The file system of a path, whatever its scheme, and a constructor of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, make = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(make(path))] if fs.exists(make(path)) else []


def published(spark: SparkSession, path: str) -> int:
    """Number of micro-batches that readers may see."""
    return max((int(n) for n in _names(spark, f"{path}/{_PUBLISHED}")), default=0)


def put_batch(batch: DataFrame, batch_id: int, path: str, fan: int = FAN) -> None:
    """Writes a micro-batch to its own folder, merges `fan` neighbouring folders of one size into one, then publishes the number of batches.

    A row is rewritten once for every power of `fan` in the number of batches. Nothing that is published is written again, so a batch
    that is handed over twice changes nothing. Folders that were merged stay for `fan` more batches, for readers that list them.
    """
    if fan < 2:
        raise ValueError("fan must be at least 2")
    spark, n = batch.sparkSession, batch_id + 1
    if published(spark, path) >= n:
        return
    batch = batch.withColumn("batch", F.lit(batch_id).cast("long"))
    batch.write.mode("overwrite").parquet(f"{path}/{_name(batch_id, 1)}")
    size = fan
    while n % size == 0:
        part = size // fan
        merged = spark.read.schema(batch.schema).parquet(*[f"{path}/{_name(first, part)}" for first in range(n - size, n, part)])
        merged.write.mode("overwrite").parquet(f"{path}/{_name(n - size, size)}")
        size *= fan
    fs, make = _files(spark, path)
    fs.create(make(f"{path}/{_PUBLISHED}/{n}"), True).close()
    kept = {name for m in range(max(1, n - fan + 1), n + 1) for name in folders(m, fan)}
    for name in set(_names(spark, path)) - kept - {_PUBLISHED}:
        fs.delete(make(f"{path}/{name}"), True)
    for name in _names(spark, f"{path}/{_PUBLISHED}"):
        if int(name) < n:
            fs.delete(make(f"{path}/{_PUBLISHED}/{name}"), False)


def append_compacted(df: DataFrame, path: str, checkpoint: str, fan: int = FAN, once: bool = True,
                     state_partitions: int | None = None) -> StreamingQuery:
    """Online mode for streams that run for long: like append_batches, with about fan * log(batches) folders. Read it with read_compacted."""
    return start_batches(df, lambda batch, batch_id: put_batch(batch, batch_id, path, fan), checkpoint, once, state_partitions)


def read_compacted(spark: SparkSession, path: str, schema: str, fan: int = FAN) -> DataFrame:
    """Every row of the published micro-batches once, with the number of its `batch`. `schema` is that of the stream."""
    full = f"{schema}, batch long"
    n = published(spark, path)
    if n == 0:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(*[f"{path}/{name}" for name in folders(n, fan)])
