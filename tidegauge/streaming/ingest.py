"""Streams of readings: regular ticks by watermark, duplicates, sinks."""

from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime
from threading import Event

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

# Fixed value: the state store that stateful processors need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, schema, file_format: str = "parquet", glob: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(file_format)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


MARK = "is_end"
FOR_GOOD = datetime(9999, 12, 31)


def with_end_marks(stream: DataFrame, path: str) -> DataFrame:
    """The stream together with the end marks that `end_stream` puts into the folder `path`.

    A mark is a row with a time and nothing else. It moves the watermark like any row, so all that waits for later rows is
    emitted by the stream itself; `watermarked` takes it out of the data again.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], "ts timestamp").write.mode("append").parquet(path)  # a file stream needs its folder
    marks = spark.readStream.schema("ts timestamp").parquet(path).withColumn(MARK, F.lit(True))
    return stream.withColumn(MARK, F.lit(False)).unionByName(marks, allowMissingColumns=True)


def end_stream(spark: SparkSession, path: str, at: datetime = FOR_GOOD) -> None:
    """Ends a stream `with_end_marks` of that folder at a time: its next run emits all before `at` less its delay, older rows are late from then on.

    Put the mark down once a run has read the last rows: within one micro-batch nothing is late, across them it is.
    """
    spark.range(1).select(F.lit(at).cast("timestamp").alias("ts")).write.mode("append").parquet(path)


def watermarked(events: DataFrame, delay: str) -> DataFrame:
    """Events with a watermark on `ts`, without the end marks that moved it."""
    d = events.withWatermark("ts", delay)
    if MARK not in events.columns:
        return d
    # names the time, so that Spark does not move the filter below the watermark, where marks would go unseen
    return d.where(~F.col(MARK) | F.col("ts").isNull()).drop(MARK)


def regularize_stream(events: DataFrame, key: str, si: str, delay: str, how: str = "max") -> DataFrame:
    """One value per (key, tick); a tick is emitted once the watermark has passed its end."""
    aggregates = {"max": F.max("value"), "mean": F.avg("value"), "sum": F.sum("value"), "count": F.count("value")}
    return (watermarked(events, delay).groupBy(F.window("ts", si), key)
            .agg(aggregates[how].cast("float").alias("value"))
            .select(key, F.col("window.start").alias("ts"), "value"))


def drop_late_and_duplicates(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """First row per key within the watermark; rows behind the watermark are dropped."""
    return watermarked(events, delay).dropDuplicatesWithinWatermark(keys)


@contextmanager
def _settings(spark: SparkSession, state_partitions: int | None):
    """A stateful query keeps the number of partitions and the state store that it first starts with; the session's stay as they were."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    if state_partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(state_partitions)
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def append_to(df: DataFrame, path: str, checkpoint: str, file_format: str = "parquet",
              partition_by: list[str] | None = None, once: bool = True,
              state_partitions: int | None = None) -> StreamingQuery:
    """Bulk mode: append finalized rows, exactly once through the file sink's log."""
    writer = df.writeStream.format(file_format).option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if once:
        writer = writer.trigger(availableNow=True)
    with _settings(df.sparkSession, state_partitions):
        return writer.start(path)


def run(query: StreamingQuery) -> None:
    query.awaitTermination()


class LateRows(StreamingQueryListener):
    """Counts rows dropped behind the watermark over all batches of all queries of a session, however many there are.

    A row dropped by one stateful operator does not reach the next, so their counts add up. Events arrive with a delay;
    `of` waits for the end of the query first.
    """

    def __init__(self, spark: SparkSession):
        self._counts: dict[str, int] = {}
        self._ended: dict[str, Event] = {}
        self.spark = spark
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        self._ended.setdefault(str(event.runId), Event())

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self._counts[run] = self._counts.get(run, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended.setdefault(str(event.runId), Event()).set()

    def of(self, query: StreamingQuery, timeout: float = 60.0) -> int:
        query.awaitTermination()
        run = str(query.runId)
        if not self._ended.setdefault(run, Event()).wait(timeout):
            raise TimeoutError("the end of the query was not reported")
        return self._counts.get(run, 0)

    def close(self) -> None:
        self.spark.streams.removeListener(self)


def open_windows(events: DataFrame, emitted: DataFrame, key: str, si: str, how: str = "max") -> DataFrame:
    """At the end of a stream: the regular values of the same events, as a table, that regularize_stream has not emitted."""
    aggregates = {"max": F.max("value"), "mean": F.avg("value"), "sum": F.sum("value"), "count": F.count("value")}
    every = (events.groupBy(F.window("ts", si), key).agg(aggregates[how].cast("float").alias("value"))
             .select(key, F.col("window.start").alias("ts"), "value"))
    return every.join(emitted.select(key, "ts"), [key, "ts"], "left_anti")


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """A micro-batch overwrites its own `batch` partition, so a retry changes nothing."""
    (batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))


def start_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True,
                  state_partitions: int | None = None) -> StreamingQuery:
    """Hands every micro-batch and its number to `write`, at least once each."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(write)
    if once:
        writer = writer.trigger(availableNow=True)
    with _settings(df.sparkSession, state_partitions):
        return writer.start()


def append_batches(df: DataFrame, path: str, checkpoint: str, once: bool = True,
                   state_partitions: int | None = None) -> StreamingQuery:
    """Online mode: every micro-batch is a partition of its own."""
    return start_batches(df, lambda batch, batch_id: write_batch(batch, batch_id, path), checkpoint, once, state_partitions)
