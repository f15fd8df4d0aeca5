"""Running ids of series that first appear while a stream runs."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tidegauge.sources.readings import assign_tids, number_sources
from tidegauge.streaming.ingest import start_batches, write_batch

SOURCES = "tid int, source string, path string, batch long"


def known_sources(spark, path: str, before: int | None = None) -> DataFrame:
    """(tid, source, path) of all sources, or of those numbered before a micro-batch."""
    try:
        d = spark.read.schema(SOURCES).parquet(path)
    except AnalysisException:  # no batch has been numbered yet
        d = spark.createDataFrame([], SOURCES)
    return (d if before is None else d.where(F.col("batch") < before)).drop("batch")


def append_numbered(readings: DataFrame, points: str, sources: str, checkpoint: str, once: bool = True,
                    use: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Points (tid, ts, value) of a stream of (source, path, ts, value), with ids that go on where the last micro-batch ended.

    A micro-batch numbers the sources it is the first to see, in their order, into its own partition of the folder `sources`,
    and then writes its points. Run again after a failure it reads only what earlier ones numbered, so its ids stay the same.
    `use` gets the points and the number of the batch instead of their being written to the folder `points`.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = known_sources(spark, sources, batch_id)
        first = 1 + (known.agg(F.max("tid").alias("last")).first().last or 0)
        new = batch.select("source", "path").distinct().join(known, ["source", "path"], "left_anti")
        write_batch(number_sources(new, first_tid=first), batch_id, sources)
        numbered = assign_tids(batch, known_sources(spark, sources, batch_id + 1))
        if use:
            use(numbered, batch_id)
        else:
            write_batch(numbered, batch_id, points)

    return start_batches(readings, write, checkpoint, once)
