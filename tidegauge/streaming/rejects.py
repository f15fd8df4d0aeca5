"""Readings that a stream can't use stay in it with a reason instead of being dropped."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidegauge.streaming.ingest import MARK, watermarked

BUCKET_MS = 3_600_000


class Sorter(StatefulProcessor):
    """Remembers the milliseconds seen of one (series, bucket of time) until the watermark has passed the bucket."""

    def __init__(self, key: str, bucket_ms: int):
        self.key, self.bucket_ms = key, bucket_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ms array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows), ignore_index=True).sort_values(["value", "us"], kind="stable")
        watermark = timerValues.getCurrentWatermarkInMs()
        ms = d["us"].to_numpy() // 1000
        seen = np.array(self.seen.get()[0] if self.seen.exists() else [], dtype=np.int64)
        late = ms < watermark
        repeated = np.isin(ms, seen) | pd.Series(ms).duplicated().to_numpy()
        kept = np.union1d(seen[seen >= watermark], ms[~late])
        if len(kept):
            self.seen.update((kept.tolist(),))
            self.handle.registerTimer(int(key[1] + 1) * self.bucket_ms)
        yield d[[self.key, "us", "value"]].assign(reason=np.where(late, "late", np.where(repeated, "repeated", None)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def sort_stream(readings: DataFrame, delay: str, key: str = "tid", bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(key, ts, value, reason): all readings of a stream, null `reason` for those to keep.

    Refused are readings without key, time or number (`no number`: null or NaN), those older than the watermark when they arrive
    (`late`), and all but the first of a key in one millisecond (`repeated`; of one micro-batch the smallest value comes first).
    State is keyed by key and bucket of time, so a key with most readings is many small states, and each leaves with its bucket.
    """
    d = readings if MARK in readings.columns else readings.withColumn(MARK, F.lit(False))
    d = d.select(key, "ts", F.col("value").cast("double").alias("value"), MARK)
    number = F.col("value").isNotNull() & ~F.isnan("value") & F.col("ts").isNotNull() & F.col(key).isNotNull()
    # a plain number carries the time: rows with the watermark's own column are dropped by Spark where they are late
    us = F.unix_micros("ts")
    sound = watermarked(d.where(number | F.col(MARK)), delay).select(key, F.floor(us / F.lit(bucket_ms * 1000)).alias("bucket"), us.alias("us"), "value")
    kind = readings.schema[key].dataType.simpleString()
    sorted_ = sound.groupBy(key, "bucket").transformWithStateInPandas(
        Sorter(key, bucket_ms), outputStructType=f"`{key}` {kind}, us long, value double, reason string", outputMode="append", timeMode="eventtime")
    refused = d.where(~number & ~F.col(MARK)).select(key, "ts", "value", F.lit("no number").alias("reason"))
    return sorted_.select(key, F.timestamp_micros("us").alias("ts"), "value", "reason").unionByName(refused)
