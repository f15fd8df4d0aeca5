"""Continuous segmentation with bounded state, and the view of finalized plus provisional segments."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

from tidegauge import schema
from tidegauge.functions.models import Fit, segment_run
from tidegauge.operators.compress import (CHUNK_TICKS, LENGTH_BOUND, check_options, chunk_ms, chunk_of,
                                          compress, default_models, runs, segment_table, tick_matrix, with_group)
from tidegauge.operators.view import clip, with_offsets
from tidegauge.streaming.ingest import watermarked

OUTPUT = T.StructType([*schema.SEGMENT_GROUPS.fields, T.StructField("is_final", T.BooleanType())])
_STATE = T.StructType([
    T.StructField("ms", T.ArrayType(T.LongType())), T.StructField("tid", T.ArrayType(T.IntegerType())),
    T.StructField("value", T.ArrayType(T.FloatType())), T.StructField("si_ms", T.LongType()),
    T.StructField("group_size", T.IntegerType()), T.StructField("chunk_end", T.LongType()),
    T.StructField("shown", T.LongType())])


class Segmenter(StatefulProcessor):
    """Keeps the points of the open segment of one (group, part, chunk) and emits segments as they close.

    A tick is used once the watermark has passed it. Segments are those of `compress` on the same
    points, so a stream and a batch over the same chunks store the same rows.
    """

    def __init__(self, eps: float, models: tuple, length_bound: int, maximum_latency: int):
        self.eps, self.models, self.length_bound, self.latency = eps, models, length_bound, maximum_latency

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", _STATE)
        self.arrow_schema = to_arrow_schema(schema.SEGMENT_GROUPS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        si_ms, size, end = (int(new[c].iloc[0]) for c in ("si_ms", "group_size", "chunk_end"))
        ms, tid, value = (new[c].to_numpy() for c in ("ms", "tid", "value"))
        shown = -1 << 62
        if self.state.exists():
            old = self.state.get()
            ms, tid, value = (np.concatenate((np.array(o, dtype=n.dtype), n)) for o, n in zip(old[:3], (ms, tid, value)))
            shown = old[6]
        yield from self._advance(key, ms, tid, value, si_ms, size, end, shown, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            ms, tid, value, si_ms, size, end, shown = self.state.get()
            arrays = np.array(ms, dtype=np.int64), np.array(tid, dtype=np.int32), np.array(value, dtype=np.float32)
            yield from self._advance(key, *arrays, si_ms, size, end, shown, timerValues)

    def close(self) -> None:
        pass

    def _advance(self, key, ms, tid, value, si_ms, size, chunk_end, shown, timer_values):
        watermark = timer_values.getCurrentWatermarkInMs()
        ready = ms + si_ms <= watermark
        final, temporary, keep_from = [], [], None
        if ready.any():
            ticks, tids, values = tick_matrix(ms[ready], tid[ready], value[ready])
            ended = watermark >= min(int(ticks[-1]) + 2 * si_ms, chunk_end)
            for first, end, active in runs(ticks, values, si_ms):
                run, gaps = values[first:end][:, active], size - len(active)
                flush = end < len(ticks) or ended
                found, at = segment_run(run, si_ms, self.eps, self.models, self.length_bound, gaps, flush)
                final += [(int(ticks[first + s]), si_ms, mtid, fit, tids[active], gaps, run[s:s + fit.length])
                          for s, mtid, fit in found]
                if at < len(run):
                    keep_from, buffer = int(ticks[first + at]), run[at:]
                    hidden = int((ticks[first + at:end] > shown).sum())
                    if self.latency and hidden >= self.latency:
                        mtid, fit = self._whole(buffer, si_ms)
                        temporary.append((keep_from, si_ms, mtid, fit, tids[active], gaps, buffer))
                        shown = int(ticks[end - 1])
        kept = ~ready if keep_from is None else ms >= keep_from
        if kept.any():
            self.state.update((ms[kept].tolist(), tid[kept].tolist(), value[kept].tolist(), si_ms, size, chunk_end, shown))
            # next: the first tick still in the future, or the proof that none follows the last one
            due = int(ms[~ready].min()) + si_ms if not ready.all() else min(int(ms.max()) + 2 * si_ms, chunk_end)
            self.handle.registerTimer(max(int(watermark) + 1, due))
        else:
            self.state.clear()
        for rows, is_final in ((final, True), (temporary, False)):
            if rows:
                table = segment_table([rows], [self.eps], [int(k) for k in key], self.arrow_schema)
                yield table.to_pandas().assign(is_final=is_final)

    def _whole(self, buffer, si_ms):
        """The first model that still covers the whole buffer, else its raw values."""
        for model in self.models:
            fit = model.fit(buffer, si_ms, self.eps)
            if fit.length == len(buffer) and not np.isnan(fit.size):
                return model.mtid, fit
        payload = buffer.astype("<f4").tobytes()
        return schema.RAW, Fit(len(buffer), float(len(payload)), payload=payload)


def segment_stream(points: DataFrame, eps: float = 0.0, si_ms: int | None = None, series: DataFrame | None = None,
                   delay: str = "0 seconds", models: tuple | None = None, length_bound: int = LENGTH_BOUND,
                   chunk_ticks: int = CHUNK_TICKS, maximum_latency: int = 0) -> DataFrame:
    """Segments of a stream of regular points; provisional ones (is_final = false) every
    `maximum_latency` ticks that no segment covers yet. State is keyed by (group, chunk) and leaves
    with the chunk, so it stays bounded for any number of ticks. Start it with `ingest.append_batches` or
    `ingest.start_batches`, which choose the state store that it needs."""
    check_options([eps], length_bound, chunk_ticks, maximum_latency=maximum_latency)
    d = with_group(watermarked(points, delay), series, si_ms)
    chunk = chunk_of(F.col("ts"), F.col("si_ms"), F.col("group_size"), chunk_ticks)
    width = chunk_ms(F.col("si_ms"), F.col("group_size"), chunk_ticks)
    keyed = d.select("gid", "part", chunk.alias("chunk"), "ts", F.unix_millis("ts").alias("ms"), "tid",
                     F.col("value").cast("float").alias("value"), "si_ms", "group_size",
                     ((chunk + 1) * width).cast("long").alias("chunk_end"))
    processor = Segmenter(float(eps), models or default_models(length_bound), length_bound, maximum_latency)
    return keyed.groupBy("gid", "part", "chunk").transformWithStateInPandas(
        processor, outputStructType=OUTPUT, outputMode="append", timeMode="eventtime")


def finish(points: DataFrame, finals: DataFrame, **options) -> DataFrame:
    """End of a stream: compress the points after the last finalized segment of each (tid, chunk)."""
    groups = with_group(points, options.get("series"), options.get("si_ms"))
    chunk_ticks = options.get("chunk_ticks", CHUNK_TICKS)
    chunk = chunk_of(F.col("ts"), F.col("si_ms"), F.col("group_size"), chunk_ticks)
    covered = (finals.select("chunk", "end_time", F.explode("tids").alias("tid")).groupBy("tid", "chunk")
               .agg(F.max("end_time").alias("covered")))
    rest = (groups.withColumn("chunk", chunk).join(covered, ["tid", "chunk"], "left")
            .where(F.col("covered").isNull() | (F.col("ts") > F.col("covered"))).select("tid", "ts", "value"))
    return compress(rest, **options)


def online_view(segments: DataFrame) -> DataFrame:
    """Finalized segments and, per open chunk, the latest provisional one cut to start after them.

    `segments` has is_final and a `batch` that grows with time.
    """
    keys = ["eps", "gid", "part", "chunk"]
    columns = [f.name for f in schema.SEGMENT_GROUPS.fields]
    finals = segments.where("is_final")
    newest = (segments.where("NOT is_final").groupBy(*keys)
              .agg(F.max_by(F.struct(*columns), F.struct("batch", "end_time")).alias("s")).select("s.*"))
    last = finals.groupBy(*keys).agg(F.max("end_time").alias("__done"))
    open_ = with_offsets(newest.join(last, keys, "left"))
    after = F.coalesce(F.timestamp_millis(F.unix_millis("__done") + 1), F.col("start_time"))
    trimmed = clip(open_, ts_from=after)
    out = [*columns, "skip", "n_stored"]
    return with_offsets(finals.select(*columns)).select(*out).unionByName(trimmed.select(*out))
