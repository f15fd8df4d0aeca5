"""Importance resampling towards a target distribution, by hashed n-gram features.

1. Words are runs of bytes that are no ASCII separators, A-Z lowered; features are runs of 1 to `longest` words joined by one space.
   The bucket of a feature is its CRC-32 modulo `buckets`; CRCs of all features of a batch come from one table of positions (`crc`).
2. Counters of both tables are summed per task, sent as compressed vectors and added up as they arrive. The driver gets `buckets`
   numbers a table, whatever the input.
3. Texts are read once more for their weight, the floored mean gain of their features. A score adds a Gumbel number from the
   digest of seed and id, so the highest scores are a draw without replacement in proportion to exp(weight / 1000).
4. Ranks come from ranges of rows by score, numbered apart from each other.

Texts are never shuffled; rows of numbers are, once.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm import text as T
from tidegauge.llm.crc import crc_sql, position_table
from tidegauge.plans.ordered import numbered
from tidegauge.session import written

# The ASCII bytes that are part of words once A-Z are lowered.
WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz"
OUTSIDE = ~(np.isin(np.arange(256), np.frombuffer(WORD_BYTES, np.uint8)) | (np.arange(256) >= 0x80))
PART = 1024


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of every row; row and bucket of every feature."""
    data = T.LOWER[data]
    start, end = T.spans(data, offsets, OUTSIDE[data])
    row = np.searchsorted(offsets, start, "right") - 1
    n_words = np.bincount(row, minlength=len(offsets) - 1)
    # words one after the other, a space behind each
    lengths = end - start + 1
    at = np.cumsum(lengths) - lengths
    joined = np.full(int(lengths.sum()), 0x20, np.uint8)
    joined[np.arange(len(joined)) - np.repeat(at, lengths) < np.repeat(lengths - 1, lengths)] = data[~OUTSIDE[data]]
    rows, hashes, table = [], [], position_table()
    for n in range(1, longest + 1):
        first = np.flatnonzero(row[:len(row) - n + 1] == row[n - 1:]) if len(row) >= n else np.zeros(0, np.int64)
        rows.append(row[first])
        hashes.append(table.crc32(joined, at[first], at[first + n - 1] + lengths[first + n - 1] - 1))
    return n_words, np.concatenate(rows), np.concatenate(hashes).astype(np.int64) % buckets


COUNTS = "part int, counts binary"


def _parts(counts: np.ndarray) -> pa.RecordBatch:
    padded = np.concatenate([counts, np.zeros(-len(counts) % PART, np.int64)]).reshape(-1, PART)
    return pa.RecordBatch.from_arrays([pa.array(range(len(padded)), pa.int32()), T.binary([T.packed(c) for c in padded])], names=["part", "counts"])


def _counts(longest: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in T.text_pieces(batch.column("text")):
                total += np.bincount(features(data, offsets, longest, buckets)[2], minlength=buckets)
        yield _parts(total)
    return run


def _sums(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[part] = sums.get(part, 0) + T.unpacked(blob, PART, np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), T.binary([T.packed(c) for c in sums.values()])], names=["part", "counts"])


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features of a table by bucket."""
    parts = texts.select("text").mapInArrow(_counts(longest, buckets), COUNTS).repartition("part").mapInArrow(_sums, COUNTS).collect()
    counts = np.zeros((-(-buckets // PART), PART), np.int64)
    for part, blob in parts:
        counts[part] += T.unpacked(blob, PART, np.int64)
    return counts.ravel()[:buckets]


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored, by bucket."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


WEIGHTS = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"


def _weights(longest: int, gain: tuple[bytes, int]):
    def run(batches):
        table = T.unpacked(gain[0], gain[1], np.int64)
        for batch in batches:
            found = [], [], []
            for _, _, data, offsets in T.text_pieces(batch.column("text")):
                n_words, row, bucket = features(data, offsets, longest, gain[1])
                n = np.bincount(row, minlength=len(offsets) - 1)
                total = np.zeros(len(n), np.int64)
                np.add.at(total, row, table[bucket])
                for column, x in zip(found, (n_words, n, np.where(n > 0, total // np.maximum(n, 1), 0))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64())] + [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in found],
                                             names=["doc_id", "n_words", "n_features", "weight"])
    return run


def resample(documents: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank (bigint) of every row of documents(doc_id, text), towards target(text).

    Of the N rows with an id and at least `least_words` words the floor(percent * N / 100) highest scores are drawn, ties to the smaller
    id; `rank` is their place from 1, null for others. Null and empty texts have no features and weight 0. A row without
    id has no score and isn't drawn, its features count. Repeated rows count and rank each by itself. Empty tables
    give no rows, an empty target gives gains by the documents' counts alone. Other columns are not looked at.
    """
    spark = documents.sparkSession
    columns = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    gain = gains(bucket_counts(columns, longest, buckets), bucket_counts(target, longest, buckets))
    weighed = columns.mapInArrow(_weights(longest, (T.packed(gain), buckets)), WEIGHTS)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weighed.withColumn("score", F.col("weight") + gumbel).withColumn("idle", F.col("score").isNull() | (F.col("n_words") < least_words))
    scored = written(spark, scored.withColumn("fall", -F.col("score")), "scores")
    drawn = scored.where(~F.col("idle")).count() * percent // 100
    ranked = numbered(scored, ["idle", "fall", "doc_id"], "place")
    rank = F.when(~F.col("idle") & (F.col("place") <= drawn), F.col("place").cast("bigint"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


# The same rows in DuckDB, with the parameters' defaults.
_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
ORACLE_SQL = f"""WITH docs AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w, row_number() OVER () AS k FROM documents),
 in_docs AS MATERIALIZED (SELECT k, unnest(w) AS word FROM docs), in_target AS MATERIALIZED (SELECT unnest({_WORDS}) AS word FROM benchmark),
 {crc_sql("SELECT word FROM in_docs UNION SELECT word FROM in_target")},
 s AS (SELECT crc % 10000 AS bucket, count(*) AS n FROM in_docs JOIN crcs USING (word) GROUP BY 1),
 t AS (SELECT crc % 10000 AS bucket, count(*) AS n FROM in_target JOIN crcs USING (word) GROUP BY 1),
 gain AS MATERIALIZED (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000)
   / ((s.n + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000)))) AS g FROM s LEFT JOIN t USING (bucket)),
 weights AS (SELECT k, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM in_docs JOIN crcs USING (word) JOIN gain ON bucket = crc % 10000 GROUP BY 1),
 scored AS MATERIALIZED (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
   FROM docs LEFT JOIN weights USING (k)),
 ranked AS (SELECT *, words >= 20 AND doc_id IS NOT NULL AS may, row_number() OVER (PARTITION BY words >= 20 AND doc_id IS NOT NULL ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
 CASE WHEN may AND place <= (SELECT count(*) FROM ranked WHERE may) * 10 // 100 THEN place END AS rank FROM ranked"""
