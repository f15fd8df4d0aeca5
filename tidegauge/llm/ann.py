"""Nearest neighbours by inner product with cross-polytope hashing.

Vectors are scaled by the largest norm and, where norms differ, get one more coordinate that makes their length 1; queries get 0
there, so the order of cosines is that of inner products. For each of TABLES tables a pseudo-rotation (three rounds of random signs and fast
Hadamard transform) is applied, and a vector goes to the bucket of its nearest signed axis. A query looks into the
PROBES nearest buckets of each table; what they hold is ranked by the exact inner product in double precision.

Equal vectors are indexed once, with their k + 1 smallest ids, which is all a result can show of them. Buckets with more than
BLOCK candidates or queries are dealt out as pairs of blocks, and each block gives the k + 1 best of each query, so neither
a hot bucket nor its pairs meet in one task. Queries that found fewer than k although there are more rows are compared with all
rows, in blocks.

Cases: vectors that are null, zero, of another length than most or hold null or non-finite components take no part, nor do rows without
id; rows that repeat count once; ties go to the smaller id; an id that repeats with several vectors stands for each of them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as S

from tidegauge.llm import text as T
from tidegauge.llm.jaccard import runs_of
from tidegauge.session import written

TABLES, PROBES = 16, 8
ALIKE = 1e-6  # lengths closer than this need no further coordinate
BLOCK = 2048
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix, in log2(width) steps."""
    n, half = x.shape[1], 1
    while half < n:
        parts = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([parts[:, :, 0] + parts[:, :, 1], parts[:, :, 0] - parts[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def signs(width: int, table: int) -> np.ndarray:
    return np.random.default_rng([SEED, table]).choice([-1.0, 1.0], size=(3, width))


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    for s in signs(x.shape[1], table):
        x = hadamard(x * s)
    return x


def lifted(x: np.ndarray, largest: float, query: bool, lift: bool) -> np.ndarray:
    """Unit vectors of a power of two of coordinates; `lift`: with one for the length."""
    n = x.shape[1]
    out = np.zeros((len(x), 1 << int(n + lift - 1).bit_length()))
    out[:, :n] = x / (np.linalg.norm(x, axis=1, keepdims=True) if query else largest)
    if lift and not query:
        out[:, n] = np.sqrt(np.maximum(0, 1 - (out * out).sum(axis=1)))
    return out


def axes(y: np.ndarray, probes: int) -> np.ndarray:
    """The `probes` nearest signed axes of every row, nearest first: 2 * axis, and 1 more if negative."""
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    if probes == 1:
        return np.argmax(both, axis=1)[:, None]
    best = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(both, best, axis=1), axis=1, kind="stable"), axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _buckets(largest: float, lift: bool, tables: int, probes: int, kind: str):
    """For every distinct vector its bucket in every table, and for those that queries have also the probed ones."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("embedding"))
            asks = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False))
            reps, packed = batch.column("rep").to_numpy(), [v.tobytes() for v in x.astype(kind)]
            points, questions = lifted(x, largest, False, lift), lifted(x[asks], largest, True, lift)
            for table in range(tables):
                own = axes(rotated(points, table), 1)[:, 0]
                probed = axes(rotated(questions, table), min(probes, 2 * points.shape[1])).ravel() if len(asks) else np.zeros(0, np.int64)
                row = np.concatenate([np.arange(len(x)), np.repeat(asks, len(probed) // max(1, len(asks)))])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(row), table), pa.int32()), pa.array(np.concatenate([own, probed]), pa.int32()),
                    pa.array(np.arange(len(row)) >= len(x)), pa.array(reps[row], pa.int64()), T.binary([packed[i] for i in row])],
                    names=["table", "bucket", "query", "rep", "vector"])
    return run


BUCKETS_DDL = "table int, bucket int, query boolean, rep bigint, vector binary"


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Column positions and scores of the k best of every row, all ties of the last among them."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        rows, at = np.nonzero(scores >= least[:, None])
    else:
        rows, at = np.nonzero(np.ones_like(scores, bool))
    values = scores[rows, at]
    order = np.lexsort((ids[at], -values, rows))
    rows, at, values = rows[order], at[order], values[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return (rows[rank < k], at[rank < k]), values[rank < k]


def _rank(k: int, kind: str):
    def vectors(packed):
        return np.frombuffer(b"".join(packed), kind).astype(np.float64).reshape(len(packed), -1)

    def run(batches):
        for table in runs_of(batches, ["table", "bucket", "i", "j"]):
            keys = [table[c].to_numpy() for c in ("table", "bucket", "i", "j")]
            cut = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in keys]))
            bounds = np.append(np.flatnonzero(cut), table.num_rows)
            query, reps, packed = table["query"].to_numpy(), table["rep"].to_numpy(), table["vector"].to_pylist()
            out = [], [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                asks, holds = a + np.flatnonzero(query[a:b]), a + np.flatnonzero(~query[a:b])
                if not len(asks) or not len(holds):
                    continue
                c = vectors([packed[i] for i in holds])
                for x in range(0, len(asks), 256):
                    some = asks[x:x + 256]
                    q = vectors([packed[i] for i in some])
                    (rows, at), values = best_of(reps[holds], q @ c.T, k)
                    out[0].append(reps[some[rows]])
                    out[1].append(reps[holds[at]])
                    out[2].append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["asking", "rep", "score"])
    return run


def _ranked(entries: DataFrame, k: int, kind: str) -> DataFrame:
    """(asking, rep, score): of every block of every bucket the k best of each query in it."""
    sizes = entries.groupBy("table", "bucket").agg(
        F.ceil(F.sum(F.when(F.col("query"), 0).otherwise(1)) / BLOCK).cast("int").alias("parts"), F.ceil(F.sum(F.when(F.col("query"), 1).otherwise(0)) / BLOCK).cast("int").alias("turns"))
    placed = entries.join(sizes.where("turns > 0 and parts > 0"), ["table", "bucket"])

    def block(n):
        return F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")

    def each(n):
        return F.sequence(F.lit(0), F.col(n) - 1)
    query = F.col("query")
    dealt = placed.withColumn("i", F.explode(F.when(query, each("parts")).otherwise(F.array(block("parts")))))
    dealt = dealt.withColumn("j", F.explode(F.when(query, F.array(block("turns"))).otherwise(each("turns"))))
    dealt = dealt.select("table", "bucket", "i", "j", "query", "rep", "vector").repartition("table", "bucket", "i", "j").sortWithinPartitions("table", "bucket", "i", "j", "rep")
    return dealt.mapInArrow(_rank(k, kind), "asking bigint, rep bigint, score double")


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def neighbours(vectors: DataFrame, queries, k: int = 20, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found of vectors(vec_id, embedding) for those rows where `queries` holds."""
    spark = vectors.sparkSession
    # components travel as they are stored and are multiplied as doubles
    kind = "f4" if vectors.schema["embedding"].dataType == S.ArrayType(S.FloatType()) else "f8"
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), queries.alias("asks")).where(F.col("vec_id").isNotNull() & sound)
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("embedding") == usual["n"]).dropDuplicates(["vec_id", "embedding"])
    length = F.sqrt(_dot("embedding", "embedding"))
    total, smallest, largest = rows.agg(F.count("*"), F.min(length), F.max(length)).first()
    lift = smallest < (1 - ALIKE) * largest
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    asked = rows.groupBy("embedding").agg(F.max("asks").alias("asks"))
    distinct = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).join(asked, "embedding")
    distinct = written(spark, distinct.select("embedding", "ids", F.element_at("ids", 1).alias("rep"), F.coalesce("asks", F.lit(False)).alias("asks")), "vectors")
    entries = distinct.mapInArrow(_buckets(largest, lift, tables, probes, kind), BUCKETS_DDL)
    members = distinct.select("rep", "ids")

    def lists(found: DataFrame) -> DataFrame:
        """For every asking vector the k + 1 best ids, as (less score, id)."""
        best = Window.partitionBy("asking").orderBy(F.desc("score"), "rep")
        once = found.groupBy("asking", "rep").agg(F.max("score").alias("score"))  # sums of another order may differ in the last bit
        top = once.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).join(members, "rep")
        pairs = F.transform("ids", lambda x: F.struct((-F.col("score")).alias("less"), x.alias("vec_id")))
        return top.groupBy("asking").agg(F.slice(F.sort_array(F.flatten(F.collect_list(pairs))), 1, k + 1).alias("near"))

    near = written(spark, lists(_ranked(entries, k + 1, kind)), "near")
    asking = distinct.where("asks")
    lacking = asking.join(near.where(F.size("near") >= min(k + 1, total)).select(F.col("asking").alias("rep")), "rep", "left_anti")
    if lacking.limit(1).count():
        lacking = lacking.select("rep").withColumn("lacks", F.lit(True))

        def pack(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("rep"), T.binary([v.tobytes() for v in matrix(batch.column("embedding")).astype(kind)])], names=["rep", "vector"])
        plain = distinct.select("rep", "embedding").mapInArrow(pack, "rep bigint, vector binary")
        key = [F.lit(-1).alias("table"), F.lit(0).alias("bucket")]
        everything = plain.select(*key, F.lit(False).alias("query"), "rep", "vector").union(
            plain.join(lacking.select("rep"), "rep").select(*key, F.lit(True).alias("query"), "rep", "vector"))
        again = lists(_ranked(everything, k + 1, kind))
        near = near.join(again.select("asking"), "asking", "left_anti").union(again)
    owners = rows.where("asks").join(distinct.select("embedding", "rep"), "embedding").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("asking"))
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = owners.join(near, "asking").select("query_id", F.posexplode(own).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))
