"""Ordered computations over series of any length, in two levels.

A window partitioned by series alone puts a hot series into one task. These functions split a
series into buckets along its order, run the window inside (series, bucket), and carry only one
summary row per bucket across. `bucket` must be monotone in the order columns and should hold a
bounded number of rows, e.g. `floor(ts / width)` for regular series.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidegauge.session import written

BUCKET = "__bucket"
_FULL = (W.unboundedPreceding, W.currentRow)
_BEFORE = (W.unboundedPreceding, -1)


def time_bucket(ts: str, width_ms: int) -> Column:
    return F.floor(F.unix_millis(ts) / F.lit(width_ms))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column, name: str = "rn") -> DataFrame:
    """1-based position of every row within its key, ordered by `order`."""
    at = [*keys, BUCKET]
    d = df.withColumn(BUCKET, bucket)
    offsets = (d.groupBy(*at).agg(F.count(F.lit(1)).alias("__n"))
               .withColumn("__before", F.coalesce(
                   F.sum("__n").over(W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(*_BEFORE)), F.lit(0)))
               .drop("__n"))
    local = d.withColumn("__rn", F.row_number().over(W.partitionBy(*at).orderBy(*order)))
    return (local.join(offsets, at)
            .withColumn(name, F.col("__rn") + F.col("__before"))
            .drop("__rn", "__before", BUCKET))


def numbered(df: DataFrame, order: Sequence[str], name: str = "rn") -> DataFrame:
    """1-based position of every row of a whole table, e.g. of series names.

    The table is cut into ranges of about equal size and written, since ranges are sampled and must
    not change between the counting and the numbering pass.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id())
    d = written(df.sparkSession, d, "ranges")
    return positions(d, [], order, F.col("__range"), name).drop("__range")


def with_neighbour(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], bucket: Column,
                   step: int = -1, name: str = "prev", keep_bucket: bool = False) -> DataFrame:
    """Add a struct `name` with `cols` of the previous (step=-1) or next (step=+1) row of the key."""
    shift, edge = (F.lag, F.max_by) if step < 0 else (F.lead, F.min_by)
    at = [*keys, BUCKET]
    d = df.withColumn(BUCKET, bucket)
    row = F.struct(*cols)
    edges = (d.groupBy(*at).agg(edge(row, F.col(order)).alias("__edge"))
             .withColumn("__carry", shift("__edge").over(W.partitionBy(*keys).orderBy(BUCKET)))
             .drop("__edge"))
    local = d.withColumn("__local", shift(row).over(W.partitionBy(*at).orderBy(order)))
    out = (local.join(edges, at)
           .withColumn(name, F.coalesce("__local", "__carry"))
           .drop("__local", "__carry"))
    return out if keep_bucket else out.drop(BUCKET)


def fill_forward(df: DataFrame, keys: Sequence[str], order: str, col: str | Sequence[str], bucket: Column,
                 name: str | None = None) -> DataFrame:
    """Replace NULL in `col` by the last non-NULL value of the key; of several columns, each for itself."""
    at = [*keys, BUCKET]
    cols = [col] if isinstance(col, str) else list(col)
    d = df.withColumn(BUCKET, bucket)
    before = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(*_BEFORE)
    tails = (d.groupBy(*at)
             .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__tail_{c}") for c in cols])
             .withColumns({f"__carry_{c}": F.last(f"__tail_{c}", ignorenulls=True).over(before) for c in cols})
             .drop(*[f"__tail_{c}" for c in cols]))
    here = W.partitionBy(*at).orderBy(order).rowsBetween(*_FULL)
    local = d.withColumns({f"__local_{c}": F.last(c, ignorenulls=True).over(here) for c in cols})
    return (local.join(tails, at)
            .withColumns({(name or c): F.coalesce(f"__local_{c}", f"__carry_{c}") for c in cols})
            .drop(*[f"__{part}_{c}" for part in ("local", "carry") for c in cols], BUCKET))


def consecutive_runs(df: DataFrame, keys: Sequence[str], order: str, step: str, bucket: Column) -> DataFrame:
    """Maximal runs of rows whose `order` (a long) grows by exactly `step` (a column name).

    Returns keys, `first`, `last` (of `order`) and `n`. Runs inside a bucket are finished there;
    only the pieces touching a bucket edge, at most two per bucket, meet in one window per key.
    """
    d = with_neighbour(df.select(*keys, order, step), keys, order, [order], bucket, keep_bucket=True)
    at = [*keys, BUCKET]
    new = F.col("prev").isNull() | (F.col(order) - F.col(f"prev.{order}") != F.col(step))
    pieces = (d.withColumn("__new", new.cast("int"))
              .withColumn("__isl", F.sum("__new").over(W.partitionBy(*at).orderBy(order).rowsBetween(*_FULL)))
              .groupBy(*at, "__isl")
              .agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"),
                   F.max("__new").alias("__starts"))
              .withColumn("__edge", (F.col("__starts") == 0)
                          | (F.col("__isl") == F.max("__isl").over(W.partitionBy(*at)))))
    # inner pieces keep their bucket as a salt, edge pieces of a key share the NULL salt
    salt = F.when(~F.col("__edge"), F.col(BUCKET))
    return (pieces.withColumn("__salt", salt)
            .withColumn("__run", F.sum("__starts").over(
                W.partitionBy(*keys, "__salt").orderBy(BUCKET, "first").rowsBetween(*_FULL)))
            .groupBy(*keys, "__salt", "__run")
            .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
            .drop("__salt", "__run"))
