"""Exact medians from counts, so that no task ever holds the values of a whole series."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

# Magnitudes fall into order-preserving buckets of 1/128 octave: at most ~71,000 hold float32 values, ~540,000 doubles, and
# one bucket holds at most ~66,000 distinct float32 values. Buckets of doubles are cut twice more into STEPS equal parts, so
# that at most some thousand distinct values are left. Infinities and NaN have buckets of their own, NaN above all.
_BUCKETS_PER_OCTAVE = 128
_SHIFT = 1100 * _BUCKETS_PER_OCTAVE
_INFINITE, _NAN = 1 << 20, 1 << 21
_STEPS = 1 << 16


def _magnitude_bucket(v: Column) -> Column:
    size = F.abs(v)
    mag = F.when(size == float("inf"), F.lit(_INFINITE).cast("long")).otherwise(F.floor(F.log2(size) * _BUCKETS_PER_OCTAVE) + _SHIFT)
    return (F.when(F.isnan(v), F.lit(_NAN).cast("long")).when(v > 0, mag).when(v < 0, -mag).otherwise(F.lit(0).cast("long")))


def _part(v: Column, low: Column, high: Column) -> Column:
    """The one of STEPS equal parts between two bounds; all values in one where the bounds agree or aren't finite."""
    width = high / _STEPS - low / _STEPS
    usable = (width > 0) & (width < float("inf"))
    return F.when(usable, F.least(F.lit(_STEPS).cast("long"), F.floor((v - low) / width))).otherwise(F.lit(0).cast("long"))


def median_of_counts(hist: DataFrame, keys: Sequence[str], value: str, count: str, name: str = "median") -> DataFrame:
    """Median per key of a histogram (keys, value, count); mean of the two middle values."""
    w = W.partitionBy(*keys)
    ranked = (hist
              .withColumn("__cum", F.sum(count).over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)))
              .withColumn("__n", F.sum(count).over(w)))
    return _middle(ranked.withColumn("__lo", F.col("__cum") - F.col(count)), keys, value, name)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Median of a FLOAT or DOUBLE column per key in two or four passes of map-side combined counts.

    NaN is the largest value, as Spark orders it.
    """
    doubles = df.schema[value].dataType == T.DoubleType()
    d = df.where(F.col(value).isNotNull()).withColumn("__v", F.col(value).cast("double"))
    d = d.withColumn("__b0", _magnitude_bucket(F.col("__v")))
    at, extra = [*keys, "__b0"], []
    target = _targets(d.groupBy(*at).agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__low"), F.max("__v").alias("__high")), keys, "__b0")
    for level in range(1, 3 if doubles else 1):
        bucket = f"__b{level}"
        d = d.drop(*extra).join(target, at).withColumn(bucket, _part(F.col("__v"), F.col("__low"), F.col("__high")))
        extra = ["__n", "__base", "__low", "__high"]
        counts = d.groupBy(*at, bucket, "__n", "__base").agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__lo_v"), F.max("__v").alias("__hi_v"))
        counts = counts.withColumnsRenamed({"__lo_v": "__low", "__hi_v": "__high"})
        target = _targets(counts, at, bucket)
        at = [*at, bucket]
    inside = d.drop(*extra).join(target, at).groupBy(*at, "__v", "__n", "__base").agg(F.count(F.lit(1)).alias("__c"))
    ranked = (inside
              .withColumn("__cum", F.col("__base") + F.sum("__c").over(
                  W.partitionBy(*at).orderBy("__v").rowsBetween(W.unboundedPreceding, 0)))
              .withColumn("__lo", F.col("__cum") - F.col("__c")))
    return _middle(ranked, keys, "__v", name)


def _targets(counts: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """The buckets with the middle values: keys, bucket, number of all values, values before the bucket, its bounds."""
    w = W.partitionBy(*keys)
    if "__n" not in counts.columns:
        counts = counts.withColumns({"__n": F.sum("__c").over(w), "__base": F.lit(0).cast("long")})
    cum = F.col("__base") + F.sum("__c").over(w.orderBy(bucket).rowsBetween(W.unboundedPreceding, 0))
    d = counts.withColumn("__cum", cum).withColumn("__lo", F.col("__cum") - F.col("__c"))
    k1, k2 = F.floor((F.col("__n") + 1) / 2), F.floor((F.col("__n") + 2) / 2)
    hit = ((F.col("__lo") < k1) & (F.col("__cum") >= k1)) | ((F.col("__lo") < k2) & (F.col("__cum") >= k2))
    return d.where(hit).select(*keys, bucket, "__n", F.col("__lo").alias("__base"), "__low", "__high")


def _middle(ranked: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    k1, k2 = F.floor((F.col("__n") + 1) / 2), F.floor((F.col("__n") + 2) / 2)
    v = F.col(value).cast("double")
    at = lambda k: F.max(F.when((F.col("__lo") < k) & (F.col("__cum") >= k), v))
    return ranked.groupBy(*keys).agg(F.when(at(k1) == at(k2), at(k1)).otherwise((at(k1) + at(k2)) / 2).alias(name))
