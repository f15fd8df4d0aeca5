"""Table layouts and fixed ids shared by all modules."""

from pyspark.sql import types as T

# Ids of the model types, as stored in the `mtid` column.
RAW, CONSTANT, LINEAR, XOR = 1, 2, 3, 4
MODEL_NAMES = {RAW: "raw", CONSTANT: "pmc_mean", LINEAR: "swing", XOR: "gorilla"}
CLOSED_FORM = (CONSTANT, LINEAR)

# Bytes per stored item used by the size accounting.
SEGMENT_METADATA_BYTES = 24
POINT_BYTES = 16
GAP_BYTES = 4

POINTS = T.StructType([
    T.StructField("tid", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("value", T.FloatType()),
])

# One row is one model over `n_ticks` ticks of the series in `tids`. A tick i has the time
# start_time + i * si_ms. Closed-form models keep value(i) = b + a * i * si_ms in two columns so
# that Catalyst aggregates them without decoding; the others keep their values in `payload`,
# interleaved by tid at each tick, and carry per-member statistics for the same purpose.
SEGMENT_GROUPS = T.StructType([
    T.StructField("eps", T.DoubleType()),
    T.StructField("gid", T.IntegerType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("chunk", T.LongType()),
    T.StructField("start_time", T.TimestampType()),
    T.StructField("end_time", T.TimestampType()),
    T.StructField("si_ms", T.LongType()),
    T.StructField("n_ticks", T.IntegerType()),
    T.StructField("mtid", T.IntegerType()),
    T.StructField("a", T.DoubleType()),
    T.StructField("b", T.DoubleType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("tids", T.ArrayType(T.IntegerType())),
    T.StructField("n_gaps", T.IntegerType()),
    T.StructField("mins", T.ArrayType(T.FloatType())),
    T.StructField("maxs", T.ArrayType(T.FloatType())),
    T.StructField("sums", T.ArrayType(T.DoubleType())),
    T.StructField("model_bytes", T.IntegerType()),
])
