"""Readings from files: one file per series, or one column per signal."""

from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.plans.lookup import required
from tidegauge.plans.ordered import numbered


def _source(raw: DataFrame) -> list[Column]:
    """A partition folder `source=...` names the series, else the file does; `path` tells apart files of one name."""
    if "source" in raw.columns:
        name = F.col("source").cast("string")
        return [name.alias("source"), name.alias("path")]
    return [F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_path").alias("path")]


def parse_time(text: Column, date_format: str = "unix", time_zone: str = "UTC") -> Column:
    """Unix seconds, `java` milliseconds, or a date pattern in a time zone."""
    if date_format == "unix":
        return F.timestamp_seconds(text.cast("long"))
    if date_format == "java":
        return F.timestamp_millis(text.cast("long"))
    return F.to_utc_timestamp(F.to_timestamp(text, date_format), time_zone)


def separators(locale: str) -> tuple[str, str, str]:
    """Grouping, decimal and minus sign of a language tag, as the Java runtime of the session knows them."""
    text = SparkContext._active_spark_context._jvm.java.text
    locales = SparkContext._active_spark_context._jvm.java.util.Locale
    tag = locales.forLanguageTag(locale.replace("_", "-"))
    if not tag.getLanguage() or tag.getLanguage() not in locales.getISOLanguages():
        raise ValueError(f"unknown locale {locale!r}")
    signs = text.DecimalFormatSymbols.getInstance(tag)
    if signs.getZeroDigit() != "0":
        raise ValueError(f"numbers of locale {locale!r} have digits of their own")
    return signs.getGroupingSeparator(), signs.getDecimalSeparator(), signs.getMinusSign()


def parse_number(text: Column, locale: str = "en") -> Column:
    """A number with the grouping and decimal signs of the locale."""
    grouping, decimal, minus = separators(locale)
    # spaces of any width group where one does, apostrophes likewise
    drop = next((kind for kind in (" \u00a0\u202f\u2009", "'\u2019") if grouping in kind), grouping)
    return F.translate(text, decimal + minus + "\u2212" + drop, ".--").cast("float")


def read_csv(spark: SparkSession, paths: str | Sequence[str], n_columns: int = 2, time_column: int = 0, value_column: int = 1,
             separator: str = ",", header: bool = False, date_format: str = "unix", time_zone: str = "UTC",
             locale: str = "en", glob: str | None = None, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """(source, path, ts, value) from text files, gzipped or not; a malformed row raises. `stream` reads files as they arrive in one folder."""
    fields = ", ".join(f"c{i} string" for i in range(n_columns))
    if files_per_batch and not stream:
        raise ValueError("files_per_batch is for streams")
    reader = (spark.readStream if stream else spark.read).schema(fields).option("sep", separator).option("header", header).option("mode", "FAILFAST")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.csv(paths)
    ts = parse_time(F.col(f"c{time_column}"), date_format, time_zone)
    return raw.select(*_source(raw), ts.alias("ts"), parse_number(F.col(f"c{value_column}"), locale).alias("value"))


def read_columnar(spark: SparkSession, paths: str | Sequence[str], file_format: str, time_column: str = "ts",
                  value_column: str = "value", glob: str | None = None) -> DataFrame:
    """(source, path, ts, value) from ORC or Parquet: two columns are read, time is cut to milliseconds."""
    reader = spark.read.format(file_format)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    ts = F.date_trunc("millisecond", F.col(time_column).cast("timestamp"))
    raw = reader.load(paths if isinstance(paths, str) else list(paths))
    return raw.select(*_source(raw), ts.alias("ts"), F.col(value_column).cast("float").alias("value"))


def read_orc(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    return read_columnar(spark, paths, "orc", **options)


def read_parquet(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    return read_columnar(spark, paths, "parquet", **options)


def number_sources(readings: DataFrame, name: str = "source", first_tid: int = 1) -> DataFrame:
    """(tid, source[, path]): running numbers over the sorted distinct sources, files of one name in order of their paths."""
    keys = [name, *(["path"] if "path" in readings.columns else [])]
    ids = numbered(readings.select(*keys).distinct(), keys, "tid")
    return ids.select((F.col("tid") + (first_tid - 1)).cast("int").alias("tid"), *keys)


def assign_tids(readings: DataFrame, sources: DataFrame, name: str = "source") -> DataFrame:
    """(tid, ts, value); a reading whose source is not listed raises."""
    keys = [name, *(["path"] if "path" in readings.columns and "path" in sources.columns else [])]
    return required(readings, sources.select("tid", *keys), keys, "sources").select("tid", "ts", "value")


# Column names treated as time, and the index column dropped from multivariate files.
TIME_NAMES = ("datetime", "ts", "timestamp", "time")
INDEX_NAME = "__index_level_0__"


def unpivot_signals(wide: DataFrame, time_column: str | None = None) -> DataFrame:
    """(source, ts, value): one series per value column of a multivariate table."""
    time_column = time_column or next(c for c in wide.columns if c.lower() in TIME_NAMES)
    signals = [c for c in wide.columns if c not in (time_column, INDEX_NAME)]
    floats = wide.select(F.col(time_column).alias("ts"), *[F.col(f"`{c}`").cast("float").alias(c) for c in signals])
    return floats.unpivot(["ts"], [f"`{c}`" for c in signals], "source", "value").where("value IS NOT NULL").select(
        "source", "ts", "value")


def pivot_signals(points: DataFrame, signals: Sequence, key: str = "tid") -> DataFrame:
    """One row per timestamp with one column per listed signal."""
    return points.groupBy("ts").pivot(key, list(signals)).agg(F.first("value"))


def result_json(df: DataFrame) -> DataFrame:
    """One JSON object per row."""
    return df.select(F.to_json(F.struct(*[df[c] for c in df.columns])).alias("json"))
