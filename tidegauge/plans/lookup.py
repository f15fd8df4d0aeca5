"""Joins with metadata in which no row may get lost."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def required(rows: DataFrame, meta: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Rows with the columns of `meta`; a row whose keys are not listed there raises when computed."""
    found = meta.withColumn("__listed", F.lit(True))
    shown = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    listed = F.coalesce("__listed", F.raise_error(F.concat(F.lit(f"not among the listed {what}: "), shown)).cast("boolean"))
    return rows.join(found, list(keys), "left").where(listed).drop("__listed")


def unlisted(rows: DataFrame, meta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that `required` would refuse, for a reject table."""
    return rows.join(meta.select(*keys).distinct(), list(keys), "left_anti")
