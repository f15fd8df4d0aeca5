"""Session settings and shared working folders."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}  # of local sessions that name no shared folder


def prepare(spark: SparkSession) -> SparkSession:
    """Calendar keys and grids are defined in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared folder the cluster names in spark.checkpoint.dir.

    Only a local session without that setting (tests) gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        base = _local[app] = _local.get(app) or tempfile.mkdtemp(prefix="tidegauge-")
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")


def written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back."""
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
