"""Stage tables: results that several later steps read, written once in the folder the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    Only in local mode a temporary folder of the session stands in for it; on a cluster that setting is required, as
    executors don't see each other's local folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("panelforge.work.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("panelforge.work.dir", root)
    return f"{root.rstrip('/')}/panelforge-stages/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again, so that plans that use it stay short."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
