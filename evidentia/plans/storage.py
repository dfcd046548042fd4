"""Folders shared by the driver and the executors, and tables written there."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared folder (spark.checkpoint.dir).

    Only where that setting is absent, as in tests, the warehouse folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(
        spark.conf.get("spark.sql.warehouse.dir"), "_scratch"
    )
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def through_files(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    path = path or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
