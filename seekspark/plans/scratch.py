"""Tables in the shared folder, to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

FALLBACK_DIR = "/tmp/checkpoints/seekspark"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or FALLBACK_DIR).rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
