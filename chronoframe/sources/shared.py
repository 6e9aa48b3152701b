"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a local session without one gets a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        named = f"file://{tempfile.mkdtemp(prefix='chronoframe-')}"
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """Writes df to the shared folder and reads it back, so that its lineage ends there."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
