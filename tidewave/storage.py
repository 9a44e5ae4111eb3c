"""Tables written on the way, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where everything runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='tidewave-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again: computed once, however often it is used, and without its lineage."""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
