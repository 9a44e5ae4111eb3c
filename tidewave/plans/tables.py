"""How the given tables stand in for recordings.

* epochs: ``embeddings``; a row is a trial of 64 samples, its label a condition.
* samples: ``events``; (user_id, event_type) is a channel of a session, ordered by event_id.
* windows: ``orders`` of a customer; an order opens a window that its date and
  priority bound. contacts: ``nation`` within ``region``, as contacts on a lead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial, condition, x (samples as doubles)."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.col("vec_id").cast("long").alias("trial"),
        F.col("label").cast("long").alias("condition"),
        F.transform("embedding", lambda v: v.cast("double")).alias("x"),
    )


def long_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial, condition, t, value: one row per sample."""
    each = epochs(spark, sf_dir).select("trial", "condition", F.posexplode("x").alias("t", "value"))
    return each.withColumn("t", F.col("t").cast("long"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, channel, i, onset (seconds), value: the samples of each channel in order."""
    rows = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id", "event_type").orderBy("event_id")
    return rows.select(
        F.col("user_id").cast("long").alias("session"),
        F.col("event_type").alias("channel"),
        (F.row_number().over(order) - 1).cast("long").alias("i"),
        seconds("ts").alias("onset"),
        F.col("value").cast("double").alias("value"),
    )


def seconds(column: str):
    """A timestamp as seconds since 1970, as a double."""
    return (F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1e6)).cast("double")


#: The same in DuckDB, for the oracles.
EPOCHS_SQL = """epochs as (
  select vec_id::bigint as trial, label::bigint as condition, list_transform(embedding, lambda v: v::double) as x
  from embeddings
), long_epochs as (
  select trial, condition, unnest(x) as value, generate_subscripts(x, 1) - 1 as t from epochs
)"""
SAMPLES_SQL = """samples as (
  select user_id::bigint as session, event_type as channel,
    row_number() over (partition by user_id, event_type order by event_id) - 1 as i,
    epoch_us(ts) / 1e6 as onset, value::double as value
  from events
)"""
