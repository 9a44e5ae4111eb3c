"""Mergeable summaries of streams: sums, extremes with their counts, co-moments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_summaries(samples: DataFrame, by: list[str], width: int) -> DataFrame:
    """The state of each chunk: n, sum, sum of squares, extremes and how often they occur."""
    chunk = samples.groupBy(*by, F.floor(F.col("i") / width).alias("chunk"))
    state = chunk.agg(
        F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"),
        F.min("value").alias("lo"), F.max("value").alias("hi"),
    )
    at = samples.withColumn("chunk", F.floor(F.col("i") / width)).join(state.select(*by, "chunk", "lo", "hi"), [*by, "chunk"])
    counts = at.groupBy(*by, "chunk").agg(
        F.count_if(F.col("value") == F.col("lo")).alias("n_lo"), F.count_if(F.col("value") == F.col("hi")).alias("n_hi")
    )
    return state.join(counts, [*by, "chunk"])


def merge_summaries(states: DataFrame, by: list[str]) -> DataFrame:
    """States of any chunks merged: an extreme's count is of the chunks that reach it."""
    ends = states.groupBy(*by).agg(F.min("lo").alias("least"), F.max("hi").alias("most"))
    return states.join(ends, by).groupBy(*by).agg(
        F.sum("n").alias("n"), F.sqrt(F.sum("ss") / F.sum("n")).alias("rms"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum(F.when(F.col("lo") == F.col("least"), F.col("n_lo")).otherwise(0)).alias("n_lo"),
        F.sum(F.when(F.col("hi") == F.col("most"), F.col("n_hi")).otherwise(0)).alias("n_hi"),
    )


def covariances(epochs: DataFrame, channels: int | None = None) -> DataFrame:
    """a, b, cov, r of every pair of positions of the epochs' vectors, or of the first ``channels``.

    Pairs are made inside each row, so the shuffle is of partial sums of channels^2
    pairs, not of a self-join of samples.
    """
    last = F.size("x") - 1 if channels is None else F.lit(channels - 1)
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(0), last),
            lambda a: F.transform(
                F.sequence(a, last),
                lambda b: F.struct(a.alias("a"), b.alias("b"), F.get("x", a).alias("u"), F.get("x", b).alias("v")),
            ),
        )
    )
    each = epochs.where(F.size("x") > 0).select(F.inline(pairs))
    return each.groupBy("a", "b").agg(F.covar_samp("u", "v").alias("cov"), F.corr("u", "v").alias("r"))
