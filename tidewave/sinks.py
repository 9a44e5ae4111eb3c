"""Writing products, flags, decisions and history; reading them back as they were.

Writers are Spark's: a job's files become visible when it commits, so a lost executor
leaves no half-written product.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.operators import review

#: The columns of a decision row, in order.
DECISION_COLUMNS = (
    "flag_id", "type", "target", "flag", "detector", "severity", "evidence", "state",
    "verdict", "final_action", "reviewer", "reviewed_at", "reason",
)


def write_products(chunks: DataFrame, path: str) -> None:
    """Chunks by stream and channel; what isn't finite is refused before anything is written."""
    odd = chunks.where(F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))).limit(1).count()
    if odd:
        raise ValueError("a chunk holds values that aren't finite")
    chunks.write.mode("overwrite").partitionBy("stream", "channel").parquet(path)


def channel_hashes(samples: DataFrame) -> DataFrame:
    """session, channel, n, sha256 of each channel's samples in order, as 64-bit floats.

    Channels are sorted streams within a partition; a task holds one running hash.
    """
    ordered = samples.select("session", "channel", "i", "value").repartition("session", "channel").sortWithinPartitions("session", "channel", "i")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, running = None, 0, hashlib.sha256()
        for rows in batches:
            done = []
            for own, part in rows.groupby(["session", "channel"], sort=False):
                if own != key and key is not None:
                    done.append((*key, n, running.hexdigest()))
                    n, running = 0, hashlib.sha256()
                key, n = own, n + len(part)
                running.update(part["value"].to_numpy("<f8").tobytes())
            if done:
                yield pd.DataFrame(done, columns=["session", "channel", "n", "sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, n, running.hexdigest())], columns=["session", "channel", "n", "sha256"])

    return ordered.mapInPandas(run, "session long, channel string, n long, sha256 string")


def save_decisions(rows: DataFrame, path: str) -> None:
    """Tab-separated text with every column as text, in the fixed order; null is empty."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in DECISION_COLUMNS]
    rows.select(*columns).write.mode("overwrite").option("sep", "\t").option("header", "true").option("emptyValue", "").csv(path)


def load_decisions(spark: SparkSession, path: str) -> DataFrame:
    """The rows saved there, all text; none if nothing was saved."""
    schema = ", ".join(f"{c} string" for c in DECISION_COLUMNS)
    try:
        rows = spark.read.schema(schema).option("sep", "\t").option("header", "true").csv(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in DECISION_COLUMNS])


def append_history(events: DataFrame, path: str) -> None:
    """One JSON object per event, added to what is there."""
    events.write.mode("append").json(path)


def read_history(spark: SparkSession, path: str, schema: str = "study string, event string, reviewer string, at string, reason string") -> DataFrame:
    """The events appended there, in the order of their stamps; none if nothing was appended."""
    try:
        rows = spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.orderBy("at")


def write_flags(flags: DataFrame, path: str) -> None:
    """A detection's whole output, evidence included, with when it was detected and how many flags its study has."""
    sizes = flags.groupBy("study").agg(F.count(F.lit(1)).alias("n_flags"))
    flags.join(sizes, "study").withColumn("detected_at", F.current_timestamp().cast("string")).write.mode("overwrite").json(path)


def saved_proposals(spark: SparkSession, folder: str) -> DataFrame:
    """The decisions of a folder's last detection; none if there was none."""
    columns = ("study", *review.DETECTED, *review.REVIEWER)
    try:
        versions = spark.read.schema(", ".join(f"{c} string" for c in (*columns, "version"))).json(f"{folder}/decisions")
    except AnalysisException:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    last = versions.agg(F.max("version").alias("version"))
    return versions.join(last, "version").select(*columns)


def propose(flags: DataFrame, folder: str, version: str) -> DataFrame:
    """A detection folded into the decisions of a folder: answers stay, what fires again is refreshed. Twice is as once.

    flags: study, flag_id, target_type, target, flag_type, evidence_summary, proposed_action,
    severity. Each detection adds a version, a text that sorts after the earlier ones; readers
    take the last, so a write that breaks changes nothing.
    """
    write_flags(flags, f"{folder}/flags")
    merged = review.merge_decisions(saved_proposals(flags.sparkSession, folder), flags)
    merged.select("study", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*review.DETECTED, *review.REVIEWER)], F.lit(version).alias("version")).write.mode("append").json(f"{folder}/decisions")
    return saved_proposals(flags.sparkSession, folder)
