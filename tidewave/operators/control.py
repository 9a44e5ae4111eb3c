"""Queries over jobs, ledgers and review decisions: state changes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def age_seconds(stamp: Column, now: Column) -> Column:
    """Seconds since a stamp in text; null if it isn't a time."""
    return F.unix_seconds(now) - F.unix_seconds(F.try_to_timestamp(stamp))


def reset_stale(ledger: DataFrame, now: Column, timeout_s: int) -> DataFrame:
    """Claimed rows go back to planned if their stamp is missing, unreadable or too old."""
    age = age_seconds(F.col("claimed_at"), now)
    stale = (F.col("status") == "claimed") & (age.isNull() | (age > timeout_s))
    return ledger.withColumn("status", F.when(stale, "planned").otherwise(F.col("status")))


def fail(ledger: DataFrame, failed: Column, most: int) -> DataFrame:
    """One attempt more for failed rows: planned again while attempts are left, failed for good then."""
    attempts = F.col("attempts") + F.when(failed, 1).otherwise(0)
    status = F.when(failed & (attempts < most), "planned").when(failed, "failed").otherwise(F.col("status"))
    return ledger.withColumns({"attempts": attempts, "status": status})


def reap(jobs: DataFrame, now: Column, stale_s: int) -> DataFrame:
    """Running jobs whose heartbeat is too old have failed; without a heartbeat they are left alone."""
    old = (F.col("status") == "running") & (age_seconds(F.col("heartbeat"), now) > stale_s)
    return jobs.withColumn("status", F.when(F.coalesce(old, F.lit(False)), "failed").otherwise(F.col("status")))


def claim(jobs: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n oldest planned rows of each group."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy("created", "job"))
    return jobs.where("status = 'planned'").withColumn("r", rank).where(F.col("r") <= n).drop("r")


def health(jobs: DataFrame, by: list[str]) -> DataFrame:
    """Counts by status, and whether more fail than finish."""
    out = jobs.groupBy(*by).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("planned", "claimed", "running", "done", "failed")],
        F.max("created").alias("newest"),
    )
    return out.withColumn("healthy", F.col("failed") <= F.col("done"))


def reconcile(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Done rows whose file is missing or has another hash are opened again."""
    found = ledger.join(files.select("job", F.col("hash").alias("file_hash")), "job", "left")
    gone = (F.col("status") == "done") & ~F.col("hash").eqNullSafe(F.col("file_hash"))
    return found.withColumn("status", F.when(gone, "reopened").otherwise(F.col("status"))).drop("file_hash")


def review_status(decisions: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """unreviewed, in_review, approved or reopened, from open decisions and the last event."""
    last = events.groupBy(*by).agg(F.max_by("event", "seq").alias("event"))
    counts = decisions.groupBy(*by).agg(F.count_if(F.col("verdict").isNotNull()).alias("decided"), F.count_if(F.col("verdict").isNull()).alias("open"))
    state = (
        F.when(F.col("event") == "reopen", "reopened")
        .when((F.col("event") == "sign") & (F.col("open") == 0), "approved")
        .when(F.col("decided") > 0, "in_review")
        .otherwise("unreviewed")
    )
    return counts.join(last, by, "left").select(*by, "decided", "open", state.alias("state"))


def applied_actions(decisions: DataFrame) -> DataFrame:
    """Approved, active decisions with an action other than none."""
    action = F.coalesce(F.nullif(F.trim("final_action"), F.lit("")), F.col("proposed_action"))
    kept = decisions.where("verdict = 'approve' and active").withColumn("action", action)
    return kept.where("action is not null and action not in ('', 'none')")


def needs_rebuild(wanted: DataFrame, ledger: DataFrame, key: list[str], policy: Column) -> DataFrame:
    """Rows of wanted that aren't done under this very policy; those the ledger doesn't know among them."""
    done = ledger.where((F.col("status") == "done") & (F.col("policy") == policy)).select(*key)
    return wanted.join(done, key, "left_anti")
