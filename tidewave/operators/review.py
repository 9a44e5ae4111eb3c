"""Review of quality flags: decisions, signatures and the gate, for many studies at once.

A decision row has a study, what was detected (refreshed by every detection) and what the
reviewer said (never touched by one). The state of a study is derived, never stored: a
signature covers a digest of the decisions, so any later edit reopens the study.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of a decision, after the study.
DETECTED = ("flag_id", "target_type", "target", "flag_type", "evidence_summary", "proposed_action", "severity", "status")
REVIEWER = ("approved", "action_taken", "reviewer", "reviewed_at", "reason")
UNREVIEWED, IN_REVIEW, APPROVED, REOPENED = "unreviewed", "in_review", "approved", "reopened"
KEY = ["study", "flag_id"]


class NotApproved(Exception):
    """A study that isn't signed off can't be analysed."""


def flag_id(target_type: Column, target: Column, flag_type: Column, detector: Column) -> Column:
    """Stable over detections; two detectors that raise one concern about one target differ."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (target_type, target, flag_type, detector)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def blank(column: Column) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) == ""


def merge_decisions(existing: DataFrame, flags: DataFrame) -> DataFrame:
    """existing with a fresh detection folded in.

    Flags that fire again have their detected columns refreshed and keep all reviewer columns;
    new ones are undecided; those that no longer fire stay, as stale.
    """
    old, new = existing.alias("o"), flags.alias("n")
    both = old.join(new, KEY, "full")
    fires = F.col("n.flag_type").isNotNull()
    detected = [
        F.when(fires, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in DETECTED if c not in ("flag_id", "status")
    ]
    state = F.when(fires, "active").otherwise("stale").alias("status")
    return both.select(*KEY, *detected, state, *[F.coalesce(F.col(f"o.{c}"), F.lit("")).alias(c) for c in REVIEWER])


def undecided(decisions: DataFrame) -> DataFrame:
    """Active rows without an answer; stale ones need none."""
    return decisions.where((F.coalesce("status", F.lit("active")) == "active") & blank(F.col("approved")))


def select(
    decisions: DataFrame, flag_type: str | None = None, severity: str | None = None, target: str | None = None, only_undecided: bool = True
) -> DataFrame:
    """Active rows that a bulk decision covers; target matches any part of a target."""
    out = undecided(decisions) if only_undecided else decisions.where(F.coalesce("status", F.lit("active")) == "active")
    if flag_type:
        out = out.where(F.col("flag_type") == flag_type)
    if severity:
        out = out.where(F.col("severity") == severity)
    if target:
        out = out.where(F.contains(F.col("target"), F.lit(target)))
    return out


def decide(decisions: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """decisions with the answers (study, flag_id, approved, action_taken or null, reviewer, reviewed_at, reason), and the answers refused.

    A rejection, or an action other than the proposed one, needs a reason; an answer to a flag
    that isn't there is refused too. An approval takes the proposed action, a rejection none.
    """
    d, a = decisions.alias("d"), answers.alias("a")
    changed = F.coalesce(F.col("a.action_taken") != F.col("d.proposed_action"), F.lit(False))
    bare = (~F.col("a.approved") | changed) & blank(F.col("a.reason"))
    known = a.join(d.select(*KEY, "proposed_action").alias("d"), KEY, "left").select("a.*", "d.proposed_action", bare.alias("bare"), F.col("d.proposed_action").isNull().alias("unknown"))
    why = F.when(F.col("unknown"), "no such flag").when(F.col("bare"), "a reason is needed")
    refused = known.withColumn("why", why).where("why is not null").select(*answers.columns, "why")
    taken = known.where("not unknown and not bare").select(
        *KEY, F.col("approved").cast("string").alias("_approved"),
        F.coalesce("action_taken", F.when(F.col("approved"), F.col("proposed_action")).otherwise("none")).alias("_action"),
        F.col("reviewer").alias("_reviewer"), F.col("reviewed_at").alias("_at"), F.coalesce("reason", F.lit("")).alias("_reason"),
    )
    new = dict(zip(REVIEWER, ("_approved", "_action", "_reviewer", "_at", "_reason"), strict=True))
    joined = decisions.join(taken, KEY, "left")
    kept = [F.when(F.col("_approved").isNotNull(), F.col(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in decisions.columns]
    return joined.select(*kept), refused


def digests(decisions: DataFrame) -> DataFrame:
    """study, digest: of all its decisions, in whatever order they come."""
    columns = sorted(c for c in decisions.columns if c != "study")
    row = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])), 256)
    each = decisions.where("flag_id is not null").select("study", row.alias("h"))
    return each.groupBy("study").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("digest"))


def counts(decisions: DataFrame) -> DataFrame:
    """study, flags, undecided, approved, stale, and active flags by severity."""
    active = F.coalesce("status", F.lit("active")) == "active"
    return decisions.groupBy("study").agg(
        F.count_if(active).alias("flags"), F.count_if(active & blank(F.col("approved"))).alias("undecided"),
        F.count_if(active & (F.lower("approved") == "true")).alias("approved"), F.count_if(~active).alias("stale"),
        *[F.count_if(active & (F.col("severity") == s)).alias(s) for s in ("high", "medium", "low")],
    )


_NONE = "0" * 64


def sign(studies: DataFrame, reviewed: DataFrame, decisions: DataFrame, reviewer: str) -> tuple[DataFrame, DataFrame]:
    """Signatures (study, reviewer, digest, n_flags, n_approved) of the studies, and the studies refused (study, undecided, why).

    reviewed: study, of those that detection has run on; without detection there is nothing to
    sign. A study that detection found nothing in can be signed.
    """
    if not reviewer.strip():
        raise ValueError("a signature needs a reviewer")
    ran = reviewed.select("study").distinct().withColumn("_ran", F.lit(True))
    known = studies.select("study").join(ran, "study", "left").join(counts(decisions), "study", "left").join(digests(decisions), "study", "left")
    known = known.fillna({"undecided": 0, "flags": 0, "approved": 0, "digest": _NONE}).withColumn("why", F.when(F.col("_ran").isNull(), UNREVIEWED).when(F.col("undecided") > 0, IN_REVIEW))
    signed = known.where("why is null").select("study", F.lit(reviewer).alias("reviewer"), "digest", F.col("flags").alias("n_flags"), F.col("approved").alias("n_approved"))
    return signed, known.where("why is not null").select("study", "undecided", "why")


def reopen(studies: DataFrame, reviewer: str, reason: str, at: Column) -> DataFrame:
    """History events (study, event, reviewer, reason, at) that open studies again."""
    if not reason.strip():
        raise ValueError("reopening needs a reason")
    return studies.select("study", F.lit("reopen").alias("event"), F.lit(reviewer).alias("reviewer"), F.lit(reason).alias("reason"), at.alias("at"))


def status(studies: DataFrame, reviewed: DataFrame, decisions: DataFrame, signatures: DataFrame, history: DataFrame) -> DataFrame:
    """study, state of every study.

    reviewed: those that detection has run on. signatures: study, digest (the last one, if a
    study has several). history: study, event, at; only sign and reopen matter.
    """
    ran = reviewed.select("study").distinct().withColumn("ran", F.lit(True))
    last = history.where("event in ('sign', 'reopen')").groupBy("study").agg(F.max_by("event", "at").alias("event"))
    signed = signatures.select("study", F.col("digest").alias("signed")).withColumn("has", F.lit(True))
    now = digests(decisions)
    joined = studies.select("study").join(ran, "study", "left").join(now, "study", "left").join(signed, "study", "left").join(last, "study", "left")
    state = (
        F.when(F.col("ran").isNull(), UNREVIEWED)
        .when(F.col("has").isNull(), IN_REVIEW)
        .when(F.col("signed") != F.coalesce("digest", F.lit(_NONE)), REOPENED)
        .when(F.col("event") == "reopen", REOPENED)
        .otherwise(APPROVED)
    )
    return joined.select("study", state.alias("state"))


#: What to do about a study that isn't approved.
_REMEDY = {
    UNREVIEWED: "run the detectors, review the flags, then sign", IN_REVIEW: "finish the review, then sign",
    REOPENED: "the decisions changed after the signature, or the study was reopened: sign again",
}


def require_approved(states: DataFrame, study: str | None) -> None:
    found = states.where(F.col("study").cast("string") == F.lit(study)).select("state").first()
    state = found["state"] if found else UNREVIEWED
    if state != APPROVED:
        raise NotApproved(f"{study} is {state}: {_REMEDY[state]}")


def applied_actions(decisions: DataFrame) -> DataFrame:
    """study, flag_id, target_type, target, flag_type, action, reviewer of approved, active decisions that do something."""
    action = F.when(blank(F.col("action_taken")), F.col("proposed_action")).otherwise(F.col("action_taken"))
    active = (F.coalesce("status", F.lit("active")) == "active") & (F.lower("approved") == "true")
    out = decisions.where(active).select("study", "flag_id", "target_type", "target", "flag_type", action.alias("action"), "reviewer")
    return out.where("action is not null and action not in ('', 'none')")
