"""Queries of the review of quality flags: an order is a study, its lines are flags."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.operators import review as R
from tidewave.plans.tables import table


def _lines(spark, sf_dir):
    """Order lines, one for each line number and part of an order."""
    first = W.partitionBy("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_quantity", "l_tax", "l_discount", "l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(first)).where("r = 1")


def _flags(spark, sf_dir):
    """What a detection finds: a flag on every line."""
    li = _lines(spark, sf_dir)
    return li.select(
        F.col("l_orderkey").cast("string").alias("study"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("flag_id"), F.lit("channel").alias("target_type"),
        F.col("l_partkey").cast("string").alias("target"), F.when(F.col("l_linestatus") == "F", "flat").otherwise("loud").alias("flag_type"),
        F.concat(F.lit("n="), F.col("l_quantity").cast("int").cast("string")).alias("evidence_summary"), F.when(F.col("l_tax") > 0.04, "exclude").otherwise("annotate").alias("proposed_action"),
        F.when(F.col("l_quantity") > 40, "high").when(F.col("l_quantity") > 20, "medium").otherwise("low").alias("severity"),
    )


def _decisions(spark, sf_dir):
    """The same flags with what the reviewer said: returned ones approved, accepted ones rejected, the rest open unless small."""
    li = _lines(spark, sf_dir).select(
        F.col("l_orderkey").cast("string").alias("study"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("flag_id"), "l_returnflag", "l_quantity", "l_discount"
    )
    small = (F.col("l_returnflag") == "R") | (F.col("l_quantity") < 30)
    said = li.select(
        "study", "flag_id", F.when(F.col("l_returnflag") == "A", "false").when(small, "true").otherwise("").alias("approved"),
        F.when(F.col("l_discount") > 0.05, "notch").otherwise("").alias("action_taken"), F.lit("reviewer").alias("reviewer"), F.lit("").alias("reviewed_at"),
        F.when(F.col("l_returnflag") == "A", "no fault").otherwise("").alias("reason"),
    )
    return _flags(spark, sf_dir).withColumn("status", F.lit("active")).join(said, R.KEY)


def _studies(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("study"), "o_orderstatus", "o_orderpriority")


def qc_counts(spark, sf_dir):
    return R.counts(_decisions(spark, sf_dir))


def qc_undecided(spark, sf_dir):
    """Open flags of high severity on flat channels: what a bulk decision would cover."""
    return R.select(_decisions(spark, sf_dir), flag_type="flat", severity="high").select("study", "flag_id")


def qc_merge(spark, sf_dir):
    """A new detection that no longer sees small lines and sees all evidence anew."""
    new = _flags(spark, sf_dir).withColumn("evidence_summary", F.concat(F.lit("new "), "evidence_summary"))
    out = R.merge_decisions(_decisions(spark, sf_dir), new.where("severity <> 'low'"))
    return out.select("study", "flag_id", "evidence_summary", "status", "approved", "reason")


def qc_decide(spark, sf_dir):
    """Every open flag answered: large ones rejected without a reason, which is refused."""
    open_ = R.undecided(_decisions(spark, sf_dir))
    answers = open_.select(
        "study", "flag_id", (F.col("severity") != "high").alias("approved"), F.lit(None).cast("string").alias("action_taken"),
        F.lit("me").alias("reviewer"), F.lit("now").alias("reviewed_at"), F.lit("").alias("reason"),
    )
    done, refused = R.decide(_decisions(spark, sf_dir), answers)
    told = done.groupBy("study").agg(F.count_if(R.blank(F.col("approved"))).alias("still_open"), F.count_if(F.col("reviewer") == "me").alias("answered"))
    return told.join(refused.groupBy("study").agg(F.count(F.lit(1)).alias("refused")), "study", "left").fillna({"refused": 0})


def qc_sign(spark, sf_dir):
    """Who signs what: studies that detection ran on without an open flag, those without any flag among them."""
    studies = _studies(spark, sf_dir)
    signed, refused = R.sign(studies, studies.where("o_orderpriority <> '5-LOW'"), _decisions(spark, sf_dir), "me")
    return signed.select("study", "n_flags", "n_approved", F.lit(0).cast("long").alias("undecided"), F.lit("").alias("why")).union(
        refused.select("study", F.lit(-1).cast("long"), F.lit(-1).cast("long"), "undecided", "why")
    )


def qc_gate_status(spark, sf_dir):
    """States of all studies: signed ones of finished orders, some of them edited or reopened since."""
    studies, decisions = _studies(spark, sf_dir), _decisions(spark, sf_dir)
    finished = studies.where("o_orderstatus <> 'O'")
    signed, _ = R.sign(finished, finished, decisions, "me")
    edited = decisions.withColumn("reason", F.when((F.col("severity") == "medium") & (F.col("flag_type") == "flat"), "edited").otherwise(F.col("reason")))
    history = signed.select("study", F.lit("sign").alias("event"), F.lit("1").alias("at")).union(
        studies.where("o_orderpriority = '1-URGENT'").select("study", F.lit("reopen"), F.lit("2"))
    )
    return R.status(studies, studies.where("o_orderpriority <> '5-LOW'"), edited, signed, history)


def qc_applied(spark, sf_dir):
    return R.applied_actions(_decisions(spark, sf_dir)).select("study", "flag_id", "action")


QUERIES = {f.__name__: f for f in (qc_counts, qc_undecided, qc_merge, qc_decide, qc_sign, qc_gate_status, qc_applied)}

_D = """with d as (select l_orderkey::varchar as study, l_linenumber || '-' || l_partkey as flag_id, case when l_linestatus = 'F' then 'flat' else 'loud' end as flag_type,
  'n=' || l_quantity::int as evidence, case when l_tax > 0.04 then 'exclude' else 'annotate' end as proposed,
  case when l_quantity > 40 then 'high' when l_quantity > 20 then 'medium' else 'low' end as severity,
  case when l_returnflag = 'A' then 'false' when l_returnflag = 'R' or l_quantity < 30 then 'true' else '' end as approved,
  case when l_discount > 0.05 then 'notch' else '' end as action_taken, case when l_returnflag = 'A' then 'no fault' else '' end as reason
  from (select *, row_number() over (partition by l_orderkey, l_linenumber, l_partkey order by l_quantity, l_tax, l_discount, l_returnflag, l_linestatus) as r from lineitem) where r = 1
), c as (select study, count(*) as flags, count(*) filter (where approved = '') as undecided, count(*) filter (where approved = 'true') as ok,
  count(*) filter (where severity = 'medium' and flag_type = 'flat') as touched from d group by 1
), o as (select o_orderkey::varchar as study, o_orderstatus, o_orderpriority from orders)
"""
ORACLES = {
    "qc_counts": _D + """select study, count(*) as flags, count(*) filter (where approved = '') as undecided, count(*) filter (where approved = 'true') as approved, 0::bigint as stale,
      count(*) filter (where severity = 'high') as high, count(*) filter (where severity = 'medium') as medium, count(*) filter (where severity = 'low') as low from d group by 1""",
    "qc_undecided": _D + "select study, flag_id from d where approved = '' and flag_type = 'flat' and severity = 'high'",
    "qc_merge": _D + "select study, flag_id, case when severity <> 'low' then 'new ' else '' end || evidence as evidence_summary, case when severity <> 'low' then 'active' else 'stale' end as status, approved, reason from d",
    "qc_decide": _D + """select study, count(*) filter (where approved = '' and severity = 'high') as still_open, count(*) filter (where approved = '' and severity <> 'high') as answered,
      count(*) filter (where approved = '' and severity = 'high') as refused from d group by 1""",
    "qc_sign": _D + """, w as (select o.study, coalesce(flags, 0) as flags, coalesce(ok, 0) as ok, coalesce(undecided, 0) as undecided,
        case when o_orderpriority = '5-LOW' then 'unreviewed' when coalesce(undecided, 0) > 0 then 'in_review' else '' end as why from o left join c using (study))
      select study, case when why = '' then flags else -1 end as n_flags, case when why = '' then ok else -1 end as n_approved, undecided, why from w""",
    "qc_gate_status": _D + """select o.study, case when o_orderpriority = '5-LOW' then 'unreviewed' when o_orderstatus = 'O' or undecided > 0 then 'in_review'
      when touched > 0 or o_orderpriority = '1-URGENT' then 'reopened' else 'approved' end as state from o left join c using (study)""",
    "qc_applied": _D + "select study, flag_id, case when action_taken <> '' then action_taken else proposed end as action from d where approved = 'true'",
}
