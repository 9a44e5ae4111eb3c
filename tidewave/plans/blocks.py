"""Queries of proposals, privacy and block builds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewave import blocks as B
from tidewave.functions import filters as K
from tidewave.operators import privacy as P
from tidewave.operators import proposals as R
from tidewave.plans import signals as S
from tidewave.plans.tables import table
from tidewave.storage import shared_folder

#: Parts in fours are the contacts of a lead, their sizes its impedances.
MODELS = [
    ("acme", [1, 3], 4), ("bolt", [1, 3], 4), ("unknown_tip", [1, 3], 4), ("crown", [3, 1], 4), ("four", [1, 1, 1, 1], 4), ("unknown_row", [1, 1, 1, 1], 4), ("pair", [1, 2, 1], 4), ("even", [2, 1, 1], 4), ("odd", [2, 1, 1], 4),
]
RATIO = 2.0


def _leads(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    lead = F.floor(F.col("p_partkey") / 4)
    sweep = parts.select(lead.alias("lead"), (F.col("p_partkey") % 4 + 1).cast("int").alias("contact"), F.col("p_size").cast("double").alias("kohm"))
    leads = sweep.select("lead").distinct().select("lead", F.lit(1).alias("channel_first"), F.lit(4).alias("channel_last"))
    return sweep, leads


def lead_models(spark, sf_dir):
    """The model proposed for every lead, its confidence band and the alternatives."""
    sweep, leads = _leads(spark, sf_dir)
    models = spark.createDataFrame(MODELS, "model string, geometry array<int>, n_contacts int")
    out = R.propose_lead_models(sweep, leads, models, ["lead"], RATIO)
    return out.select(F.col("lead").cast("long").alias("lead"), "value", "band", "prefill", F.array_join("alternatives", ",").alias("alternatives"), F.element_at("evidence", "geometry").alias("geometry"))


def privacy_walk(spark, sf_dir):
    """Rules that documents break, walked as nested attributes; those that break none are left out."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.struct(F.col("text").alias("note"), F.array("source", "lang").alias("tags"), F.create_map(F.lit("n_chars"), F.col("n_chars"), F.lit("read_time"), F.col("doc_id") * 10000).alias("sizes")).alias("attrs")
    )
    found = P.walk(docs, ["attrs"]).where(F.size("violations") > 0)
    said = F.array_join(F.array_sort(F.array_distinct(F.transform("violations", lambda v: F.concat(v["where"], F.lit(": "), v["rule"])))), "; ")
    return found.select("doc_id", said.alias("violations"))


POLICY = B.BuildPolicy(roles=[("^neur", "lfp"), ("^mic", "mic"), ("^skip", "ignore")], products={"lfp": ("lfp", 64.0), "mic": ("mic", None)}, native=["^stim"], spec=K.FilterSpec(attenuation_db=60.0, alias_floor_db=-50.0), window_s=2.0, segment_s=0.5)


def block_builds(spark, sf_dir):
    """Suppliers' signals as blocks: built, or set aside with the reason, by the stream's name and the events' clock."""
    nation = F.col("s_nationkey") % 5
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("block_id"), F.lit("S").alias("study_id"), F.lit("1").alias("session"), F.concat(F.when(nation == 4, "stim").otherwise("rest"), F.col("s_suppkey").cast("string")).alias("block"),
        F.when(nation == 0, "mic").when(nation == 1, "skip").when(nation == 2, "what").otherwise("neur").alias("stream"), (F.col("s_acctbal") < 0).alias("late"),
    )
    chunks = S.chunks(spark, sf_dir).withColumnRenamed("series", "block_id").join(s.select("block_id", "stream"), "block_id").withColumn("channel", F.lit("a"))
    sizes = chunks.groupBy("block_id", "stream").agg(F.sum(F.size("x")).cast("long").alias("n_samples")).withColumn("sfreq", F.lit(S.RATE))
    events = s.select("block_id", F.lit("Cam1").alias("label"), F.lit(0).alias("i"), F.when(F.col("late"), 1e9).otherwise(0.5).alias("onset"), F.lit(None).cast("double").alias("offset"), F.lit(1.0).alias("value"))
    out = B.build_blocks(spark, s.select("block_id", "study_id", "session", "block"), sizes, chunks, events, POLICY, f"{shared_folder(spark)}/built-{uuid.uuid4().hex}")
    return out.select("block_id", "status", F.coalesce("why", F.lit("")).alias("why"), "n_products", "n_samples")


QUERIES = {f.__name__: f for f in (lead_models, privacy_walk, block_builds)}
_SHAPES = " ".join(f"when shape = '{'-'.join(map(str, g))}' then '{m}'" for m, g, _ in MODELS if [x[1] for x in MODELS].count(g) == 1)
_OPEN = " ".join(f"when shape = '{'-'.join(map(str, g))}' then '{m}'" for m, g, _ in MODELS if m.startswith(R.PLACEHOLDER))
_NAMED = " ".join(f"when shape = '{s}' then '{','.join(sorted(m for m, g, _ in MODELS if '-'.join(map(str, g)) == s and not m.startswith(R.PLACEHOLDER)))}'" for s in sorted({"-".join(map(str, g)) for _, g, _ in MODELS}))
_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
#: The same rules without looking around, which DuckDB's patterns can't: neighbours are consumed instead.
_RULES = {
    "absolute path": r"""(?:^|[\s"''=(\[,;])(?:~?/[^\s/"'']+/[^\s"'']*|~[/\\]|[A-Za-z]:[\\/][^\s"'']+|\\\\[^\s"'']+)|^\s*(?:/|[A-Za-z]:[\\/])""",
    "uri": r"(?:^|[^A-Za-z0-9])[A-Za-z][A-Za-z0-9+.\-]*://",
    "compact date": r"(?:^|[^A-Za-z0-9])(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:[^A-Za-z0-9]|$)",
    "dashed date": r"(?:^|[^0-9])(?:19|20)\d{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12]\d|3[01])(?:[^0-9]|$)",
    "month-name date": rf"(?i)(?:^|[^A-Za-z0-9])(?:\d{{1,2}}(?:st|nd|rd|th)?[\s\-./]+{_MONTH}(?:[^a-z]|$)|{_MONTH}[\s\-./]+\d{{1,2}}(?:[^0-9]|$))",
}
_TEXT = ", ".join(f"case when regexp_matches(text, '{p}') then 'attrs.note: {n}' end" for n, p in _RULES.items())
_TAG = ", ".join(f"case when regexp_matches(coalesce(source, ''), '{p}') or regexp_matches(coalesce(lang, ''), '{p}') then 'attrs.tags: {n}' end" for n, p in _RULES.items())
ORACLES = {
    "lead_models": f"""with c as (select p_partkey // 4 as lead, p_partkey % 4 + 1 as contact, p_size::double as kohm from part),
      a as (select lead, contact from (select distinct lead from c), range(1, 5) k(contact)), e as (select lead, contact, kohm from a left join c using (lead, contact)),
      labels as (select lead, string_agg(case when kohm >= {RATIO} * least_ then 'S' else 'R' end, '' order by contact) as s from (select *, min(kohm) over (partition by lead) as least_ from e) group by 1),
      shapes as (select lead, array_to_string(list_transform(string_split(replace(replace(replace(replace(s, 'SSSS', '4'), 'SSS', '3'), 'SS', '2'), 'S', '1'), ''), lambda x: case when x = 'R' then '1' else x end), '-') as shape from labels)
      select lead::bigint as lead, case {_SHAPES} {_OPEN} end as value, case when (case {_SHAPES} end) is not null then 'high' when (case {_NAMED} end) is not null then 'medium' else 'low' end as band,
        (case {_SHAPES} end) is not null as prefill, case when (case {_SHAPES} end) is not null then '' else coalesce(case {_NAMED} end, '') end as alternatives, shape as geometry from shapes""",
    "privacy_walk": f"""with v as (select doc_id, list_sort(list_filter([{_TEXT}, {_TAG}, case when doc_id * 10000 >= 1e6 then 'attrs.sizes.read_time: timestamp' end], lambda x: x is not null)) as v from documents)
      select doc_id, array_to_string(v, '; ') as violations from v where len(v) > 0""",
    "block_builds": """with n as (select l_suppkey as block_id, count(*) as n from lineitem group by 1),
      b as (select s_suppkey as block_id, s_nationkey % 5 as k, s_acctbal < 0 as late, n from supplier left join n on block_id = s_suppkey),
      j as (select *, case when n is null then 'no_streams' when k = 2 then 'unmapped_stream' when k = 1 then 'nothing_to_write' when late then 'epoch_clock_origin' else '' end as why from b)
      select block_id, case when why = '' then 'done' else 'quarantined' end as status, why, case when why = '' then 1 else 0 end::bigint as n_products,
        case when why <> '' then 0 when k = 3 then (n * 16 + 24) // 25 else n end::bigint as n_samples from j""",
}
