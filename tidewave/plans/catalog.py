"""Queries over manifests, ledgers, guardrails and text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.operators import catalog as C
from tidewave.operators import control as K
from tidewave.operators import guardrails as G
from tidewave.operators import text as X
from tidewave.plans.spectral import r6
from tidewave.plans.tables import table


def fk_violations(spark, sf_dir):
    """Labels of documents that aren't there, and lines without their part's even number."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0")
    return C.missing_parents(table(spark, sf_dir, "labels"), docs, "doc_id", "doc_id").select("doc_id")


def uniqueness_violations(spark, sf_dir):
    return C.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"]).select("l_orderkey", "l_partkey", "n")


def overlapping_windows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    w = o.select("o_custkey", "o_orderkey", days.alias("t0")).withColumn("t1", F.col("t0") + F.col("o_orderkey") % 40 + 1)
    return C.overlapping_windows(w, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "t0", "latest_end")


def vocabulary_violations(spark, sf_dir):
    return C.bad_vocabulary(table(spark, sf_dir, "customer"), "c_mktsegment", ["AUTOMOBILE", "BUILDING", "HOUSEHOLD"]).select("c_custkey", "c_mktsegment")


def parse_booleans(spark, sf_dir):
    """What manifest booleans make of order states and priorities."""
    o = table(spark, sf_dir, "orders")
    word = F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, ["Yes", "no", "T", "0", "maybe", "FALSE", ""])), (F.col("o_orderkey") % 7 + 1).cast("int")))
    return o.select("o_orderkey", word.alias("w")).select("o_orderkey", C.to_bool(F.col("w")).cast("string").alias("flag"))


def insert_if_absent(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"))
    return C.insert_if_absent(c.where("c_custkey % 2 = 0"), s, ["c_custkey"])


def _contacts(spark, sf_dir):
    """Nations as the contacts of their region's lead: a ring, a row of three, a ring; every eleventh is broken."""
    n = table(spark, sf_dir, "nation")
    rank = F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey"))
    row = F.when(rank == 1, 0).when(rank <= 4, 1).otherwise(rank - 3)
    return n.select(
        F.col("n_regionkey").alias("lead"), F.col("n_name").alias("contact"), row.alias("row"), rank.alias("pos"),
        (F.col("n_nationkey") % 11 != 7).alias("available"),
    )


def _montage(spark, sf_dir, scheme):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    values = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_regionkey").alias("lead"), F.col("n_name").alias("contact"), (F.col("s_suppkey") % 4).alias("t")
    ).agg(F.sum("s_acctbal").alias("value"))
    out = C.apply_montage(values, C.montage_weights(_contacts(spark, sf_dir), scheme), ["t"])
    return out.select("lead", "derivation", "t", *r6("value"))


def montage_monopolar(spark, sf_dir):
    return _montage(spark, sf_dir, "monopolar")


def montage_bipolar(spark, sf_dir):
    return _montage(spark, sf_dir, "chain")


def montage_vertical(spark, sf_dir):
    return _montage(spark, sf_dir, "bipolar_vertical")


def montage_horizontal(spark, sf_dir):
    return _montage(spark, sf_dir, "bipolar_horizontal")


def montage_adjacent(spark, sf_dir):
    return _montage(spark, sf_dir, "bipolar_adjacent")


def montage_car(spark, sf_dir):
    return _montage(spark, sf_dir, "car")


def montage_notes(spark, sf_dir):
    """What all schemes leave out for want of a contact."""
    out = None
    for scheme in C.SCHEMES:
        part = C.montage_notes(_contacts(spark, sf_dir), scheme).select(
            F.lit(scheme).alias("scheme"), "lead", F.coalesce("derivation", F.lit("")).alias("derivation"), F.array_join("missing", ",").alias("missing")
        )
        out = part if out is None else out.union(part)
    return out


def contact_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("lead"), F.when(F.col("p_size") < 10, "ring").otherwise("segment").alias("kind"), F.col("p_size").alias("row"), "p_partkey")
    return C.contact_rows(p).select("p_partkey", "row_label")


def _ledger(spark, sf_dir):
    """Orders as jobs: their status, attempts, stamps in text (some unreadable)."""
    o = table(spark, sf_dir, "orders")
    status = F.element_at(F.array(*map(F.lit, ["planned", "claimed", "running", "done", "failed"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    stamp = F.when(F.col("o_orderkey") % 11 == 0, "soon").when(F.col("o_orderkey") % 13 != 0, day)
    return o.select(
        F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("owner"), status.alias("status"), (F.col("o_orderkey") % 3).alias("attempts"),
        stamp.alias("claimed_at"), stamp.alias("heartbeat"), day.alias("created"), F.md5(F.col("o_orderkey").cast("string")).alias("hash"),
    )


_NOW = "2000-06-01 00:00:00"


def ledger_reset_stale(spark, sf_dir):
    return K.reset_stale(_ledger(spark, sf_dir), F.lit(_NOW).cast("timestamp"), 86400 * 400).select("job", "status")


def ledger_retry(spark, sf_dir):
    return K.fail(_ledger(spark, sf_dir), F.col("status") == "running", 3).select("job", "attempts", "status")


def queue_reap_stale(spark, sf_dir):
    return K.reap(_ledger(spark, sf_dir), F.lit(_NOW).cast("timestamp"), 120).select("job", "status")


def queue_claim(spark, sf_dir):
    return K.claim(_ledger(spark, sf_dir), ["owner"], 2).select("owner", "job", "created")


def queue_health(spark, sf_dir):
    return K.health(_ledger(spark, sf_dir), ["owner"])


def ledger_reconcile(spark, sf_dir):
    led = _ledger(spark, sf_dir)
    files = led.where("job % 4 <> 0").select("job", F.when(F.col("job") % 9 == 0, "other").otherwise(F.col("hash")).alias("hash"))
    return K.reconcile(led, files).select("job", "status")


def needs_rebuild(spark, sf_dir):
    """Orders that aren't done under the policy now in force; every third was never entered."""
    led = _ledger(spark, sf_dir).where("job % 3 <> 1").withColumn("policy", F.when(F.col("job") % 4 == 0, "old").otherwise("now"))
    return K.needs_rebuild(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job")), led, ["job"], F.lit("now"))


def review_status(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    decisions = li.select(F.col("l_orderkey").alias("study"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("verdict"))
    events = o.select(F.col("o_orderkey").alias("study"), F.when(F.col("o_orderstatus") == "F", "sign").when(F.col("o_orderstatus") == "O", "reopen").otherwise("note").alias("event"), F.col("o_totalprice").alias("seq"))
    return K.review_status(decisions, events, ["study"])


def applied_actions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    d = li.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.when(F.col("l_returnflag") == "A", "approve").otherwise("reject").alias("verdict"),
        (F.col("l_linestatus") == "F").alias("active"), F.when(F.col("l_quantity") > 25, " ").when(F.col("l_quantity") > 20, "none").otherwise("notch").alias("final_action"),
        F.when(F.col("l_discount") > 0.05, "exclude").alias("proposed_action"),
    )
    return K.applied_actions(d).select("l_orderkey", "l_linenumber", "action")


def guardrails(spark, sf_dir):
    """All thirteen rules over a plan per order line: its facts are the line's columns."""
    li = table(spark, sf_dir, "lineitem")
    third = F.col("l_linenumber") % 3
    fact = lambda expr: F.when(third != 0, expr)  # noqa: E731  a third of the facts can't be judged
    q = F.col("l_quantity").cast("int")
    conditions = F.split(
        F.when(q % 5 == 0, "overt,metro").when(q % 5 == 1, "overt").when(q % 5 == 2, "move,rest").when(q % 5 == 3, "dbs_on").otherwise("task"), ","
    )
    band = lambda name, lo, hi: F.struct(F.lit(name).alias("name"), lo.alias("lo"), hi.alias("hi"))
    plans = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("plan"),
        F.when(F.col("l_returnflag") == "A", "monopolar").otherwise("bipolar_vertical").alias("scheme"), fact(F.col("l_linestatus") == "F").alias("shared_reference"),
        fact(F.col("l_tax") <= 0.04).alias("contact_baseline"), fact(F.col("l_discount") <= 0.08).alias("ratio_per_channel"),
        fact(F.col("l_discount") >= 0.01).alias("threshold_within"), F.col("l_quantity").alias("window_s"), fact(F.col("l_tax") * 100).alias("event_s"),
        F.array(band("slow", F.lit(4.0), F.lit(8.0)), band("own", F.col("l_quantity") * 10, F.col("l_quantity") * 20)).alias("bands"), F.lit(900.0).alias("bandwidth_hz"),
        conditions.alias("conditions"), (q % 2 == 0).alias("reports_db"), fact(q % 3 == 0).alias("reports_z"),
        F.array(F.struct(conditions[0].alias("condition"), F.when(q > 45, "assumed").otherwise("emg").alias("derived_from"), F.when(q.between(41, 45), "draft").otherwise("in_use").alias("status"))).alias("windows"),
        fact(F.col("l_tax") == 0).alias("baseline_smoothed"), fact(F.col("l_linestatus") == "O").alias("emg_regressed"),
        F.col("l_discount").alias("excursion_db"), (-F.col("l_tax")).alias("effect_db"),
        F.when(q == 7, F.array(F.lit("/raw/a"))).otherwise(F.array().cast("array<string>")).alias("paths"), fact(F.col("l_linestatus") == "O").alias("deidentified"),
    )
    found = G.run_checks(plans, overrides={"g01": "montages are compared on purpose", "g06": "a closed rule stays closed"})
    return found.groupBy("plan").agg(
        F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("rules"), F.count_if("blocks").alias("n_blocking"),
        F.count_if(F.col("severity") == "warn").alias("n_warnings"),
    )


def choose_entry_idf(spark, sf_dir):
    """The benchmark item whose rare words a conversation's turn shares most."""
    entries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("name"), X.content_words(F.col("text")).alias("words"))
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question"), X.content_words(F.col("text")).alias("words"))
    return X.choose_entry(asked, entries).select("question", "name", *r6("score"))


def redact_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(X.scrub(F.col("text"))).alias("scrubbed_md5"), X.violations(F.col("text")).alias("fired"))


def sanitize_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.sanitize_name(F.col("url")).alias("name"))


QUERIES = {
    f.__name__: f
    for f in (
        fk_violations, uniqueness_violations, overlapping_windows, vocabulary_violations, parse_booleans, insert_if_absent,
        montage_monopolar, montage_bipolar, montage_vertical, montage_horizontal, montage_adjacent, montage_car, montage_notes, contact_rows, ledger_reset_stale, ledger_retry,
        queue_reap_stale, queue_claim, queue_health, ledger_reconcile, needs_rebuild, review_status, applied_actions, guardrails,
        choose_entry_idf, redact_text, sanitize_names,
    )
}

_LEDGER = """with jobs as (
  select o_orderkey as job, o_custkey as owner, ['planned', 'claimed', 'running', 'done', 'failed'][(o_orderkey % 5 + 1)::int] as status, o_orderkey % 3 as attempts,
    case when o_orderkey % 11 = 0 then 'soon' when o_orderkey % 13 <> 0 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as stamp,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as created, md5(o_orderkey::varchar) as hash from orders
), aged as (select *, epoch(timestamp '2000-06-01 00:00:00') - epoch(try_cast(stamp as timestamp)) as age from jobs)
"""
_VALUES = """with r as (select *, row_number() over (partition by n_regionkey order by n_nationkey) as i from nation),
c as (select n_regionkey as lead, n_name as contact, i as pos, case when i = 1 then 0 when i <= 4 then 1 else i - 3 end as row_, n_nationkey % 11 <> 7 as there from r),
v as (select n_regionkey as lead, n_name as contact, s_suppkey % 4 as t, sum(s_acctbal) as value from supplier join nation on s_nationkey = n_nationkey group by 1, 2, 3),
chain as (select lead, contact as plus, lead(contact) over (partition by lead order by pos) as minus from c),
vertical as (select s.lead, s.contact as plus, g.contact as minus from c s join c g on s.lead = g.lead and s.row_ = 1 and g.row_ = 0
  union all select a.lead, a.contact, b.contact from c a join c b on a.lead = b.lead and a.row_ = 2 and b.row_ = 0),
horizontal as (select a.lead, a.contact as plus, b.contact as minus from c a join c b on a.lead = b.lead and a.row_ = 1 and b.row_ = 1 and b.pos = case a.pos when 4 then 2 else a.pos + 1 end),
asked as (
  select 'monopolar' as scheme, lead, contact as derivation, contact, 1.0::double as w from c
  union all select 'car', a.lead, a.contact || '-car', b.contact, (a.contact = b.contact)::int - 1.0 / count(*) over (partition by a.lead, a.contact)
    from c a join c b on a.lead = b.lead where a.there and b.there
  union all select scheme, lead, plus || '-' || minus, unnest([plus, minus]), unnest([1.0, -1.0]) from (
    select 'chain' as scheme, * from chain union all select 'bipolar_vertical', * from vertical union all select 'bipolar_horizontal', * from horizontal) where minus is not null
  union all select 'bipolar_adjacent', a.lead, a.contact || '-rowmean', b.contact, case when b.row_ = 1 then -1.0 / 3 else 1.0 end
    from c a join c b on a.lead = b.lead and a.row_ in (0, 2) and (b.contact = a.contact or b.row_ = 1)
), judged as (select asked.*, list(case when not there then asked.contact end) over (partition by scheme, asked.lead, derivation) as held from asked join c on c.lead = asked.lead and c.contact = asked.contact),
whole as (select *, list_sort(list_distinct(list_filter(held, lambda x: x is not null))) as missing from judged)
"""
_MONTAGE = _VALUES + """select w.lead, derivation, t, round(sum(w * value), 6) + 0.0 as value from whole w join v on v.lead = w.lead and v.contact = w.contact
where scheme = '{scheme}' and len(missing) = 0 group by 1, 2, 3 having count(*) = (select count(*) from whole x where x.scheme = '{scheme}' and x.lead = w.lead and x.derivation = w.derivation)"""
_W = r"list_distinct(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), ' +'), lambda w: length(w) > 3 and w not in {stop}), lambda w: case when length(w) > 4 then regexp_replace(w, 's$', '') else w end))".format(stop=X.STOP_WORDS)
_SCRUBBED, _FIRED = "text", []
for _p, _m in X.SCRUB:
    _SCRUBBED = f"regexp_replace({_SCRUBBED}, '{_p}', '{_m}', 'g')"
    _FIRED.append(f"case when regexp_matches(text, '{_p}') then '{_m}' end")
ORACLES = {
    "fk_violations": "select doc_id from labels where not exists (select 1 from documents d where d.doc_id = labels.doc_id and d.doc_id % 7 <> 0)",
    "uniqueness_violations": "select l_orderkey, l_partkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
    "overlapping_windows": "with w as (select o_custkey, o_orderkey, date_diff('day', date '1990-01-01', o_orderdate::date) as t0, date_diff('day', date '1990-01-01', o_orderdate::date) + o_orderkey % 40 + 1 as t1 from orders), m as (select *, max(t1) over (partition by o_custkey order by t0, t1 rows between unbounded preceding and 1 preceding) as latest_end from w) select o_custkey, o_orderkey, t0, latest_end from m where t0 < latest_end",
    "vocabulary_violations": "select c_custkey, c_mktsegment from customer where c_mktsegment is null or c_mktsegment not in ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD')",
    "parse_booleans": "with w as (select o_orderkey, lower(['Yes', 'no', 'T', '0', 'maybe', 'FALSE', ''][(o_orderkey % 7 + 1)::int]) as w from orders) select o_orderkey, case when w in ('true', 't', 'yes', 'y', '1') then 'true' when w in ('false', 'f', 'no', 'n', '0') then 'false' end as flag from w",
    "insert_if_absent": "with o as (select c_custkey, c_mktsegment from customer where c_custkey % 2 = 0) select * from o union all select distinct s_suppkey * 3, 'NEW' from supplier where s_suppkey * 3 not in (select c_custkey from o)",
    **{
        name: _MONTAGE.format(scheme=scheme)
        for name, scheme in (
            ("montage_monopolar", "monopolar"), ("montage_bipolar", "chain"), ("montage_vertical", "bipolar_vertical"),
            ("montage_horizontal", "bipolar_horizontal"), ("montage_adjacent", "bipolar_adjacent"), ("montage_car", "car"),
        )
    },
    "montage_notes": _VALUES + "select distinct scheme, lead, derivation, array_to_string(missing, ',') as missing from whole where len(missing) > 0",
    "contact_rows": "with p as (select p_partkey, p_brand, p_size, case when p_size < 10 then 'ring' else 'segment' end as kind from part) select p_partkey, kind || '_' || dense_rank() over (partition by p_brand, kind order by p_size)::varchar as row_label from p",
    "ledger_reset_stale": _LEDGER + "select job, case when status = 'claimed' and (age is null or age > 86400 * 400) then 'planned' else status end as status from aged",
    "ledger_retry": _LEDGER + "select job, attempts + (status = 'running')::int as attempts, case when status = 'running' and attempts + 1 < 3 then 'planned' when status = 'running' then 'failed' else status end as status from aged",
    "queue_reap_stale": _LEDGER + "select job, case when status = 'running' and age > 120 then 'failed' else status end as status from aged",
    "queue_claim": _LEDGER + "select owner, job, created from (select *, row_number() over (partition by owner order by created, job) as r from jobs where status = 'planned') where r <= 2",
    "queue_health": _LEDGER + "select owner, " + ", ".join(f"count(*) filter (where status = '{s}') as {s}" for s in ("planned", "claimed", "running", "done", "failed")) + ", max(created) as newest, count(*) filter (where status = 'failed') <= count(*) filter (where status = 'done') as healthy from jobs group by 1",
    "ledger_reconcile": _LEDGER + ", f as (select job, case when job % 9 = 0 then 'other' else hash end as h from jobs where job % 4 <> 0) select jobs.job, case when status = 'done' and hash is distinct from h then 'reopened' else status end as status from jobs left join f on jobs.job = f.job",
    "needs_rebuild": _LEDGER + "select o_orderkey as job from orders where o_orderkey not in (select job from jobs where status = 'done' and job % 3 <> 1 and job % 4 <> 0)",
    "review_status": "with d as (select l_orderkey as study, count(*) filter (where l_returnflag <> 'N') as decided, count(*) filter (where l_returnflag = 'N') as open from lineitem group by 1), e as (select o_orderkey as study, case o_orderstatus when 'F' then 'sign' when 'O' then 'reopen' else 'note' end as event from orders) select study, decided, open, case when event = 'reopen' then 'reopened' when event = 'sign' and open = 0 then 'approved' when decided > 0 then 'in_review' else 'unreviewed' end as state from d left join e using (study)",
    "applied_actions": "with d as (select l_orderkey, l_linenumber::bigint as l_linenumber, coalesce(nullif(trim(case when l_quantity > 25 then ' ' when l_quantity > 20 then 'none' else 'notch' end), ''), case when l_discount > 0.05 then 'exclude' end) as action from lineitem where l_returnflag = 'A' and l_linestatus = 'F') select * from d where action is not null and action not in ('', 'none')",
    "guardrails": """with p as (select *, l_orderkey || '-' || l_linenumber || '-' || l_partkey as plan, l_linenumber % 3 <> 0 as known, l_quantity::int as q from lineitem), f as (
      select plan, unnest([case when l_returnflag = 'A' and not (known and l_linestatus <> 'F') then 'g01' end, case when known and l_tax > 0.04 then 'g02' end,
        case when known and l_discount > 0.08 then 'g03' end, case when known and l_discount < 0.01 then 'g04' end,
        case when known and l_tax <> 0 and l_quantity / (l_tax * 100) > 5 then 'g05' end, case when l_quantity * 20 > 900 then 'g06' end,
        case when q % 5 < 2 and l_quantity * 10 < 1000 and l_quantity * 20 > 100 and not (l_returnflag <> 'A' and known and l_linestatus = 'O') then 'g07' end,
        case when q % 2 = 0 and not (known and q % 3 = 0) then 'g08' end, case when l_tax <> 0 and l_discount / l_tax >= 1 then 'g09' end,
        case when q > 40 then 'g10' end, case when q % 5 in (1, 3, 4) then 'g11' end, case when known and l_tax = 0 then 'g12' end,
        case when q = 7 and not (known and l_linestatus = 'O') then 'g13' end]) as rule from p)
      select plan, string_agg(rule, ',' order by rule) as rules, count(*) filter (where rule in ('g02', 'g03', 'g06', 'g12', 'g13')) as n_blocking,
        count(*) filter (where rule in ('g04', 'g05', 'g07', 'g09', 'g10', 'g11')) as n_warnings from f where rule is not null group by 1""",
    "choose_entry_idf": f"""with e as (select item_id as name, {_W} as words from benchmark), w as (select name, unnest(words) as word from e),
      i as (select word, greatest(ln((select count(*) from e)::double / count(*)), 0.05) as weight from w group by 1),
      q as (select conv_id * 1000 + turn as question, unnest({_W}) as word from conversations where role = 'user'),
      s as (select question, name, round(sum(weight), 9) as score from q join w using (word) join i using (word) group by 1, 2)
      select question, name, round(score, 6) + 0.0 as score from (select *, row_number() over (partition by question order by score desc, name) as r from s) where r = 1""",
    "redact_text": f"select doc_id, md5({_SCRUBBED}) as scrubbed_md5, array_to_string(list_filter([{', '.join(_FIRED)}], lambda m: m is not null), ',') as fired from documents",
    "sanitize_names": "select page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') as name from pages",
}
