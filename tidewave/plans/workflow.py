"""Queries of sessions, reviews, plans and formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewave.operators import workflow as O
from tidewave.plans.spectral import r6
from tidewave.plans.tables import EPOCHS_SQL, SAMPLES_SQL, long_epochs, samples, table


def stream_info(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("onset", F.col("onset") - 1704067200)
    return O.stream_info(s, ["session", "channel"]).select("session", "channel", "n", *[(F.round(c, 3) + 0.0).alias(c) for c in ("t0", "duration_s")], *[(F.round(F.col(c) * 1e6, 3) + 0.0).alias(c) for c in ("rate", "nyquist")])


def first_appearance(spark, sf_dir):
    return O.first_seen(samples(spark, sf_dir), ["session"], "channel", "onset")


def verify_readable(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return O.readable_counts(d, ["source"], F.coalesce(F.col("n_chars") > 1000, F.lit(False)))


def recording_start(spark, sf_dir):
    """Clock zero of each session: its first positive onset past the 3rd day; null without one."""
    s = samples(spark, sf_dir).withColumn("t", F.col("onset") - 1704067200 - 259200)
    return s.groupBy("session").agg(F.min(F.when(F.col("t") > 0, F.col("t"))).alias("t0")).select("session", *r6("t0"))


def format_bytes(spark, sf_dir):
    """Bytes of each order's lines as if its priority were a binary format."""
    o = table(spark, sf_dir, "orders").withColumn("format", F.element_at(F.array(*map(F.lit, ["INT_16", "INT_32", "IEEE_FLOAT_32", "IEEE_FLOAT_64", "OTHER"])), (F.col("o_orderkey") % 5 + 1).cast("int")))
    return o.groupBy("format").agg(F.count(F.lit(1)).alias("n")).select("format", F.coalesce(F.col("n") * O.lookup(F.col("format"), O.SAMPLE_BYTES), F.lit(0)).cast("long").alias("bytes"))


def open_session(spark, sf_dir):
    """Included contacts of a lead in order, from 0, after exclusions."""
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("lead"), F.col("c_custkey").alias("contact"), "c_mktsegment")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("contact"), F.when(F.col("o_orderpriority") == "1-URGENT", "exclude").otherwise("annotate").alias("action")).where("contact % 3 = 0")
    kept = O.apply_exclusions(c.where("c_mktsegment <> 'MACHINERY'"), o, ["contact"])
    return kept.select("lead", "contact", (F.row_number().over(W.partitionBy("lead").orderBy("contact")) - 1).cast("long").alias("index"))


def decide_reviews(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", F.lit(None).cast("string").alias("verdict"), "l_quantity", "l_returnflag", "l_discount")
    verdict = F.when(F.col("l_returnflag") == "R", "reject").otherwise("approve")
    reason = F.when(F.col("l_discount") > 0.03, "noise").otherwise(" ")
    out = O.decide(li, F.col("l_quantity") > 10, verdict, reason)
    return out.groupBy("l_returnflag", F.coalesce("verdict", F.lit("undecided")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def _base(spark, sf_dir, mode):
    e = long_epochs(spark, sf_dir).groupBy("condition", "t").agg(F.avg(F.col("value") * F.col("value")).alias("value"))
    return O.baseline(e, ["condition"], mode, F.col("t").between(0, 15)).select("condition", "t", *r6("value"))


def baseline_logratio(spark, sf_dir):
    return _base(spark, sf_dir, "logratio")


def baseline_percent(spark, sf_dir):
    return _base(spark, sf_dir, "percent")


def baseline_zscore(spark, sf_dir):
    return _base(spark, sf_dir, "zscore")


def plan_products(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stream"), F.when(F.col("p_size") % 9 == 0, "ignore").otherwise("neural").alias("role"), F.col("p_retailprice").alias("rate"))
    return O.plan_products(p)


def off_clock_events(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("onset", F.col("onset") - 1704067200 - 20000)
    ends = s.groupBy("session").agg((F.max("onset") - 10000).alias("end"))
    limits = s.select("session", "channel").distinct().join(ends, "session")
    return O.off_clock(s, limits, ["session", "channel"]).select("session", "channel", *r6("lo", "hi"))


def upsert_workers(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("worker"), F.col("s_name").alias("host"))
    new = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("worker"), F.col("c_name").alias("host"))
    return O.upsert(old, new, "worker")


def zoned_stamps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    stamp = F.concat(day, F.element_at(F.array(*map(F.lit, ["Z", "", "+02:00", " x", "-05:30"])), (F.col("event_id") % 5 + 1).cast("int")))
    return e.select("event_id", O.zoned(stamp).alias("zoned"))


def bad_bands(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "low").otherwise((F.col("p_size") - 3).cast("string")).alias("lo"), F.lit("25").alias("hi"))
    return O.bad_bands(p).select("p_partkey", "lo")


def role_rank(spark, sf_dir):
    """How many customers may do what an analyst may, by segment as role."""
    c = table(spark, sf_dir, "customer").withColumn("role", F.element_at(F.array(*map(F.lit, ["viewer", "analyst", "reviewer", "admin", "none"])), (F.col("c_custkey") % 5 + 1).cast("int")))
    can = F.coalesce(O.lookup(F.col("role"), O.ROLE_RANK) >= 1, F.lit(False))
    return c.groupBy("role").agg(F.count_if(can).alias("may"))


def source_potentials(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", O.monopole(F.col("p_retailprice"), F.col("p_size").cast("double"), 0.3).alias("v"), O.effective_bits(F.col("p_retailprice"), F.col("p_size").cast("double")).alias("bits")).select("p_partkey", *r6("v", "bits"))


def encoding_pattern(spark, sf_dir):
    """Slope of each sample position on the condition's number: one regression per feature."""
    return long_epochs(spark, sf_dir).groupBy("t").agg(F.regr_slope("value", F.col("condition").cast("double")).alias("slope"), F.regr_r2("value", F.col("condition").cast("double")).alias("r2")).select("t", (F.round("slope", 8) + 0.0).alias("slope"), (F.round("r2", 8) + 0.0).alias("r2"))


def instantaneous_gap(spark, sf_dir):
    """Rate of events from unwrapped differences of their time of day."""
    from pyspark.sql import Window as W

    s = samples(spark, sf_dir).withColumn("phase", F.pmod(F.col("onset"), F.lit(86400.0)))
    d = F.col("phase") - F.lag("phase").over(W.partitionBy("session").orderBy("onset"))
    wrapped = F.pmod(d + 43200, F.lit(86400.0)) - 43200
    return s.select("session", "channel", "i", wrapped.alias("step")).where("step is not null").groupBy("session").agg(F.sum("step").alias("turned"), F.max("step").alias("most")).select("session", *[(F.round(c, 3) + 0.0).alias(c) for c in ("turned", "most")])


def variance_shares(spark, sf_dir):
    """Share of the variance between conditions at each position: between over total."""
    e = long_epochs(spark, sf_dir)
    by = e.groupBy("t", "condition").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    out = by.groupBy("t").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("w"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return out.select("t", F.try_divide(between, between + F.col("w")).alias("share")).select("t", *r6("share"))


QUERIES = {
    f.__name__: f
    for f in (
        stream_info, first_appearance, verify_readable, recording_start, format_bytes, open_session, decide_reviews, baseline_logratio,
        baseline_percent, baseline_zscore, plan_products, off_clock_events, upsert_workers, zoned_stamps, bad_bands, role_rank,
        source_potentials, encoding_pattern, instantaneous_gap, variance_shares,
    )
}

_BASE = f"with {EPOCHS_SQL}, e as (select condition, t::bigint as t, avg(value * value) as v from long_epochs group by 1, 2), b as (select condition, avg(v) as m, stddev_samp(v) as s from e where t between 0 and 15 group by 1) select condition, t, round({{}}, 6) + 0.0 as value from e join b using (condition)"
ORACLES = {
    "stream_info": f"with {SAMPLES_SQL}, s as (select session, channel, count(value) as n, min(onset - 1704067200) as t0, max(onset - 1704067200) as t1 from samples group by 1, 2), r as (select *, coalesce((n - 1) / nullif(t1 - t0, 0), 0) as rate from s) select session, channel, n, round(t0, 3) + 0.0 as t0, round(coalesce(n / nullif(rate, 0), 0), 3) + 0.0 as duration_s, round(rate * 1e6, 3) + 0.0 as rate, round(rate / 2 * 1e6, 3) + 0.0 as nyquist from r",
    "first_appearance": f"with {SAMPLES_SQL}, f as (select session, channel, min(onset) as first from samples group by 1, 2) select session, channel, row_number() over (partition by session order by first, channel) as place from f",
    "verify_readable": "select source, count(*) filter (where coalesce(n_chars > 1000, false)) as opened, count(*) filter (where not coalesce(n_chars > 1000, false)) as failed from documents group by 1",
    "recording_start": f"with {SAMPLES_SQL} select session, round(min(onset - 1704067200 - 259200) filter (where onset - 1704067200 - 259200 > 0), 6) + 0.0 as t0 from samples group by 1",
    "format_bytes": "with f as (select ['INT_16', 'INT_32', 'IEEE_FLOAT_32', 'IEEE_FLOAT_64', 'OTHER'][(o_orderkey % 5 + 1)::int] as format from orders) select format, (count(*) * case format when 'INT_16' then 2 when 'INT_32' then 4 when 'IEEE_FLOAT_32' then 4 when 'IEEE_FLOAT_64' then 8 else 0 end)::bigint as bytes from f group by 1",
    "open_session": "select c_nationkey as lead, c_custkey as contact, row_number() over (partition by c_nationkey order by c_custkey) - 1 as index from customer where c_mktsegment <> 'MACHINERY' and not (c_custkey % 3 = 0 and c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT'))",
    "decide_reviews": "select l_returnflag, case when l_quantity > 10 and not (l_returnflag = 'R' and l_discount <= 0.03) then case when l_returnflag = 'R' then 'reject' else 'approve' end else 'undecided' end as verdict, count(*) as n from lineitem group by 1, 2",
    "baseline_logratio": _BASE.format("log10(v / nullif(m, 0))"),
    "baseline_percent": _BASE.format("(v - m) / nullif(m, 0)"),
    "baseline_zscore": _BASE.format("(v - m) / nullif(s, 0)"),
    "plan_products": "select p_partkey as stream, case when p_size % 9 = 0 then null when p_retailprice > 1000 then 'low_rate' else 'native' end as product, case when p_size % 9 = 0 then null when p_retailprice > 1000 then 1000.0::double else p_retailprice end as rate_out, case when p_size % 9 = 0 then 'ignored' when p_retailprice > 1000 then 'above the target rate' else 'at or below the target rate' end as reason from part",
    "off_clock_events": f"with {SAMPLES_SQL}, s as (select session, channel, onset - 1704067200 - 20000 as onset from samples), l as (select session, max(onset) - 10000 as e from s group by 1), m as (select session, channel, min(onset) as lo, max(onset) as hi from s group by 1, 2) select session, channel, round(lo, 6) + 0.0 as lo, round(hi, 6) + 0.0 as hi from m join l using (session) where lo < 0 or hi > e",
    "upsert_workers": "with n as (select c_custkey as worker, c_name as host from customer where c_custkey % 10 = 0) select * from n union all select s_suppkey, s_name from supplier where s_suppkey not in (select worker from n)",
    "zoned_stamps": "select event_id, event_id % 5 in (0, 2, 4) as zoned from events",
    "bad_bands": "with p as (select p_partkey, case when p_partkey % 7 = 0 then 'low' else (p_size - 3)::varchar end as lo from part) select p_partkey, lo from p where not coalesce(try_cast(lo as double) > 0 and 25 > try_cast(lo as double), false)",
    "role_rank": "with r as (select ['viewer', 'analyst', 'reviewer', 'admin', 'none'][(c_custkey % 5 + 1)::int] as role from customer) select role, count(*) filter (where role in ('analyst', 'reviewer', 'admin')) as may from r group by 1",
    "source_potentials": "select p_partkey, round(p_retailprice / nullif(4 * 3.141592653589793::double * 0.3::double * p_size, 0), 6) + 0.0 as v, round(log2(p_retailprice / nullif(p_size * sqrt(12), 0)), 6) + 0.0 as bits from part",
    "encoding_pattern": f"with {EPOCHS_SQL} select t::bigint as t, round(regr_slope(value, condition), 8) + 0.0 as slope, round(regr_r2(value, condition), 8) + 0.0 as r2 from long_epochs group by 1",
    "instantaneous_gap": f"with {SAMPLES_SQL}, p as (select session, onset - floor(onset / 86400) * 86400 as phase, onset from samples), d as (select session, phase - lag(phase) over (partition by session order by onset) + 43200 as d from p), w as (select session, d - floor(d / 86400) * 86400 - 43200 as step from d where d is not null) select session, round(sum(step), 3) + 0.0 as turned, round(max(step), 3) + 0.0 as most from w group by 1",
    "variance_shares": f"with {EPOCHS_SQL}, b as (select t::bigint as t, condition, count(value) as n, avg(value) as m, var_pop(value) as v from long_epochs group by 1, 2), s as (select t, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) as b, sum(n * v) as w from b group by 1) select t, round(b / nullif(b + w, 0), 6) + 0.0 as share from s",
}
