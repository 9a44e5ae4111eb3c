"""Queries over windows, events, merges and normalisations."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tidewave.operators import normalize as Z
from tidewave.operators import relations as R
from tidewave.operators import stats
from tidewave.plans.spectral import r6
from tidewave.plans.tables import EPOCHS_SQL, SAMPLES_SQL, long_epochs, samples, table

CELL = 86_400.0


def _windows(s):
    """Windows that purchases open: ten hours, a condition by turns."""
    p = s.where("channel = 'purchase'")
    return p.select(
        "session", F.concat(F.lit("c"), (F.col("i") % 3).cast("string")).alias("condition"),
        F.col("onset").alias("t0"), (F.col("onset") + 36000).alias("t1"), F.col("i").alias("ord"),
    )


_WINDOWS = f"""with {SAMPLES_SQL}, windows as (
  select session, 'c' || (i % 3)::varchar as condition, onset as t0, onset + 36000 as t1, i as ord from samples where channel = 'purchase'
)
"""


def range_label_conditions(spark, sf_dir):
    s = samples(spark, sf_dir)
    return R.label_conditions(s, _windows(s), CELL).select("session", "channel", "i", "condition")


def event_semi_window(spark, sf_dir):
    s = samples(spark, sf_dir)
    return R.events_in_windows(s.where("channel = 'error'"), _windows(s).where("condition = 'c1'"), CELL).select("session", "i", *r6("onset"))


def within_recording(spark, sf_dir):
    return R.within_recording(samples(spark, sf_dir), -3600.0, 7200.0).select("session", "channel", "i")


def asof_next_onset(spark, sf_dir):
    return R.next_onset(samples(spark, sf_dir).where("channel = 'click'")).select("session", *r6("onset", "extent_end"))




def full_outer_decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 3 <> 0").select(
        F.col("o_orderkey").alias("flag_id"), F.col("o_orderpriority").alias("severity"),
        F.when(F.col("o_orderstatus") == "F", "approve").alias("verdict"), F.col("o_custkey").cast("string").alias("reviewer"),
    )
    new = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("flag_id"), F.concat(F.lit("new "), "o_orderpriority").alias("severity"))
    return R.merge_decisions(old, new)


def compare_params(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    key = ["l_orderkey", "l_linenumber"]
    one = li.groupBy(*key).agg(F.max("l_quantity").alias("value"))
    a = one.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("key"), "value").where("value > 10")
    b = one.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("key"), F.when(F.col("value") % 7 != 0, F.col("value")).alias("value")).where("coalesce(value, 0) < 40")
    return R.compare_params(a, b)


def time_to_sample(spark, sf_dir):
    s = samples(spark, sf_dir)
    start = F.lit(1704067200.0)
    index = R.time_to_sample(F.col("onset") - start, 0.5, F.lit(1_000_000).cast("long"))
    return s.select("session", "channel", "i", index.alias("sample"))


def page_offset_limit(spark, sf_dir):
    return R.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 100, 50)


def montage_spread(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    out = s.groupBy("n_regionkey").agg(
        F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"), F.countDistinct("n_nationkey").alias("n_derivations"), F.avg("s_acctbal").alias("m")
    )
    return out.select("n_regionkey", "lo", "hi", (F.round(F.col("hi") - F.col("lo"), 6) + 0.0).alias("spread"), "n_derivations", *r6("m"))


def subjects_rollup(spark, sf_dir):
    """Per session its counts, and its channels and conditions as arrays."""
    s = samples(spark, sf_dir)
    chans = s.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))
    conds = _windows(s).groupBy("session").agg(F.array_join(F.array_sort(F.collect_set("condition")), ",").alias("conditions"), F.count(F.lit(1)).alias("n_windows"))
    return chans.join(conds, "session", "left").select("session", "n", "channels", F.coalesce("conditions", F.lit("")).alias("conditions"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"))


def moving_excursion(spark, sf_dir):
    return R.moving_excursion(samples(spark, sf_dir), ["session", "channel"], "i", "value").select("session", "channel", *r6("excursion"))


def contrast_drift(spark, sf_dir):
    """Drift against effect for a session's channel: the channels are bands, days of the week conditions."""
    s = samples(spark, sf_dir)
    rows = s.select("channel", F.pmod(F.floor(F.col("onset") / 86400), F.lit(7)).alias("condition"), F.struct("onset", "session", "i").alias("ord"), "value")
    return R.contrast_drift(rows, "channel", 0).select("channel", *r6("effect", "excursion", "ratio"))


def window_spans(spark, sf_dir):
    """From a session's first sample to its last."""
    s = samples(spark, sf_dir).select("session", F.col("onset").alias("t_start_s"), (F.col("onset") + F.when(F.col("value") > 0, 1.0)).alias("t_end_s"))
    return R.window_span(s, ["session"]).select("session", *r6("span_s"))


def refractory_events(spark, sf_dir):
    s = samples(spark, sf_dir)
    return R.refractory(s, ["session"], 43200.0).select("session", *r6("onset"))


def blank_and_interpolate(spark, sf_dir):
    out = R.blank_and_interpolate(samples(spark, sf_dir), ["session", "channel"], "i", "value", F.col("value") > 60)
    return out.select("session", "channel", "i", *r6("filled"))


def psth(spark, sf_dir):
    s = samples(spark, sf_dir)
    clicks, triggers = s.where("channel = 'click'"), s.where("channel = 'signup'").select("session", "onset")
    return R.psth(clicks, triggers, 36000.0, 36000.0, 7200.0).select("session", F.col("bin").cast("long").alias("bin"), "n")


def isi_statistics(spark, sf_dir):
    """Interval statistics per channel: violations of a refractory period, mean, Fano factor of daily counts."""
    from pyspark.sql import Window as W

    s = samples(spark, sf_dir)
    gap = F.col("onset") - F.lag("onset").over(W.partitionBy("session", "channel").orderBy("onset", "i"))
    isi = s.withColumn("gap", gap).groupBy("channel").agg(F.count("gap").alias("n"), F.count_if(F.col("gap") < 3600).alias("violations"), F.avg("gap").alias("mean_gap"))
    days = s.groupBy("channel", F.floor(F.col("onset") / 86400).alias("day")).agg(F.count(F.lit(1)).alias("c"))
    fano = days.groupBy("channel").agg((F.var_samp("c") / F.avg("c")).alias("fano"))
    return isi.join(fano, "channel").select("channel", "n", "violations", *r6("mean_gap", "fano"))


def pooled_sd(spark, sf_dir):
    return R.pooled_sd(_moments(spark, sf_dir), ["t"]).select("t", *r6("pooled"))


def _moments(spark, sf_dir):
    """key t, condition: value, sd, n over trials."""
    e = long_epochs(spark, sf_dir)
    return e.groupBy("t", "condition").agg(F.avg("value").alias("value"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.count("value").alias("n"))


_MOMENTS = f"""with {EPOCHS_SQL}, moments as (
  select t::bigint as t, condition, avg(value) as value, coalesce(stddev_samp(value), 0) as sd, count(value) as n from long_epochs group by 1, 2
)
"""


def _z(spark, sf_dir, center, scale):
    return Z.normalize(_moments(spark, sf_dir), center, scale, ["t"], 1).select("t", "condition", *r6("z"))


_CENTER = {
    "grand_mean": "avg(value) over w", "condition": "avg(value) filter (where condition = 1) over w",
    "whole_recording": "sum(value * n) over w / nullif(sum(n) over w, 0)", "none": "0.0",
}
_SCALE = {
    "pooled": "sqrt(sum((n - 1) * sd * sd) over w / nullif(sum(n - 1) over w, 0))", "own_condition": "sd",
    "condition": "avg(sd) filter (where condition = 1) over w", "across_conditions": "stddev_samp(value) over w", "none": "1.0",
}


def erp_average(spark, sf_dir):
    """Per condition and sample: mean and standard error over trials."""
    m = _moments(spark, sf_dir)
    return m.select("condition", "t", (F.round("value", 6) + 0.0).alias("mean"), (F.round(F.col("sd") / F.sqrt("n"), 6) + 0.0).alias("sem"), "n")


def erp_peak(spark, sf_dir):
    """Per condition the largest deviation in samples 10 to 40, and the noise of the baseline."""
    m = _moments(spark, sf_dir)
    inside = F.when(F.col("t").between(10, 40), F.col("value"))
    out = m.groupBy("condition").agg(
        F.max_by("t", F.struct(F.abs(inside), -F.col("t"))).alias("peak_t"), F.max(F.abs(inside)).alias("peak"),
        F.sqrt(F.avg(F.when(F.col("t") < 10, F.col("value") * F.col("value")))).alias("baseline_rms"),
    )
    return out.select("condition", "peak_t", *r6("peak", "baseline_rms"))


def baseline_correct(spark, sf_dir):
    """Every sample less its trial's mean over the first ten samples, closed; one array expression per trial."""
    from tidewave.functions import arrays as A
    from tidewave.plans.tables import epochs

    base = A.mean(F.slice("x", 1, 10))
    e = epochs(spark, sf_dir).withColumn("b", base)
    return e.select("trial", F.posexplode(F.transform("x", lambda v: v - F.col("b"))).alias("t", "v")).select("trial", F.col("t").cast("long").alias("t"), (F.round("v", 6) + 0.0).alias("value"))


def t_clusters(spark, sf_dir):
    tm = stats.t_map(long_epochs(spark, sf_dir), ["condition"])
    return stats.cluster_masses(tm, ["condition"], 1.0).select("condition", "sign", "first", "last", *r6("mass"))


def bh_fdr(spark, sf_dir):
    """The step-up procedure over p values exp(-value/10) of each session's events."""
    s = samples(spark, sf_dir).withColumn("p", F.exp(-F.col("value") / 4))
    out = stats.benjamini_hochberg(s.select("session", "channel", "i", "p"), 0.1, ["session"])
    return out.groupBy("session").agg(F.count_if("rejected").alias("n_rejected"), F.count(F.lit(1)).alias("n"))


def permutation_contrast(spark, sf_dir):
    values = long_epochs(spark, sf_dir).groupBy("trial", "condition", F.floor(F.col("t") / 16).cast("long").alias("quarter")).agg(F.avg("value").alias("value"))
    return stats.permutation_contrast(values, "quarter").select("quarter", "a", "b", *r6("effect", "p", "lo", "hi"))


QUERIES = {
    f.__name__: f
    for f in (
        range_label_conditions, event_semi_window, within_recording, asof_next_onset, full_outer_decisions, compare_params,
        time_to_sample, page_offset_limit, montage_spread, subjects_rollup, moving_excursion, contrast_drift, window_spans, refractory_events,
        blank_and_interpolate, psth, isi_statistics, pooled_sd, erp_average, erp_peak, baseline_correct, t_clusters, bh_fdr,
        permutation_contrast,
    )
} | {f"z_{c}_{s}": partial(_z, center=c, scale=s) for c in Z.CENTERS for s in Z.SCALES}
ORACLES = {
    "range_label_conditions": _WINDOWS + """select s.session, channel, i, coalesce(arg_max(w.condition, w.ord), '') as condition
      from samples s left join windows w on s.session = w.session and onset >= t0 and onset < t1 group by 1, 2, 3""",
    "event_semi_window": _WINDOWS + """select session, i, round(onset, 6) + 0.0 as onset from samples s where channel = 'error' and exists (
      select 1 from windows w where w.session = s.session and condition = 'c1' and onset >= t0 and onset < t1)""",
    "within_recording": f"""with {SAMPLES_SQL} select session, channel, i from (select *, min(onset) over (partition by session) as lo,
      max(onset) over (partition by session) as hi from samples) where onset - 3600 >= lo and onset + 7200 <= hi""",
    "asof_next_onset": f"""with {SAMPLES_SQL}, c as (select distinct session, onset from samples where channel = 'click')
      select session, round(onset, 6) + 0.0 as onset, round(coalesce((select min(n.onset) from c n where n.session = c.session and n.onset > c.onset),
        (select max(n.onset) from c n where n.session = c.session)), 6) + 0.0 as extent_end from c""",
    "full_outer_decisions": """with o as (select o_orderkey as flag_id, o_orderpriority as severity, case when o_orderstatus = 'F' then 'approve' end as verdict,
        o_custkey::varchar as reviewer from orders where o_orderkey % 3 <> 0),
      n as (select o_orderkey as flag_id, 'new ' || o_orderpriority as severity from orders where o_orderkey % 5 <> 0)
      select flag_id, coalesce(n.severity, o.severity) as severity, verdict, reviewer,
        case when n.severity is null then 'stale' when o.severity is null then 'new' else 'kept' end as state from o full join n using (flag_id)""",
    "compare_params": """with one as (select l_orderkey as run, l_linenumber as key, max(l_quantity) as value from lineitem group by 1, 2),
      x as (select run, key, value as a from one where value > 10),
      y as (select run, key, b from (select run, key, case when value % 7 <> 0 then value end as b from one) where coalesce(b, 0) < 40)
      select run, key, a, b from x full join y using (run, key) where a is distinct from b""",
    "time_to_sample": f"""with {SAMPLES_SQL} select session, channel, i,
      least(greatest(round_even((onset - 1704067200.0::double) * 0.5::double, 0)::bigint, 0), 1000000) as sample from samples""",
    "page_offset_limit": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50 offset 100",
    "montage_spread": """select n_regionkey, min(s_acctbal) as lo, max(s_acctbal) as hi, round(max(s_acctbal) - min(s_acctbal), 6) + 0.0 as spread,
      count(distinct n_nationkey) as n_derivations, round(avg(s_acctbal), 6) + 0.0 as m from supplier join nation on s_nationkey = n_nationkey group by 1""",
    "subjects_rollup": _WINDOWS + """, c as (select session, count(*) as n, string_agg(distinct channel, ',' order by channel) as channels from samples group by 1),
      d as (select session, string_agg(distinct condition, ',' order by condition) as conditions, count(*) as n_windows from windows group by 1)
      select session, n, channels, coalesce(conditions, '') as conditions, coalesce(n_windows, 0) as n_windows from c left join d using (session)""",
    "moving_excursion": f"""with {SAMPLES_SQL}, l as (select session, channel, list(value order by i) as v, count(value) as n, greatest(count(value) // 5, 3) as w from samples group by 1, 2),
      m as (select session, channel, case when n >= 5 then list_transform(range(w, n + 1), lambda k: list_sum(v[k - w + 1:k]) / w) end as a from l)
      select session, channel, round(list_max(a) - list_min(a), 6) + 0.0 as excursion from m""",
    "contrast_drift": f"""with {SAMPLES_SQL}, r as (select channel, (floor(onset / 86400)::bigint % 7 + 7) % 7 as condition, onset, session, i, value from samples),
      e as (select channel, max(m) - min(m) as effect from (select channel, condition, avg(value) as m from r group by 1, 2) group by 1 having count(*) > 1 order by effect desc, channel desc limit 1),
      l as (select channel, list(value order by onset, session, i) as v, greatest(count(*) // 5, 3) as w from r join e using (channel) where condition = 0 group by 1),
      m as (select channel, list_transform(range(w, len(v) + 1), lambda k: list_sum(v[k - w + 1:k]) / w) as a from l)
      select channel, round(effect, 6) + 0.0 as effect, round(list_max(a) - list_min(a), 6) + 0.0 as excursion, round((list_max(a) - list_min(a)) / effect, 6) + 0.0 as ratio from e join m using (channel)""",
    "window_spans": f"""with {SAMPLES_SQL}, w as (select session, onset as a, onset + case when value > 0 then 1.0 end as b from samples)
      select session, round(case when count(*) = count(b) and max(b) > min(a) then max(b) - min(a) end, 6) + 0.0 as span_s from w group by 1""",
    "refractory_events": f"""with recursive {SAMPLES_SQL}, e as (select session, onset, row_number() over (partition by session order by onset) as r from samples),
      f as (select session, r, onset, onset as last, true as kept from e where r = 1
        union all select e.session, e.r, e.onset, case when e.onset - f.last >= 43200 then e.onset else f.last end, e.onset - f.last >= 43200
        from f join e on e.session = f.session and e.r = f.r + 1)
      select session, round(onset, 6) + 0.0 as onset from f where kept""",
    "blank_and_interpolate": f"""with {SAMPLES_SQL}, n as (select *,
        last_value(case when value <= 60 then value end ignore nulls) over b as v0, last_value(case when value <= 60 then i end ignore nulls) over b as t0,
        first_value(case when value <= 60 then value end ignore nulls) over a as v1, first_value(case when value <= 60 then i end ignore nulls) over a as t1
      from samples window b as (partition by session, channel order by i rows between unbounded preceding and current row),
        a as (partition by session, channel order by i rows between current row and unbounded following))
      select session, channel, i, round(coalesce(v0 + (v1 - v0) * coalesce((i - t0)::double / nullif(t1 - t0, 0), 0), v0, v1), 6) + 0.0 as filled from n""",
    "psth": f"""with {SAMPLES_SQL} select c.session, floor((c.onset - s.onset) / 7200)::bigint as bin, count(*) as n from samples c join samples s
      on c.session = s.session and c.channel = 'click' and s.channel = 'signup' and c.onset >= s.onset - 36000 and c.onset < s.onset + 36000 group by 1, 2""",
    "isi_statistics": f"""with {SAMPLES_SQL}, g as (select channel, onset - lag(onset) over (partition by session, channel order by onset, i) as gap from samples),
      a as (select channel, count(gap) as n, count(*) filter (where gap < 3600) as violations, avg(gap) as mean_gap from g group by 1),
      d as (select channel, floor(onset / 86400) as day, count(*) as c from samples group by 1, 2),
      f as (select channel, var_samp(c) / avg(c) as fano from d group by 1)
      select channel, n, violations, round(mean_gap, 6) + 0.0 as mean_gap, round(fano, 6) + 0.0 as fano from a join f using (channel)""",
    "pooled_sd": _MOMENTS + """select t, round(sqrt(case when sum(n - 1) > 0 then sum((n - 1) * sd * sd) / sum(n - 1) else avg(sd * sd) end), 6) + 0.0 as pooled
      from moments group by 1""",
    "erp_average": _MOMENTS + "select condition, t, round(value, 6) + 0.0 as mean, round(sd / sqrt(n), 6) + 0.0 as sem, n from moments",
    "erp_peak": _MOMENTS + """, r as (select *, row_number() over (partition by condition order by case when t between 10 and 40 then abs(value) end desc nulls last, t) as r from moments)
      select condition, max(t) filter (where r = 1) as peak_t, round(max(abs(value)) filter (where t between 10 and 40), 6) + 0.0 as peak,
        round(sqrt(avg(value * value) filter (where t < 10)), 6) + 0.0 as baseline_rms from r group by 1""",
    "baseline_correct": f"""with {EPOCHS_SQL} select trial, t::bigint as t, round(value - avg(value) filter (where t < 10) over (partition by trial), 6) + 0.0 as value from long_epochs""",
    "t_clusters": f"""with {EPOCHS_SQL}, tm as (select condition, t, avg(value) / nullif(stddev_samp(value) / sqrt(count(value)), 0) as v from long_epochs group by 1, 2),
      r as (select *, sign(v)::bigint as s, t - row_number() over (partition by condition, sign(v) order by t) as island from tm where abs(v) > 1)
      select condition, s as sign, min(t)::bigint as first, max(t)::bigint as last, round(sum(abs(v)), 6) + 0.0 as mass from r group by 1, 2, island""",
    "bh_fdr": f"""with {SAMPLES_SQL}, p as (select session, exp(-value / 4) as p from samples),
      r as (select *, row_number() over (partition by session order by p) as r, count(*) over (partition by session) as m from p),
      l as (select *, max(case when p <= r * 0.1::double / m then p end) over (partition by session) as last from r)
      select session, count(*) filter (where p <= last) as n_rejected, count(*) as n from l group by 1""",
} | {
    f"z_{c}_{s}": _MOMENTS + f"select t, condition, round((value - {_CENTER[c]}) / nullif({_SCALE[s]}, 0), 6) + 0.0 as z from moments window w as (partition by t)"
    for c in Z.CENTERS for s in Z.SCALES
}
