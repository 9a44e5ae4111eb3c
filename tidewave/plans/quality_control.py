"""Queries of the detectors and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewave.functions import arrays as A
from tidewave.operators import quality_control as Q
from tidewave.operators import summaries as U
from tidewave.plans.spectral import r6
from tidewave.plans.tables import EPOCHS_SQL, SAMPLES_SQL, epochs, samples, table


def qc_robust_z(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice")
    out = Q.robust_z_of_large_groups(li, "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return out.where("abs(z) > 1.25").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), *r6("z"))


def qc_flat(spark, sf_dir):
    return Q.flat_channels(samples(spark, sf_dir), ["session"], 0.5).select("session", "channel", *r6("sd", "median_sd"))


def qc_variance_outlier(spark, sf_dir):
    """Channels whose spread is far from that of the session's channels."""
    sd = samples(spark, sf_dir).groupBy("session", "channel").agg(F.stddev_pop("value").alias("sd"))
    logs = sd.withColumn("value", F.log10(F.col("sd") + 1e-12))
    return Q.group_outliers(logs, "value", ["session"], 3.0, 4).select("session", "channel", *r6("z"), "flag")


def qc_block_kurtosis(spark, sf_dir):
    return Q.block_kurtosis(samples(spark, sf_dir), ["session", "channel"], 6).select("session", "channel", *r6("kurtosis"), "blocks")


def qc_kurtosis_outlier(spark, sf_dir):
    """Channels whose blocks' median kurtosis is above a cutoff, with the evidence."""
    out = Q.block_kurtosis(samples(spark, sf_dir), ["session", "channel"], 6).where("kurtosis > 1.0")
    flag = Q.flag_id(F.lit("channel"), F.concat(F.col("session").cast("string"), F.lit("/"), "channel"), F.lit("kurtosis_outlier"), F.lit("kurtosis_outlier"))
    return out.select("session", "channel", flag.alias("flag_id"), *r6("kurtosis"), "blocks")


def qc_comparison_groups(spark, sf_dir):
    """Suppliers as channels: their peers by nation, and by balance where they are told apart."""
    s = table(spark, sf_dir, "supplier")
    kind = F.when(F.col("s_acctbal") > 5000, "ring").when(F.col("s_acctbal") > 0, "segment")
    group = Q.comparison_group(F.col("s_nationkey").cast("string"), kind)
    return s.groupBy(group.alias("peers")).agg(F.count(F.lit(1)).alias("n"))


def channels_by_role(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    role = F.when(F.col("p_size") < 10, "neural").when(F.col("p_size") < 20, "audio").when(F.col("p_size") < 30, "")
    out = Q.channels_by_role(p, ["p_brand"], role, "p_partkey")
    return out.select("p_brand", "role", F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("indices"))


def qc_clipping(spark, sf_dir):
    return Q.clipping(samples(spark, sf_dir), ["session", "channel"]).select("session", "channel", "rail", *r6("fraction"))


def qc_amplitude_episodes(spark, sf_dir):
    out = Q.amplitude_episodes(samples(spark, sf_dir), ["session", "channel"], 2, 1.5, 5)
    return out.select("session", "channel", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), *r6("z"))


def qc_trial_outlier(spark, sf_dir):
    return Q.trial_outliers(epochs(spark, sf_dir), 2.0).select("trial", "condition", *r6("p2p", "z"))


def qc_spikes(spark, sf_dir):
    return Q.spikes(samples(spark, sf_dir), ["session", "channel"], 2.0, 2).select("session", "channel", "i", "peak")


def qc_hf_noise(spark, sf_dir):
    from tidewave.plans.spectral import _spectra

    s = _spectra(spark, sf_dir)
    ratio = s.groupBy("trial", "condition").agg(
        F.log10(F.avg(F.when(F.col("freq") >= 40, F.col("power"))) / F.avg(F.when((F.col("freq") >= 1) & (F.col("freq") < 20), F.col("power")))).alias("ratio")
    )
    return Q.robust_z(ratio, "ratio", ["condition"]).where("abs(z) > 1.5").select("trial", "condition", *r6("ratio", "z"))


def qc_flag_ids(spark, sf_dir):
    flat = Q.flat_channels(samples(spark, sf_dir), ["session"], 0.6)
    named = flat.select(
        F.lit("channel").alias("type"), F.concat(F.col("session").cast("string"), F.lit("/"), "channel").alias("target"), F.lit("flat").alias("flag"), F.lit("flat_channels").alias("detector"),
        F.create_map(F.lit("session"), F.col("session").cast("string"), F.lit("channel"), F.col("channel")).alias("evidence"),
    )
    return named.select(Q.flag_id("type", "target", "flag", "detector").alias("flag_id"), "target", Q.summarize_evidence(F.col("evidence")).alias("summary"))


def stream_summary(spark, sf_dir):
    states = U.chunk_summaries(samples(spark, sf_dir), ["session", "channel"], 4)
    return U.merge_summaries(states, ["session", "channel"]).select("session", "channel", "n", *r6("rms"), "lo", "hi", "n_lo", "n_hi")


def channel_covariance(spark, sf_dir):
    """Every pair of the vectors' positions; ``channel_covariance`` has the first twelve."""
    out = U.covariances(epochs(spark, sf_dir))
    return out.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), (F.round("cov", 8) + 0.0).alias("cov"), *r6("r"))


def autocorrelation(spark, sf_dir):
    """Biased autocorrelation of every trial at lags 0 to 5, as array expressions."""
    e = epochs(spark, sf_dir).select("trial", A.demean(F.col("x")).alias("x"))
    each = e.select("trial", "x", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("lag"))
    n = F.size("x")
    moved = F.slice("x", F.col("lag") + 1, n)
    own = F.slice("x", F.lit(1), n - F.col("lag"))
    return each.select("trial", F.col("lag").cast("long").alias("lag"), (F.round(F.try_divide(A.dot(own, moved), A.dot(F.col("x"), F.col("x"))), 6) + 0.0).alias("acf"))


def participation_ratio(spark, sf_dir):
    """(sum v)^2 / sum v^2 of each condition's variances by position."""
    each = epochs(spark, sf_dir).select("condition", F.posexplode("x").alias("t", "value"))
    var = each.groupBy("condition", "t").agg(F.var_samp("value").alias("v"))
    return var.groupBy("condition").agg((F.sum("v") * F.sum("v") / F.sum(F.col("v") * F.col("v"))).alias("ratio")).select("condition", *r6("ratio"))


def cosine_to_condition(spark, sf_dir):
    """Cosine of every trial with its condition's mean vector."""
    e = epochs(spark, sf_dir)
    mean = e.select("condition", F.posexplode("x").alias("t", "v")).groupBy("condition", "t").agg(F.avg("v").alias("v"))
    vectors = mean.groupBy("condition").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"]).alias("m"))
    return e.join(vectors, "condition").select("trial", (F.round(A.cosine(F.col("x"), F.col("m")), 6) + 0.0).alias("cosine"))


def fir_smooth(spark, sf_dir):
    """A five-tap causal filter over each trial: sum of b_k x[t-k] as array expressions."""
    taps = (0.1, 0.2, 0.4, 0.2, 0.1)
    e = epochs(spark, sf_dir)
    parts = [F.coalesce(F.get("x", F.col("t") - k), F.lit(0.0)) * b for k, b in enumerate(taps)]
    each = e.select("trial", "x", F.explode(F.sequence(F.lit(0), F.size("x") - 1)).alias("t"))
    value = parts[0]
    for p in parts[1:]:
        value = value + p
    return each.select("trial", F.col("t").cast("long").alias("t"), (F.round(value, 6) + 0.0).alias("value"))


def leadfield(spark, sf_dir):
    """Potential of every supplier's balance at distance one to its nation's place in the region: sums of w / r."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    r = 1 + F.abs(F.col("s_suppkey") % 10 - F.col("n_nationkey") % 5)
    return s.groupBy("n_regionkey").agg(F.sum(F.col("s_acctbal") / (4 * 3.141592653589793 * 0.3 * r)).alias("v")).select("n_regionkey", *r6("v"))


QUERIES = {
    f.__name__: f
    for f in (
        qc_robust_z, qc_flat, qc_variance_outlier, qc_block_kurtosis, qc_kurtosis_outlier, qc_comparison_groups, channels_by_role, qc_clipping, qc_amplitude_episodes, qc_trial_outlier, qc_spikes,
        qc_hf_noise, qc_flag_ids, stream_summary, channel_covariance, autocorrelation, participation_ratio, cosine_to_condition, fir_smooth, leadfield,
    )
}

from tidewave.plans.spectral import _SPECTRA  # noqa: E402

_Z = """z as (select *, {v} - quantile_cont({v}, 0.5) over (partition by {by}) as off from {src}),
  zz as (select *, coalesce(off / nullif(1.4826 * quantile_cont(abs(off), 0.5) over (partition by {by}), 0), 0) as z from z)"""
ORACLES = {
    "qc_robust_z": "with " + _Z.format(v="l_extendedprice", by="l_returnflag, l_linestatus", src="lineitem") + " select l_orderkey, l_linenumber::bigint as l_linenumber, round(z, 6) + 0.0 as z from zz where abs(z) > 1.25",
    "qc_flat": f"with {SAMPLES_SQL}, s as (select session, channel, stddev_pop(value) as sd from samples group by 1, 2), m as (select *, quantile_cont(sd, 0.5) over (partition by session) as med from s) select session, channel, round(sd, 6) + 0.0 as sd, round(med, 6) + 0.0 as median_sd from m where sd < 0.5 * med",
    "qc_variance_outlier": f"with {SAMPLES_SQL}, s as (select session, channel, log10(stddev_pop(value) + 1e-12) as v from samples group by 1, 2), m as (select *, count(*) over (partition by session) as members from s), big as (select * from m where members >= 4), "
    + _Z.format(v="v", by="session", src="big") + " select session, channel, round(z, 6) + 0.0 as z, 'outlier' as flag from zz where abs(z) > 3 union all select distinct session, null, null::double, 'insufficient_channels' from m where members < 4",
    "qc_block_kurtosis": f"with {SAMPLES_SQL}, b as (select session, channel, i // 6 as block, case when count(value) > 3 then kurtosis(value) end as k from samples group by 1, 2, 3) select session, channel, round(quantile_cont(k, 0.5), 6) + 0.0 as kurtosis, count(k) as blocks from b group by 1, 2",
    "qc_kurtosis_outlier": f"with {SAMPLES_SQL}, b as (select session, channel, i // 6 as block, case when count(value) > 3 then kurtosis(value) end as k from samples group by 1, 2, 3) select session, channel, substr(sha256('channel|' || session::varchar || '/' || channel || '|kurtosis_outlier|kurtosis_outlier'), 1, 16) as flag_id, round(quantile_cont(k, 0.5), 6) + 0.0 as kurtosis, count(k) as blocks from b group by 1, 2 having quantile_cont(k, 0.5) > 1.0",
    "qc_comparison_groups": "select s_nationkey::varchar || case when s_acctbal > 5000 then '/ring' when s_acctbal > 0 then '/segment' else '' end as peers, count(*) as n from supplier group by 1",
    "channels_by_role": "select p_brand, case when p_size < 10 then 'neural' else 'audio' end as role, string_agg(p_partkey::varchar, ',' order by p_partkey) as indices from part where p_size < 20 group by 1, 2",
    "qc_clipping": f"with {SAMPLES_SQL}, r as (select *, max(abs(value)) over (partition by session, channel) as rail from samples) select session, channel, rail, round(avg(case when abs(abs(value) - rail) <= 1e-8 + 1e-6 * rail then 1.0 else 0.0 end), 6) + 0.0 as fraction from r group by 1, 2, 3",
    "qc_amplitude_episodes": f"with {SAMPLES_SQL}, b as (select session, channel, i // 2 as block, log10(greatest(max(value) - min(value), 1e-12)) as lp from samples group by 1, 2, 3), m as (select * from (select *, count(*) over (partition by session, channel) as n from b) where n >= 5), "
    + _Z.format(v="lp", by="session, channel", src="m") + ", r as (select *, block - row_number() over (partition by session, channel order by block) as island from zz where z > 1.5) select session, channel, min(block)::bigint as first, max(block)::bigint as last, round(max(z), 6) + 0.0 as z from r group by 1, 2, island",
    "qc_trial_outlier": f"with {EPOCHS_SQL}, p as (select trial, condition, list_max(x) - list_min(x) as p2p from epochs), " + _Z.format(v="p2p", by="condition", src="p") + " select trial, condition, round(p2p, 6) + 0.0 as p2p, round(z, 6) + 0.0 as z from zz where abs(z) > 2",
    "qc_spikes": f"with {SAMPLES_SQL}, g as (select *, quantile_cont(abs(value), 0.5) over (partition by session, channel) / 0.6745 as sigma from samples), o as (select *, coalesce(i - lag(i) over (partition by session, channel order by i) > 2, true) as far from g where abs(value) > 2 * sigma), s as (select *, sum(far::int) over (partition by session, channel order by i) as island from o), r as (select *, row_number() over (partition by session, channel, island order by abs(value) desc, i) as r from s) select session, channel, i, abs(value) as peak from r where r = 1",
    "qc_hf_noise": _SPECTRA + ", p as (select trial, condition, log10(avg(power) filter (where freq >= 40) / avg(power) filter (where freq >= 1 and freq < 20)) as ratio from spectra group by 1, 2), " + _Z.format(v="ratio", by="condition", src="p") + " select trial, condition, round(ratio, 6) + 0.0 as ratio, round(z, 6) + 0.0 as z from zz where abs(z) > 1.5",
    "qc_flag_ids": f"with {SAMPLES_SQL}, s as (select session, channel, stddev_pop(value) as sd from samples group by 1, 2), m as (select *, quantile_cont(sd, 0.5) over (partition by session) as med from s) select substr(sha256('channel|' || session::varchar || '/' || channel || '|flat|flat_channels'), 1, 16) as flag_id, session::varchar || '/' || channel as target, 'channel=' || channel || ', session=' || session::varchar as summary from m where sd < 0.6 * med",
    "stream_summary": f"with {SAMPLES_SQL}, e as (select *, min(value) over (partition by session, channel) as lo, max(value) over (partition by session, channel) as hi from samples) select session, channel, count(*) as n, round(sqrt(avg(value * value)), 6) + 0.0 as rms, lo, hi, count(*) filter (where value = lo) as n_lo, count(*) filter (where value = hi) as n_hi from e group by session, channel, lo, hi",
    "channel_covariance": f"with {EPOCHS_SQL}, p as (select a, b, x[a + 1] as u, x[b + 1] as v from (select x, unnest(range(0, len(x))) as a from epochs), lateral (select unnest(range(a, len(x))) as b) q) select a, b, round(covar_samp(u, v), 8) + 0.0 as cov, round(corr(u, v), 6) + 0.0 as r from p group by 1, 2",
    "autocorrelation": f"with {EPOCHS_SQL}, d as (select trial, t, value - avg(value) over (partition by trial) as v from long_epochs), s as (select trial, sum(v * v) as ss from d group by 1) select x.trial, k as lag, round(sum(x.v * y.v) / nullif(max(ss), 0), 6) + 0.0 as acf from d x, range(0, 6) r(k), d y, s where y.trial = x.trial and y.t = x.t + k and s.trial = x.trial group by 1, 2",
    "participation_ratio": f"with {EPOCHS_SQL}, v as (select condition, t, var_samp(value) as v from long_epochs group by 1, 2) select condition, round(sum(v) * sum(v) / sum(v * v), 6) + 0.0 as ratio from v group by 1",
    "cosine_to_condition": f"with {EPOCHS_SQL}, m as (select condition, t, avg(value) as m from long_epochs group by 1, 2) select trial, round(sum(value * m) / nullif(sqrt(sum(value * value)) * sqrt(sum(m * m)), 0), 6) + 0.0 as cosine from long_epochs join m using (condition, t) group by 1",
    "fir_smooth": f"with {EPOCHS_SQL} select trial, t::bigint as t, round(0.1 * value + 0.2 * coalesce(lag(value, 1) over w, 0) + 0.4 * coalesce(lag(value, 2) over w, 0) + 0.2 * coalesce(lag(value, 3) over w, 0) + 0.1 * coalesce(lag(value, 4) over w, 0), 6) + 0.0 as value from long_epochs window w as (partition by trial order by t)",
    "leadfield": "select n_regionkey, round(sum(s_acctbal / (4 * 3.141592653589793::double * 0.3::double * (1 + abs(s_suppkey % 10 - n_nationkey % 5)))), 6) + 0.0 as v from supplier join nation on s_nationkey = n_nationkey group by 1",
}
