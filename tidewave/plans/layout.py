"""Queries of proposals, epochs, fits and small formulas over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewave.functions import arrays as A
from tidewave.operators import layout as L
from tidewave.plans.spectral import r6
from tidewave.plans.tables import EPOCHS_SQL, SAMPLES_SQL, epochs, long_epochs, samples, table

PATTERNS = [("^src1", "first"), ("[02468]$", "even"), ("9$", "ignore"), ("^src1[0-4]$", "first")]
PHRASES = ["and the", "and the other", "the other", "of the", "in the house", "the"]


def role_classification(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return L.classify_by_patterns(d, "source", PATTERNS)


def _sweep(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") % 50).alias("lead"), F.col("p_partkey").alias("contact"), F.col("p_size").cast("double").alias("kohm"))


def impedance_kinds(spark, sf_dir):
    return L.contact_kinds(_sweep(spark, sf_dir), ["lead"], 5.0).select("lead", "contact", "kind")


def impedance_geometry(spark, sf_dir):
    out = L.geometry(L.contact_kinds(_sweep(spark, sf_dir), ["lead"], 5.0), ["lead"], "contact")
    return out.select("lead", F.array_join(F.transform("geometry", lambda v: v.cast("string")), ",").alias("geometry"))


def differential_pairs(spark, sf_dir):
    return L.differential_pairs(_sweep(spark, sf_dir), ["lead"])


def propose_conditions(spark, sf_dir):
    labels = table(spark, sf_dir, "part").select(F.col("p_name").alias("label"))
    return L.longest_pattern(labels, [("ring", "a"), ("small ring", "b"), ("l", "c"), ("re", "d")])


def found_phrases(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(L.found_phrases(F.lower("text"), PHRASES), "|").alias("phrases"))


def confidence_bands(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(L.confidence_band(1 - F.col("l_discount") * 6).alias("band"))
    return li.agg(F.count(F.lit(1)).alias("n"))


def epoch_bounds(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(0.0).alias("t0"), (F.col("o_orderkey") % 23).cast("double").alias("t1"))
    return L.epoch_bounds(o, 4.0, 0.5).select("o_orderkey", "a", "b")


def epoch_matrix(spark, sf_dir):
    s = samples(spark, sf_dir)
    out = L.epoch_matrix(s, s.where("value > 30"), 2, 2)
    return out.select("session", "channel", "trigger", (F.round(A.mean(F.col("x")), 6) + 0.0).alias("mean"))


def decay_fit(spark, sf_dir):
    s = samples(spark, sf_dir).select("session", "channel", F.col("i").cast("double").alias("t"), "value")
    return L.decay_fit(s, ["session", "channel"], 0.05).select("session", "channel", *r6("tau", "r2"))


def nonstationarity(spark, sf_dir):
    s = samples(spark, sf_dir).select("session", F.col("channel").alias("condition"), F.col("onset").alias("ord"), "value")
    return L.drift_over_effect(s, ["session"], 10).select("session", *r6("excursion", "effect"), (F.round("ratio", 5) + 0.0).alias("ratio"))


def blocked_folds(spark, sf_dir):
    out = L.blocked_folds(samples(spark, sf_dir), ["session"], "onset", 5)
    return out.groupBy("session", "fold").agg(F.count(F.lit(1)).alias("n"), F.min("onset").alias("m")).select("session", "fold", "n", *r6("m"))


def vector_formulas(spark, sf_dir):
    """Norm, mean square, line length and crest of every epoch."""
    e = epochs(spark, sf_dir)
    n = A.norm(F.col("x"))
    line = A.total(F.zip_with(F.slice("x", 2, 63), F.slice("x", 1, 63), lambda a, b: F.abs(a - b)))
    return e.select("trial", n.alias("norm"), (n * n / F.size("x")).alias("power"), line.alias("line"), (F.array_max(F.transform("x", F.abs)) / n).alias("crest")).select("trial", *r6("norm", "power", "line", "crest"))


def hjorth(spark, sf_dir):
    """Activity, mobility and complexity of every epoch, from variances of its differences."""
    diff = lambda x: F.zip_with(F.slice(x, F.lit(2), F.size(x) - 1), F.slice(x, F.lit(1), F.size(x) - 1), lambda a, b: a - b)
    var = lambda x: F.try_divide(A.dot(x, x), F.size(x)) - A.mean(x) * A.mean(x)
    e = epochs(spark, sf_dir).select("trial", "x", diff(F.col("x")).alias("d")).select("trial", "x", "d", diff(F.col("d")).alias("dd"))
    v = e.select("trial", var(F.col("x")).alias("v0"), var(F.col("d")).alias("v1"), var(F.col("dd")).alias("v2"))
    mobility = F.sqrt(F.try_divide("v1", "v0"))
    return v.select("trial", F.col("v0").alias("activity"), mobility.alias("mobility"), (F.sqrt(F.try_divide("v2", "v1")) / mobility).alias("complexity")).select("trial", *r6("activity", "mobility", "complexity"))


def pearson_by_condition(spark, sf_dir):
    """The same for every pair of neighbouring samples; k is the place of the first, from 0."""
    e = epochs(spark, sf_dir).where(F.size("x") > 1)
    pairs = F.transform(F.sequence(F.lit(0), F.size("x") - 2), lambda k: F.struct(k.cast("long").alias("k"), F.get("x", k).alias("u"), F.get("x", k + 1).alias("v")))
    each = e.select("condition", F.inline(pairs))
    return each.groupBy("condition", "k").agg(F.corr("u", "v").alias("r"), F.sqrt(F.avg((F.col("u") - F.col("v")) * (F.col("u") - F.col("v")))).alias("rmse")).select("condition", "k", *r6("r", "rmse"))


def effective_samples(spark, sf_dir):
    """n, lag-one correlation and n / ((1 + r) / (1 - r)) of each channel: samples that count as independent."""
    from pyspark.sql import Window as W

    s = samples(spark, sf_dir).withColumn("last", F.lag("value").over(W.partitionBy("session", "channel").orderBy("i")))
    out = s.groupBy("channel").agg(F.count("value").alias("n"), F.corr("value", "last").alias("r"))
    return out.select("channel", "n", "r", (F.col("n") * (1 - F.col("r")) / (1 + F.col("r"))).alias("n_eff")).select("channel", "n", *r6("r", "n_eff"))


def marginal_means(spark, sf_dir):
    """Means over trials by condition and quarter, by each alone, and over all: one pass of grouping sets."""
    e = long_epochs(spark, sf_dir).withColumn("quarter", F.floor(F.col("t") / 16).cast("long"))
    return e.cube("condition", "quarter").agg(F.avg("value").alias("m")).select(F.coalesce("condition", F.lit(-1)).alias("condition"), F.coalesce("quarter", F.lit(-1)).alias("quarter"), *r6("m"))


def random_walk_variance(spark, sf_dir):
    """Variance over channels of the running sum, by step."""
    from pyspark.sql import Window as W

    s = samples(spark, sf_dir)
    walk = F.sum(F.col("value") - 20).over(W.partitionBy("session", "channel").orderBy("i"))
    return s.withColumn("w", walk).groupBy("i").agg(F.var_samp("w").alias("v"), F.count("w").alias("n")).where("n > 1").select("i", "n", *r6("v"))


def histogram_cutoff(spark, sf_dir):
    """Histogram of each channel's values in 40 bins up to 200: counts and the share beyond."""
    s = samples(spark, sf_dir).withColumn("bin", F.width_bucket("value", F.lit(0.0), F.lit(200.0), F.lit(40)))
    return s.groupBy("channel", F.col("bin").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        role_classification, impedance_kinds, impedance_geometry, differential_pairs, propose_conditions, found_phrases, confidence_bands,
        epoch_bounds, epoch_matrix, decay_fit, nonstationarity, blocked_folds, vector_formulas, hjorth, pearson_by_condition,
        pearson_by_condition,
        effective_samples, marginal_means, random_walk_variance, histogram_cutoff,
    )
}

_SWEEP = "with s as (select p_partkey % 50 as lead, p_partkey as contact, p_size::double as kohm from part), k as (select *, case when kohm >= 5.0 * min(kohm) over (partition by lead) then 'segment' else 'ring' end as kind from s)\n"
_RANKED = sorted(set(PHRASES), key=lambda p: (-len(p), p))
_HELD = {p: f"contains(lower(text), '{p}')" for p in _RANKED}
_PHRASE_SQL = ", ".join(
    f"case when {_HELD[p]}" + "".join(f" and not {_HELD[q]}" for q in _RANKED[:i] if p in q) + f" then '{p}' end" for i, p in enumerate(_RANKED)
)
ORACLES = {
    "role_classification": "select source, count(*) as n, case when source like '%9' then 'ignore' when source like 'src1%' and regexp_matches(source, '[02468]$') then 'ambiguous' when source like 'src1%' then 'first' when regexp_matches(source, '[02468]$') then 'even' else 'unmapped' end as role from documents group by 1",
    "impedance_kinds": _SWEEP + "select lead, contact, kind from k",
    "impedance_geometry": _SWEEP + """, n as (select *, case when kind = 'ring' or coalesce(lag(kind) over (partition by lead order by contact) = 'ring', true) then 1 else 0 end as new from k),
      r as (select *, sum(new) over (partition by lead order by contact) as run from n), g as (select lead, run, kind, count(*) as n from r group by 1, 2, 3)
      select lead, string_agg(case when kind = 'ring' then '1' when n % 3 = 0 then rtrim(repeat('3,', (n // 3)::int), ',') else n::varchar end, ',' order by run) as geometry from g group by 1""",
    "differential_pairs": _SWEEP + """, p as (select *, (row_number() over (partition by lead order by contact) - 1) // 2 as pair from s)
      select lead, min(contact) as a, max(contact) as b, max(kohm) as kohm, case when max(kohm) >= 100 then 'open' when max(kohm) >= 25 then 'high' else 'good' end as quality
      from p group by lead, pair having count(*) = 2""",
    "propose_conditions": "select distinct p_name as label, case when contains(p_name, 'small ring') then 'b' when contains(p_name, 'ring') then 'a' when contains(p_name, 're') then 'd' when contains(p_name, 'l') then 'c' end as condition from part",
    "found_phrases": f"select doc_id, array_to_string(list_filter([{_PHRASE_SQL}], lambda p: p is not null), '|') as phrases from documents",
    "confidence_bands": "select case when 1 - l_discount * 6 >= 0.9 then 'high' when 1 - l_discount * 6 >= 0.6 then 'medium' else 'low' end as band, count(*) as n from lineitem group by 1",
    "epoch_bounds": "with w as (select o_orderkey, (o_orderkey % 23)::double as t1 from orders) select o_orderkey, i * 2.0::double as a, i * 2.0::double + 4 as b from w, range(0, 20) r(i) where t1 >= 4 and i * 2 + 4 <= t1 union all select o_orderkey, 0.0::double, t1 from w where t1 < 4",
    "epoch_matrix": f"with {SAMPLES_SQL}, m as (select t.session, t.channel, t.i as trigger, avg(x.value) as m, count(*) as n from samples t join samples x on x.session = t.session and x.channel = t.channel and x.i between t.i - 2 and t.i + 1 where t.value > 30 group by 1, 2, 3) select session, channel, trigger, round(m, 6) + 0.0 as mean from m where n = 4",
    "decay_fit": f"with {SAMPLES_SQL}, f as (select session, channel, regr_slope(ln(value), i) as slope, regr_r2(ln(value), i) as r2 from samples where value > 0 group by 1, 2) select session, channel, round(case when slope < 0 and r2 >= 0.05 then -1 / slope end, 6) + 0.0 as tau, round(r2, 6) + 0.0 as r2 from f",
    "nonstationarity": f"with {SAMPLES_SQL}, s as (select session, avg(value) over w as a, count(value) over w as n from samples window w as (partition by session order by onset rows between 9 preceding and current row)), e as (select session, max(a) filter (where n = 10) - min(a) filter (where n = 10) as excursion from s group by 1), c as (select session, max(m) - min(m) as effect from (select session, channel, avg(value) as m from samples group by 1, 2) group by 1) select session, round(excursion, 6) + 0.0 as excursion, round(effect, 6) + 0.0 as effect, round(excursion / nullif(effect, 0), 5) + 0.0 as ratio from e join c using (session)",
    "blocked_folds": f"with {SAMPLES_SQL}, f as (select session, onset, ntile(5) over (partition by session order by onset) - 1 as fold from samples) select session, fold, count(*) as n, round(min(onset), 6) + 0.0 as m from f group by 1, 2",
    "vector_formulas": f"with {EPOCHS_SQL}, d as (select *, abs(value - lag(value) over (partition by trial order by t)) as d from long_epochs) select trial, round(sqrt(sum(value * value)), 6) + 0.0 as norm, round(sum(value * value) / count(*), 6) + 0.0 as power, round(sum(d), 6) + 0.0 as line, round(max(abs(value)) / sqrt(sum(value * value)), 6) + 0.0 as crest from d group by 1",
    "hjorth": f"with {EPOCHS_SQL}, d as (select trial, t, value, value - lag(value) over (partition by trial order by t) as d from long_epochs), e as (select *, d - lag(d) over (partition by trial order by t) as dd from d), v as (select trial, var_pop(value) as v0, var_pop(d) as v1, var_pop(dd) as v2 from e group by 1) select trial, round(v0, 6) + 0.0 as activity, round(sqrt(v1 / v0), 6) + 0.0 as mobility, round(sqrt(v2 / v1) / sqrt(v1 / v0), 6) + 0.0 as complexity from v",
    "pearson_by_condition": f"with {EPOCHS_SQL} select x.condition, x.t as k, round(corr(x.value, y.value), 6) + 0.0 as r, round(sqrt(avg((x.value - y.value) * (x.value - y.value))), 6) + 0.0 as rmse from long_epochs x join long_epochs y on x.trial = y.trial and y.t = x.t + 1 group by 1, 2",
    "effective_samples": f"with {SAMPLES_SQL}, l as (select channel, value, lag(value) over (partition by session, channel order by i) as last from samples), c as (select channel, count(value) as n, corr(value, last) as r from l group by 1) select channel, n, round(r, 6) + 0.0 as r, round(n * (1 - r) / (1 + r), 6) + 0.0 as n_eff from c",
    "marginal_means": f"with {EPOCHS_SQL}, q as (select condition, (t // 16)::bigint as quarter, value from long_epochs) select coalesce(condition, -1) as condition, coalesce(quarter, -1) as quarter, round(avg(value), 6) + 0.0 as m from q group by cube (condition, quarter)",
    "random_walk_variance": f"with {SAMPLES_SQL}, w as (select i, sum(value - 20) over (partition by session, channel order by i) as w from samples) select i, count(w) as n, round(var_samp(w), 6) + 0.0 as v from w group by 1 having count(w) > 1",
    "histogram_cutoff": f"with {SAMPLES_SQL} select channel, case when value < 0 then 0 when value >= 200 then 41 else floor(value / 5)::bigint + 1 end as bin, count(*) as n from samples group by 1, 2",
}
