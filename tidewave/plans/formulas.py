"""Queries of formulas: rates, fields and sizes are columns of parts, customers and order lines."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from tidewave.operators import formulas as M
from tidewave.plans.spectral import r6
from tidewave.plans.tables import EPOCHS_SQL, epochs, table


def _rates(spark, sf_dir):
    """A part as a recorder: its rate (in eighths of a hertz), the target, a band's upper edge."""
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", (F.floor(F.col("p_retailprice") * 8) / 8 + F.col("p_size") * 100).alias("rate"), (F.col("p_size") * 20.0 + 1).alias("target"), (F.col("p_size") * 7.0).alias("top")
    )


def decimation_plan(spark, sf_dir):
    """Factor, new rate, usable bandwidth, and whether the requested band is refused."""
    factor = M.decimation_factor(F.col("rate"), F.col("target"))
    done = _rates(spark, sf_dir).withColumn("factor", factor).withColumn("new_rate", F.col("rate") / F.col("factor"))
    usable = M.usable_bandwidth(F.col("new_rate"))
    return done.select("p_partkey", "factor", *r6("new_rate"), (F.round(usable, 6) + 0.0).alias("usable"), (F.col("top") > usable).alias("refused"))


def decimation_stages(spark, sf_dir):
    """Whole numbers up to the part's key as factors, split into stages."""
    p = table(spark, sf_dir, "part").select("p_partkey", M.decimation_stages(F.col("p_partkey")).alias("s"))
    product = F.aggregate("s", F.lit(1).cast("long"), lambda a, x: a * x)
    return p.select("p_partkey", F.size("s").cast("long").alias("n_stages"), product.alias("product"), F.array_max("s").alias("largest"))


def exact_ratio(spark, sf_dir):
    """Up and down from each part's rate to 1 kHz, however large, and the rate as a fraction."""
    up, down = M.resample_ratio(F.col("rate"), F.lit(1000.0), most=None)
    n, d = M.exact_fraction(F.col("rate"))
    return _rates(spark, sf_dir).select("p_partkey", up.alias("up"), down.alias("down"), F.concat(n.cast("string"), F.lit("/"), d.cast("string")).alias("rate"))


def harmonic_folds(spark, sf_dir):
    each = _rates(spark, sf_dir).select("p_partkey", F.posexplode(M.harmonics(F.lit(130.0), F.col("rate"), 6)).alias("k", "f"))
    return each.select("p_partkey", (F.col("k") + 1).cast("long").alias("harmonic"), (F.round("f", 6) + 0.0).alias("folded"))


def wavelet_resolutions(spark, sf_dir):
    time, frequency = M.wavelet_resolution(F.col("p_size") * 1.0, F.col("p_partkey") % 7 + 1.0)
    return table(spark, sf_dir, "part").select("p_partkey", time.alias("t"), frequency.alias("f")).select("p_partkey", *r6("t", "f"))


def spatial_formulas(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size, price = F.col("p_size") * 1.0, F.col("p_retailprice")
    share, volume = M.implant_coverage(F.col("p_size"), F.lit(8), 3.0, 3.5)
    weights = [size / 50, F.lit(0.3), price / 2000]
    out = p.select(
        "p_partkey", M.dipole_potential(price, size, F.cos(size)).alias("dipole"), M.reach(price, size, F.lit(2.0), 5.0).alias("reach"), M.contact_area(F.lit(1.5), F.lit(1.27), F.col("p_size") % 3 + 1).alias("area"),
        M.field_around(size * 7, size / 10 + 1, weights).alias("field"), M.spatial_alias(size / 10, F.lit(4.0)).alias("spatial"), share.alias("share"), volume.alias("volume"),
        M.sites_within(price, F.lit(20.0), 2).alias("sites"), M.data_rate(F.col("p_size"), price).alias("mb_s"), M.loop_latency(size, F.lit(5.0), size + 4, F.lit(50.0), F.lit(10.0)).alias("latency"),
    )
    return out.select("p_partkey", *r6("dipole", "reach", "area", "field", "spatial", "share", "volume"), "sites", (F.round("mb_s", 10) + 0.0).alias("mb_s"), *r6("latency"))


def disc_potentials(spark, sf_dir):
    c = M.disc_mean_potential(F.lit(1e-9), F.col("p_size") / 10, F.lit(2.3), 1.0)
    return table(spark, sf_dir, "part").select("p_partkey", (F.round(c * 1e9, 6) + 0.0).alias("potential"))


def flip_probabilities(spark, sf_dir):
    p = M.flip_probability(F.col("l_quantity") / 10 - 2, F.col("l_tax") * 10)
    return table(spark, sf_dir, "lineitem").groupBy("l_quantity", "l_tax").agg(F.count(F.lit(1)).alias("n")).select("l_quantity", "l_tax", "n", (F.round(p, 9) + 0.0).alias("p"))


def averaged_db_bias(spark, sf_dir):
    """Bias of decibels by the number of averaged segments: as many as an order has lines."""
    k = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"))
    return k.select("l_orderkey", (F.round(M.averaged_db_bias(F.col("k")), 6) + 0.0).alias("bias_db"))


def sessions_for_power(spark, sf_dir):
    """Sessions needed to see the difference between the first and the second half of an epoch, by condition."""
    half = F.size("x") / 2
    d = F.aggregate(F.transform("x", lambda v, i: F.when(i < half, v).otherwise(-v)), F.lit(0.0), lambda s, v: s + v)
    out = epochs(spark, sf_dir).select("condition", d.alias("d")).groupBy("condition").agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    return out.select("condition", (F.round(M.sessions_for_power(F.col("m"), F.col("s")), 3) + 0.0).alias("sessions"))


def correlation_rejection(spark, sf_dir):
    """Halves of an epoch correlated: mean |r|, and how often that is called significant at 5 %."""
    half = 32
    pairs = epochs(spark, sf_dir).select("trial", "condition", F.posexplode(F.arrays_zip(F.slice("x", 1, half).alias("a"), F.slice("x", half + 1, half).alias("b"))).alias("i", "z"))
    r = pairs.groupBy("trial", "condition").agg(F.corr("z.a", "z.b").alias("r"))
    t = F.col("r") * F.sqrt((half - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-12)))
    judged = r.withColumn("p", M.student_two_sided(t, half - 2))
    return judged.groupBy("condition").agg(F.avg(F.abs("r")).alias("mean_r"), F.avg((F.abs("r") > 0.5).cast("double")).alias("large"), F.avg((F.col("p") < 0.05).cast("double")).alias("rejected")).select(
        "condition", *r6("mean_r", "large", "rejected")
    )


def peaked_spectra(spark, sf_dir):
    """Power at a part's size in hertz of a falling spectrum with a peak at 20 Hz."""
    peaks = F.array(F.struct(F.lit(20.0).alias("centre"), F.lit(0.5).alias("height"), F.lit(2.0).alias("width")))
    f = M.peaked_spectrum(F.col("p_size") * 1.0, F.lit(1.0), F.lit(1.5), peaks)
    return table(spark, sf_dir, "part").select("p_partkey", (F.round(f, 6) + 0.0).alias("power"))


QUERIES = {
    f.__name__: f
    for f in (
        decimation_plan, decimation_stages, exact_ratio, harmonic_folds, wavelet_resolutions, spatial_formulas, disc_potentials, flip_probabilities,
        averaged_db_bias, sessions_for_power, correlation_rejection, peaked_spectra,
    )
}

_RATES = "with r as (select p_partkey, floor(p_retailprice * 8) / 8 + p_size * 100 as rate, p_size * 20.0::double + 1 as target, p_size * 7.0::double as top from part) "
_Z = NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)
_FIELD = " + ".join(
    f"{w} / (4 * pi() * {M.SIGMA} * greatest(sqrt(pow((s / 10 + 1) * cos(radians(s * 7)) - {M.LEAD_RADIUS_MM * math.cos(2 * math.pi * i / 3)}, 2) + pow((s / 10 + 1) * sin(radians(s * 7)) - {M.LEAD_RADIUS_MM * math.sin(2 * math.pi * i / 3)}, 2)), 1e-4) * 1e-3)"
    for i, w in enumerate(("s / 50", "0.3", "p / 2000"))
)
ORACLES = {
    "decimation_plan": _RATES + """, f as (select *, (case when target > 0 and target < rate then greatest(floor(rate / target), 1) else 1 end)::bigint as factor from r)
      select p_partkey, factor, round(rate / factor, 6) + 0.0 as new_rate, round(rate / factor / 2 * 0.8, 6) + 0.0 as usable, top > rate / factor / 2 * 0.8 as refused from f""",
    "decimation_stages": """with recursive s as (
        select p_partkey, 13 as d, p_partkey::bigint as rest, 0 as n, 0::bigint as largest, 1::bigint as product from part
        union all
        select p_partkey, case when rest % d = 0 then d else d - 1 end, case when rest % d = 0 then rest // d else rest end, case when rest % d = 0 then n + 1 else n end,
          case when rest % d = 0 then greatest(largest, d) else largest end, case when rest % d = 0 then product * d else product end from s where rest > 13 and d > 1
      ), last_ as (select * from s where rest <= 13 or d = 1)
      select p_partkey, (n + case when rest > 1 or n = 0 then 1 else 0 end)::bigint as n_stages, product * rest as product, case when rest > 1 or n = 0 then greatest(largest, rest) else largest end as largest from last_""",
    "correlation_rejection": f"""with {EPOCHS_SQL}, r as (select a.trial, a.condition, corr(a.value, b.value) as r from long_epochs a join long_epochs b on a.trial = b.trial and b.t = a.t + 32 where a.t < 32 group by 1, 2)
      select condition, round(avg(abs(r)), 6) + 0.0 as mean_r, round(avg((abs(r) > 0.5)::int), 6) + 0.0 as large, round(avg((abs(r) * sqrt(30 / greatest(1 - r * r, 1e-12)) > 2.0422724563012382)::int), 6) + 0.0 as rejected from r group by 1""",
    "exact_ratio": _RATES + """, n as (select p_partkey, rate, (rate * 8)::bigint as e from r), g as (select *, gcd(e, 8) as g8, gcd(e, 8000) as g from n)
      select p_partkey, (8000 // g)::bigint as up, (e // g)::bigint as down, (e // g8)::varchar || '/' || (8 // g8)::varchar as rate from g""",
    "harmonic_folds": _RATES + "select p_partkey, k::bigint as harmonic, round(abs(k * 130.0::double - round_even(k * 130.0::double / rate, 0) * rate), 6) + 0.0 as folded from r, range(1, 7) q(k)",
    "wavelet_resolutions": """with t as (select p_partkey, (p_partkey % 7 + 1) / (2 * pi() * p_size) as t from part) select p_partkey, round(t, 6) + 0.0 as t, round(1 / (2 * pi() * t), 6) + 0.0 as f from t""",
    "spatial_formulas": f"""with v as (select p_partkey, p_size::double as s, p_retailprice as p from part), u as (select *, 3.0::double * 3.0 * pi() * s * (7 * 3.5 + 6.0) / 1000 as volume from v)
      select p_partkey, round(p * cos(s) / (4 * pi() * {M.SIGMA} * s * s), 6) + 0.0 as dipole, round(s * sqrt(p / 5.0), 6) + 0.0 as reach, round(pi() * 1.27 * 1.5 / (s::int % 3 + 1), 6) + 0.0 as area,
        round({_FIELD}, 6) + 0.0 as field, round(least((s / 10) % 0.25::double, 0.25 - (s / 10) % 0.25::double), 6) + 0.0 as spatial, round(volume / {M.BRAIN_CM3}, 6) + 0.0 as share, round(volume, 6) + 0.0 as volume,
        ((2 * floor(p / 20) + 1) * 2)::bigint as sites, round(s * p * 10 / 8e6, 10) + 0.0 as mb_s, round(s + 5000 / (2 * pi() * (s + 4)) + 60, 6) + 0.0 as latency from u""",
    "averaged_db_bias": f"""with k as (select l_orderkey, count(*) as k from lineitem group by 1)
      select l_orderkey, round(10 / ln(10) * (coalesce(list_sum(list_transform(range(1, k), lambda i: 1.0::double / i)), 0) - {M.EULER} - ln(k)), 6) + 0.0 as bias_db from k""",
    "sessions_for_power": f"""with {EPOCHS_SQL}, d as (select condition, trial, sum(case when t < 32 then value else -value end) as d from long_epochs group by 1, 2)
      select condition, round(pow({_Z} * stddev_samp(d) / abs(avg(d)), 2), 3) + 0.0 as sessions from d group by 1""",
    "peaked_spectra": "select p_partkey, round(10 / pow(p_size, 1.5) + 0.5 * exp(-pow(p_size - 20.0, 2) / 8), 6) + 0.0 as power from part",
}
