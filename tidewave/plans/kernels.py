"""Queries of the numpy kernels over epochs; what SQL can't say, tests hold against planted signals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.functions import kernels as N
from tidewave.operators import kernels as K
from tidewave.operators import stats as T
from tidewave.operators.spectral import spectrum
from tidewave.plans.spectral import FS, r6
from tidewave.plans.tables import EPOCHS_SQL, epochs


#: The reference's grid: 40 frequencies in equal ratios from 2 Hz, here to 0.95 of Nyquist, and every fourth sample.
TFR_FREQS, TFR_STEP = [float(f) for f in np.geomspace(2.0, 0.95 * FS / 2, 40)], 4


def tfr_morlet(spark, sf_dir):
    maps = K.time_frequency(epochs(spark, sf_dir), FS, TFR_FREQS, 4.0, TFR_STEP)
    return K.baseline_log_ratio(maps, 0.0, 0.1).select("condition", "freq", "t", *r6("value"))


def tfr_peak(spark, sf_dir):
    """The cell of each condition's map that stands out most; of equals the lowest frequency, then the earliest."""
    maps = K.baseline_log_ratio(K.time_frequency(epochs(spark, sf_dir), FS, TFR_FREQS, 4.0, TFR_STEP), 0.0, 0.1)
    best = F.max_by(F.struct("freq", "t", "value"), F.struct("value", -F.col("freq"), -F.col("t")))
    return maps.groupBy("condition").agg(best.alias("b")).select("condition", "b.freq", "b.t", (F.round("b.value", 6)).alias("value"))


def multitaper_psd(spark, sf_dir):
    out = K.multitaper(epochs(spark, sf_dir), FS).groupBy("condition", F.col("k").cast("long").alias("k")).agg(F.avg("power").alias("power"))
    return out.select("condition", "k", (F.round(F.log10(F.greatest("power", F.lit(1e-300))), 6)).alias("log_power"))


def envelope_by_condition(spark, sf_dir):
    e = K.envelope(epochs(spark, sf_dir), FS, 8.0, 13.0).select("condition", F.posexplode("envelope").alias("t", "v"))
    return e.groupBy("condition", F.col("t").cast("long").alias("t")).agg(F.avg("v").alias("v")).select("condition", "t", *r6("v"))


def pac_tort(spark, sf_dir):
    out = K.comodulation(epochs(spark, sf_dir), FS, [(4.0, 8.0), (8.0, 12.0)], [(20.0, 30.0), (30.0, 50.0)])
    return out.groupBy("condition", "slow", "fast").agg(F.avg("mi").alias("mi"), F.count("mi").alias("n")).select("condition", "slow", "fast", *r6("mi"), "n")


def ringing_measures(spark, sf_dir):
    out = K.ringing(epochs(spark, sf_dir), FS, 10.0, 50.0)
    return out.select("trial", "condition", "n_extrema", *r6("amplitude", "freq", "tau", "r2"))


def ringing_summary(spark, sf_dir):
    out = K.ringing_summary(K.ringing(epochs(spark, sf_dir), FS, 10.0, 50.0), ["condition"])
    return out.select("condition", "n", "responding", *r6("median_freq", "median_amplitude", "median_tau", "median_peak_freq"))


def resample_polyphase(spark, sf_dir):
    out = K.resampled(epochs(spark, sf_dir), 1, 2)
    return out.select("trial", F.posexplode("x").alias("t", "v")).select("trial", F.col("t").cast("long").alias("t"), *r6("v"))


def kalman_track(spark, sf_dir):
    return K.tracked(epochs(spark, sf_dir), 0.01, 0.1).select("trial", (F.round(F.element_at("x", -1), 6)).alias("last"))


def granger_halves(spark, sf_dir):
    return K.halves_granger(epochs(spark, sf_dir), 2).select("trial", *r6("forward", "backward"))


def pac_surrogate(spark, sf_dir):
    """How many conditions' trials couple beyond shifted surrogates."""
    out = K.surrogate_coupling(epochs(spark, sf_dir), FS, (4.0, 8.0), (20.0, 30.0))
    return out.groupBy("condition").agg(F.count("z").alias("n"), F.avg("z").alias("z"), F.avg((F.col("z") > 1.645).cast("double")).alias("beyond")).select("condition", "n", *r6("z", "beyond"))


def granger_conditional(spark, sf_dir):
    return K.thirds_granger(epochs(spark, sf_dir), 2).select("trial", *r6("plain", "given"))


#: A first-order low-pass.
_B, _A = [0.2, 0.0], [1.0, -0.8]


def iir_filters(spark, sf_dir):
    """The last sample of an epoch filtered once and both ways, and the delay of filtering once."""
    out = K.filtered(epochs(spark, sf_dir), _B, _A)
    return out.select("trial", (F.round(F.element_at("once", -1), 6) + 0.0).alias("once"), (F.round(F.element_at("both", -1), 6) + 0.0).alias("both"), "delay")


def band_split(spark, sf_dir):
    return K.band_split(epochs(spark, sf_dir), FS, 20.0).select("trial", *r6("low", "high"))


def leakage_floor(spark, sf_dir):
    return K.leakage(epochs(spark, sf_dir)).select("trial", *r6("plain", "hann"))


def gaussian_smooth(spark, sf_dir):
    each = K.smoothed(epochs(spark, sf_dir), 2.0).select("trial", F.posexplode("x").alias("t", "v"))
    return each.select("trial", F.col("t").cast("long").alias("t"), *r6("v"))


def fit_spectrum(spark, sf_dir):
    """Aperiodic part and peaks of each condition's mean spectrum."""
    mean = spectrum(epochs(spark, sf_dir), FS).groupBy("condition", "freq").agg(F.avg("power").alias("power"))
    out = K.spectral_peaks(mean, "condition", 2.0, 60.0)
    return out.select("condition", *r6("offset", "exponent"), F.size("peaks").cast("long").alias("n_peaks"), (F.round(F.try_element_at("peaks", F.lit(1))["centre"], 6)).alias("first"))


def _two_conditions(spark, sf_dir):
    """Trials of an even condition against those of an odd one."""
    return epochs(spark, sf_dir).select("trial", (F.col("condition") % 2).cast("int").alias("label"), "x")


def cluster_test(spark, sf_dir):
    return T.cluster_test(_two_conditions(spark, sf_dir)).select("sign", "first", "last", *r6("mass", "p"))


def shuffle_units(spark, sf_dir):
    return T.shuffle_units(_two_conditions(spark, sf_dir)).select("unit", *r6("effect", "p"))


def pair_flip(spark, sf_dir):
    """Neighbouring trials of a condition as pairs: the later's mean less the earlier's."""
    mean = epochs(spark, sf_dir).select("trial", "condition", (F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")).alias("m"))
    at = mean.withColumn("i", F.row_number().over(W.partitionBy("condition").orderBy("trial")) - 1)
    pairs = at.groupBy("condition", F.floor(F.col("i") / 2).alias("pair")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("i") % 2 == 1, F.col("m")).otherwise(-F.col("m"))).alias("d"))
    return T.pair_flip_test(pairs.where("n = 2"), ["condition"]).select("condition", "n", *r6("mean", "p"))


QUERIES = {
    f.__name__: f
    for f in (
        tfr_morlet, tfr_peak, multitaper_psd, envelope_by_condition, pac_tort, ringing_measures, ringing_summary, resample_polyphase, kalman_track, granger_halves,
        pac_surrogate, granger_conditional, iir_filters, band_split, leakage_floor, gaussian_smooth, fit_spectrum, cluster_test, shuffle_units, pair_flip,
    )
}
def _kalman_weights(n: int, q: float, r: float) -> list[float]:
    """What each sample weighs in the last mean: the gains don't depend on the data."""
    weights, p = np.eye(1, n)[0], r
    for i in range(n):
        p += q
        gain = p / (p + r)
        weights *= 1 - gain
        weights[i] += gain
        p *= 1 - gain
    return weights.tolist()


_TAPERS = N.slepian(64, 3.0, 5).tolist()
_HALF = N.kaiser_lowpass(0.45 / 2, 60.0, 0.1 / 2).tolist()
_TFR = f"""with {EPOCHS_SQL}, f as (select unnest({TFR_FREQS!r}) as freq), g as (select freq, 4.0 / (2 * pi() * freq) as sigma from f),
  part as (select trial, condition, freq, o.t, sum(value * exp(-tau * tau / (2 * sigma * sigma)) * cos(2 * pi() * freq * tau)) as re, sum(value * exp(-tau * tau / (2 * sigma * sigma)) * sin(2 * pi() * freq * tau)) as im
    from (select trial, condition, value, freq, sigma, o.t, (o.t - x.t) / {FS} as tau from long_epochs x, g, range(0, 64, {TFR_STEP}) o(t) where abs(o.t - x.t) <= ceil(5 * sigma * {FS})) o group by 1, 2, 3, 4),
  mean as (select condition, freq, t / {FS} as t, avg(re * re + im * im) as power from part group by 1, 2, 3),
  base as (select condition, freq, avg(power) as base from mean where t between 0 and 0.1 group by 1, 2),
  maps as (select condition, freq, t, log10(power / base) as value from mean join base using (condition, freq))
"""
_DFT = """d as (select trial, k, sum(value * cos(2 * pi() * k * t / 64)) as re, sum(value * sin(2 * pi() * k * t / 64)) as im,
    sum(value * (0.5 - 0.5 * cos(2 * pi() * t / 64)) * cos(2 * pi() * k * t / 64)) as hr, sum(value * (0.5 - 0.5 * cos(2 * pi() * t / 64)) * sin(2 * pi() * k * t / 64)) as hi from long_epochs, range(0, 33) r(k) group by 1, 2),
  m as (select trial, k, sqrt(re * re + im * im) as a, sqrt(hr * hr + hi * hi) as h from d), top as (select trial, arg_max(k, a) as ka, max(a) as ma, arg_max(k, h) as kh, max(h) as mh from m group by 1)"""
ORACLES = {
    "gaussian_smooth": f"""with {EPOCHS_SQL}, w as (select d, exp(-0.5 * (d / 2.0) * (d / 2.0)) as w from range(-8, 9) r(d)), z as (select sum(w) as z from w)
      select trial, t::bigint as t, round(sum(value * w / z), 6) + 0.0 as v from (select x.trial, x.t - w.d as t, value, w, z from long_epochs x, w, z) where t between 0 and 63 group by 1, 2""",
    "tfr_morlet": f"{_TFR} select condition, freq, t, round(value, 6) + 0.0 as value from maps",
    "tfr_peak": f"{_TFR}, r as (select *, row_number() over (partition by condition order by value desc, freq, t) as r from maps) select condition, freq, t, round(value, 6) + 0.0 as value from r where r = 1",
    "kalman_track": f"with {EPOCHS_SQL} select trial, round(list_inner_product(x, {_kalman_weights(64, 0.01, 0.1)!r}::double[]), 6) as last from epochs",
    "leakage_floor": f"""with {EPOCHS_SQL}, {_DFT} select trial, round(20 * log10(max(case when abs(k - ka) > 5 then a else 0 end) / any_value(ma)), 6) + 0.0 as plain,
      round(20 * log10(max(case when abs(k - kh) > 5 then h else 0 end) / any_value(mh)), 6) + 0.0 as hann from m join top using (trial) group by trial""",
    "iir_filters": f"""with {EPOCHS_SQL}, o as (select x.trial, t.t, sum(0.2 * pow(0.8, t.t - x.t) * value) as y from long_epochs x, range(0, 64) t(t) where x.t <= t.t group by 1, 2),
      c as (select trial, t, value - avg(value) over (partition by trial) as x, y - avg(y) over (partition by trial) as y from long_epochs join o using (trial, t)),
      l as (select a.trial, b.t - a.t as lag, sum(a.x * b.y) as c from c a join c b on a.trial = b.trial group by 1, 2), best as (select trial, arg_max(lag, c) as delay from l group by 1)
      select trial, round(y, 6) + 0.0 as once, round(0.2 * y, 6) + 0.0 as both, delay::bigint as delay from o join best using (trial) where t = 63""",
    "multitaper_psd": f"""with {EPOCHS_SQL}, tapers as (select unnest({_TAPERS!r}::double[][]) as w, generate_subscripts({_TAPERS!r}::double[][], 1) as j), w as (select j, unnest(w) as w, generate_subscripts(w, 1) - 1 as t from tapers),
      c as (select trial, condition, t, value - avg(value) over (partition by trial) as v from long_epochs),
      f as (select trial, condition, j, k, sum(v * w * cos(2 * pi() * k * t / 64)) as re, sum(v * w * sin(2 * pi() * k * t / 64)) as im from c join w using (t), range(0, 33) r(k) group by 1, 2, 3, 4),
      p as (select condition, trial, k, avg(re * re + im * im) / {FS} * case when k between 1 and 31 then 2 else 1 end as p from f group by 1, 2, 3)
      select condition, k::bigint as k, round(log10(greatest(avg(p), 1e-300)), 6) as log_power from p group by 1, 2""",
    "resample_polyphase": f"""with {EPOCHS_SQL}, ends as (select trial, x[1] as a, x[64] as b from epochs), h as (select unnest({_HALF!r}) as h, generate_subscripts({_HALF!r}, 1) - 1 as m)
      select e.trial, j as t, round(any_value(a + (b - a) * 2 * j / 63) + sum(h * (value - (a + (b - a) * x.t / 63))), 6) + 0.0 as v
      from ends e join long_epochs x using (trial), range(0, 32) r(j), h where m = 2 * j + {len(_HALF) // 2} - x.t group by 1, 2""",
}
