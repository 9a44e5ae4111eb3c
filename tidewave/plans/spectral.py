"""Queries over epochs' spectra."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.operators import spectral as S
from tidewave.plans.tables import EPOCHS_SQL, epochs

N, FS = 64, 128.0


def r6(*names):
    return [(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names]


def _spectra(spark, sf_dir):
    return S.spectrum(epochs(spark, sf_dir), FS)


def psd_by_condition(spark, sf_dir):
    out = S.add_z(S.mean_spectrum(epochs(spark, sf_dir), FS))
    return out.where("k > 0").select("condition", "k", "freq", *r6("mean_db", "sd_db", "z"), "n")


def psd_welch(spark, sf_dir):
    """Half-overlapped segments of 32 samples between 4 and 40 Hz: the spread is that over segments."""
    out = S.add_z(S.mean_spectrum(epochs(spark, sf_dir), FS, 32, 0.5, 4.0, 40.0))
    return out.select("condition", "k", "freq", *r6("mean_db", "sd_db", "z"), "n")


def band_power(spark, sf_dir):
    out = S.band_power(_spectra(spark, sf_dir))
    return out.select("trial", "condition", "band", (F.round(F.log10(F.greatest("power", F.lit(1e-300))), 5) + 0.0).alias("log_power"))


def bandpower_contrast(spark, sf_dir):
    from tidewave.operators.stats import pairwise_contrasts

    power = S.band_power(_spectra(spark, sf_dir)).where("power is not null")
    db = power.withColumn("value", 10 * F.log10("power"))
    return pairwise_contrasts(db, ["band"]).select("band", "a", "b", "n_a", "n_b", *r6("effect"))


def unresolvable_bands(spark, sf_dir):
    rows = epochs(spark, sf_dir).groupBy(F.size("x").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("trials"))
    bands = S.bands_frame(rows, (*S.BANDS, ("narrow", 5.1, 5.3), ("beyond", 70.0, 90.0)))
    first = F.ceil(F.col("lo") * F.col("n") / FS) * FS / F.col("n")
    empty = (first >= F.col("hi")) | (first > FS / 2)
    return rows.join(bands, empty).select("n", "trials", "band")


def spectral_peak(spark, sf_dir):
    return S.spectral_peak(S.spectrum_by_condition(_spectra(spark, sf_dir)), 4.0, 40.0).select("condition", "peak_freq", *r6("peak_db"))


def line_noise(spark, sf_dir):
    out = S.line_noise(_spectra(spark, sf_dir), 20.0, 8.0)
    return out.select("trial", "harmonic", (F.round(F.log10("ratio"), 5) + 0.0).alias("log_ratio"))


def energy_fraction_below(spark, sf_dir):
    return S.energy_fraction_below(_spectra(spark, sf_dir), 20.0).select("trial", *r6("fraction"))


def phase_locking(spark, sf_dir):
    """Locking of every bin; those at 0 and Nyquist are real, so their phase is 0 or pi."""
    x = _spectra(spark, sf_dir).withColumn("im", F.when(F.col("k").isin(0, N // 2), 0.0).otherwise(F.col("im")))
    return S.phase_locking(S.phases(x), ["condition", "k"]).select("condition", "k", "n", *r6("plv", "ppc", "mean_phase"))


def weighted_phase_lag(spark, sf_dir):
    """Cross spectra of all neighbouring bins; k is the lower one's."""
    bins = W.partitionBy("trial", "condition").orderBy("k")
    x = _spectra(spark, sf_dir).select("condition", "k", "re", "im", *[F.lead(c).over(bins).alias(f"{c}_up") for c in ("re", "im")])
    cross = x.where(F.col("k") < N // 2).select("condition", "k", (F.col("im") * F.col("re_up") - F.col("re") * F.col("im_up")).alias("im"))
    return S.weighted_phase_lag(cross, ["condition", "k"]).select("condition", "k", *r6("wpli"))


def aperiodic_fit(spark, sf_dir):
    out = S.aperiodic_fit(S.spectrum_by_condition(_spectra(spark, sf_dir)).where("k between 1 and 31"))
    return out.select("condition", *r6("offset", "exponent"))


def averaging_bias(spark, sf_dir):
    return S.averaging_bias(_spectra(spark, sf_dir)).where("k > 0").select("condition", "k", *r6("log_of_mean", "mean_of_log"))


def alias_frequency(spark, sf_dir):
    rows = epochs(spark, sf_dir).select("trial")
    f = (F.col("trial") * 0.37).alias("f")
    return rows.select("trial", f).select("trial", (F.round(S.alias_frequency(F.col("f"), FS), 6) + 0.0).alias("folded"))


_SPECTRA = f"""with {EPOCHS_SQL}, hann as (
  select trial, condition, t, (value - avg(value) over (partition by trial)) * (0.5 - 0.5 * cos(2 * pi() * t / 64)) as v
  from long_epochs
), parts as (
  select trial, condition, k::bigint as k, sum(v * cos(2 * pi() * k * t / 64)) as re, -sum(v * sin(2 * pi() * k * t / 64)) as im
  from hann, range(0, 33) r(k) group by 1, 2, 3
), spectra as (
  select trial, condition, k, k * 2.0::double as freq, re, im,
    (re * re + im * im) * (case when k in (0, 32) then 1 else 2 end) / (128 * 24.0) as power
  from parts
), db as (
  select *, 10 * log10(greatest(power, 2.2250738585072014e-308)) as db from spectra
), by_condition as (
  select condition, k, freq, avg(db) as mean_db, coalesce(stddev_samp(db), 0) as sd_db, count(*) as n from db group by 1, 2, 3
), bands as (
  select * from (values ('delta', 1.0, 4.0), ('theta', 4.0, 8.0), ('alpha', 8.0, 13.0), ('beta', 13.0, 30.0), ('gamma', 30.0, 60.0)) b(band, lo, hi)
), band_powers as (
  select trial, condition, band, avg(power) filter (where freq >= lo and freq < hi) as power from spectra, bands group by 1, 2, 3
)
"""

QUERIES = {
    f.__name__: f
    for f in (
        psd_by_condition, psd_welch, band_power, bandpower_contrast, unresolvable_bands, spectral_peak, line_noise,
        energy_fraction_below, phase_locking, weighted_phase_lag, aperiodic_fit, averaging_bias, alias_frequency,
    )
}
ORACLES = {
    "psd_by_condition": _SPECTRA + """select condition, k, freq, round(mean_db, 6) + 0.0 as mean_db, round(sd_db, 6) + 0.0 as sd_db, n,
      round((mean_db - avg(mean_db) over w) / nullif(sqrt(sum((n - 1) * sd_db * sd_db) over w / nullif(sum(n - 1) over w, 0)), 0), 6) + 0.0 as z
      from by_condition where k > 0 window w as (partition by k)""",
    "psd_welch": f"""with {EPOCHS_SQL}, cut as (
        select trial, condition, s, t - 16 * s as t, value - avg(value) over (partition by trial, s) as v
        from long_epochs, range(0, 3) r(s) where t >= 16 * s and t < 16 * s + 32
      ), parts as (
        select trial, condition, s, k::bigint as k, sum(v * (0.5 - 0.5 * cos(2 * pi() * t / 32)) * cos(2 * pi() * k * t / 32)) as re,
          sum(v * (0.5 - 0.5 * cos(2 * pi() * t / 32)) * sin(2 * pi() * k * t / 32)) as im from cut, range(1, 11) q(k) group by 1, 2, 3, 4
      ), by_condition as (
        select condition, k, avg(10 * log10((re * re + im * im) * 2 / (128 * 12.0))) as m, stddev_samp(10 * log10((re * re + im * im) * 2 / (128 * 12.0))) as sd,
          count(*) as n from parts group by 1, 2
      ) select condition, k, k * 4.0::double as freq, round(m, 6) + 0.0 as mean_db, round(sd, 6) + 0.0 as sd_db, n,
        round((m - avg(m) over w) / sqrt(sum((n - 1) * sd * sd) over w / sum(n - 1) over w), 6) + 0.0 as z from by_condition window w as (partition by k)""",
    "band_power": _SPECTRA + "select trial, condition, band, round(log10(greatest(power, 1e-300)), 5) + 0.0 as log_power from band_powers",
    "bandpower_contrast": _SPECTRA + """, means as (
        select band, condition, count(*) as n, avg(10 * log10(power)) as m from band_powers where power is not null group by 1, 2)
      select x.band, x.condition as a, y.condition as b, x.n as n_a, y.n as n_b, round(y.m - x.m, 6) + 0.0 as effect
      from means x join means y on x.band = y.band and x.condition < y.condition""",
    "unresolvable_bands": f"""with {EPOCHS_SQL}, rows_ as (select len(x)::bigint as n, count(*) as trials from epochs group by 1),
      bands as (select * from (values ('delta', 1.0, 4.0), ('theta', 4.0, 8.0), ('alpha', 8.0, 13.0), ('beta', 13.0, 30.0),
        ('gamma', 30.0, 60.0), ('narrow', 5.1, 5.3), ('beyond', 70.0, 90.0)) b(band, lo, hi))
      select n, trials, band from rows_, bands where not exists (
        select 1 from range(0, 33) r(k) where k * 128.0 / n >= lo and k * 128.0 / n < hi)""",
    "spectral_peak": _SPECTRA + """select condition, freq as peak_freq, round(mean_db, 6) + 0.0 as peak_db from (
      select *, row_number() over (partition by condition order by mean_db desc, freq) as r from by_condition where freq between 4 and 40) where r = 1""",
    "line_noise": _SPECTRA + """select trial, h::bigint as harmonic, round(log10(peak / near), 5) + 0.0 as log_ratio from (
      select trial, h, max(power) filter (where abs(freq - 20 * h) <= 1) as peak,
        avg(power) filter (where abs(freq - 20 * h) <= 8 and abs(freq - 20 * h) > 1) as near
      from spectra, range(1, 4) r(h) group by 1, 2) where peak is not null and near > 0""",
    "energy_fraction_below": _SPECTRA + "select trial, round(coalesce(sum(power) filter (where freq < 20), 0) / sum(power), 6) + 0.0 as fraction from spectra group by 1",
    "phase_locking": _SPECTRA + """, q as (select condition, k, atan2(case when k in (0, 32) then 0 else im end, re) as a from spectra),
      p as (select condition, k, count(*) as n, sum(cos(a)) as c, sum(sin(a)) as s from q group by 1, 2)
      select condition, k, n, round(sqrt(c * c + s * s) / n, 6) + 0.0 as plv, round((c * c + s * s - n) / nullif(n * (n - 1), 0), 6) + 0.0 as ppc,
        round(atan2(s, c), 6) + 0.0 as mean_phase from p""",
    "weighted_phase_lag": _SPECTRA + """select condition, k, round(abs(avg(im)) / nullif(avg(abs(im)), 0), 6) + 0.0 as wpli from (
      select x.condition, x.k, x.im * y.re - x.re * y.im as im from spectra x join spectra y on x.trial = y.trial and y.k = x.k + 1) group by 1, 2""",
    "aperiodic_fit": _SPECTRA + """select condition, round(regr_intercept(mean_db / 10, log10(freq)), 6) + 0.0 as offset,
      round(-regr_slope(mean_db / 10, log10(freq)), 6) + 0.0 as exponent from by_condition where k between 1 and 31 group by 1""",
    "averaging_bias": _SPECTRA + "select condition, k, round(10 * log10(avg(power)), 6) + 0.0 as log_of_mean, round(avg(db), 6) + 0.0 as mean_of_log from db where k > 0 group by 1, 2",
    "alias_frequency": "select vec_id::bigint as trial, round(abs(f - round_even(f / 128, 0) * 128), 6) + 0.0 as folded from (select vec_id, vec_id * 0.37::double as f from embeddings)",
}
