"""Spectra and what is read off them: density, bands, peaks, phases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.functions import arrays as A

#: Band edges in Hz, half-open.
BANDS = (("delta", 1.0, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0), ("gamma", 30.0, 60.0))


def bands_frame(df: DataFrame, bands=BANDS) -> DataFrame:
    return df.sparkSession.createDataFrame(list(bands), "band string, lo double, hi double")


_SPECTRUM = "trial long, condition long, segment long, k long, freq double, re double, im double, power double"


def spectrum(epochs: DataFrame, fs: float, n: int | None = None, overlap: float = 0.5, fmin: float = 0.0, fmax: float | None = None) -> DataFrame:
    """trial, condition, segment, k, freq, re, im, power: one-sided densities of Hann-windowed segments.

    Segments of n samples follow each other by (1 - overlap) * n (Welch's segments, each
    less its mean); without n an epoch is one segment of its own length, on its own grid
    of frequencies. Bins outside [fmin, fmax] are left out. Epochs that are null, shorter
    than n or hold a sample that isn't finite give one row of nulls.

    Epochs of one length are stacked and transformed together, a batch at a time.
    """
    if n is not None and (n < 2 or not 0 <= overlap < 1):
        raise ValueError("segments need two samples and an overlap below 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["x"]
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            trial, condition = (batch[c].to_numpy(zero_copy_only=False) for c in ("trial", "condition"))
            odd = np.ones(len(batch), bool)
            for length in np.unique(lengths[lengths >= (n or 2)]):
                at = np.flatnonzero(lengths == length)
                x = pc.list_flatten(lists.take(pa.array(at))).to_numpy(zero_copy_only=False).reshape(len(at), length)
                fine = np.isfinite(x).all(axis=1)
                at, x = at[fine], x[fine]
                odd[at] = False
                if len(at):
                    yield densities(trial[at], condition[at], x, int(n or length))
            if odd.any():
                none = pa.nulls(int(odd.sum()))
                columns = [pa.array(trial[odd]), pa.array(condition[odd]), none.cast(pa.int64()), none.cast(pa.int64()), *[none.cast(pa.float64())] * 4]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def densities(trial: np.ndarray, condition: np.ndarray, x: np.ndarray, width: int) -> pa.RecordBatch:
        window = np.array(A.hann(width))
        step = max(1, width - int(width * overlap)) if n else width
        parts = np.lib.stride_tricks.sliding_window_view(x, width, axis=1)[:, ::step]
        z = np.fft.rfft((parts - parts.mean(axis=-1, keepdims=True)) * window, axis=-1)
        k = np.arange(z.shape[-1])
        freq = k * (fs / width)
        power = np.abs(z) ** 2 * np.where((k == 0) | (2 * k == width), 1.0, 2.0) / (fs * (window**2).sum())
        keep = (freq >= fmin) & (freq <= (fmax if fmax is not None else np.inf))
        z, power, k, freq = z[..., keep], power[..., keep], k[keep], freq[keep]
        rows, segments, bins = z.shape
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(trial, segments * bins)), pa.array(np.repeat(condition, segments * bins)),
                pa.array(np.tile(np.repeat(np.arange(segments), bins), rows)), pa.array(np.tile(k, rows * segments)),
                pa.array(np.tile(freq, rows * segments)), pa.array(z.real.ravel()), pa.array(z.imag.ravel()), pa.array(power.ravel()),
            ],
            names=names,
        )

    names = [c.split()[0] for c in _SPECTRUM.split(", ")]
    return epochs.select("trial", "condition", "x").mapInArrow(run, _SPECTRUM)


def mean_spectrum(epochs: DataFrame, fs: float, n: int | None = None, overlap: float = 0.5, fmin: float = 0.0, fmax: float | None = None) -> DataFrame:
    """condition, k, freq, mean_db, sd_db (0 for one epoch), n: as spectrum_by_condition(spectrum(...)), from sums made in the tasks.

    A batch leaves one row per condition and bin; the spread comes from deviations about the
    batch's own means, which merge without cancelling.
    """
    names = ["condition", "k", "freq", "n", "mean", "m2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["x"]
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            condition = batch["condition"].to_numpy(zero_copy_only=False)
            for length in np.unique(lengths[lengths >= (n or 2)]):
                at = np.flatnonzero(lengths == length)
                x = pc.list_flatten(lists.take(pa.array(at))).to_numpy(zero_copy_only=False).reshape(len(at), length)
                fine = np.isfinite(x).all(axis=1)
                at, x, width = at[fine], x[fine], int(n or length)
                if not len(at):
                    continue
                window = np.array(A.hann(width))
                step = max(1, width - int(width * overlap)) if n else width
                parts = np.lib.stride_tricks.sliding_window_view(x, width, axis=1)[:, ::step]
                z = np.fft.rfft((parts - parts.mean(axis=-1, keepdims=True)) * window, axis=-1)
                k = np.arange(z.shape[-1])
                freq = k * (fs / width)
                power = np.abs(z) ** 2 * np.where((k == 0) | (2 * k == width), 1.0, 2.0) / (fs * (window**2).sum())
                keep = (freq >= fmin) & (freq <= (fmax if fmax is not None else np.inf))
                db, k, freq = 10 * np.log10(np.maximum(power[..., keep], A.TINY)), k[keep], freq[keep]
                for c in np.unique(condition[at]):
                    own = db[condition[at] == c].reshape(-1, len(k))
                    mean = own.mean(axis=0)
                    columns = [np.full(len(k), c), k, freq, np.full(len(k), len(own)), mean, ((own - mean) ** 2).sum(axis=0)]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=names)

    known = epochs.where("condition is not null").select("condition", "x")
    parts = known.mapInArrow(run, "condition long, k long, freq double, n long, mean double, m2 double")
    centre = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    # Decibels are small numbers: the difference of squares of batches' means keeps its digits.
    sums = parts.groupBy("condition", "k", "freq").agg(
        centre.alias("mean_db"), F.sum("n").alias("n"), F.sum("m2").alias("_m2"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_q")
    )
    between = F.greatest(F.col("_q") - F.col("n") * F.col("mean_db") * F.col("mean_db"), F.lit(0.0))
    sd = F.when(F.col("n") > 1, F.sqrt((F.col("_m2") + between) / (F.col("n") - 1))).otherwise(0.0)
    return sums.select("condition", "k", "freq", "mean_db", sd.alias("sd_db"), "n")


def spectrum_by_condition(spectra: DataFrame) -> DataFrame:
    """condition, k, freq, mean_db, sd_db (0 for one epoch), n."""
    db = spectra.withColumn("db", A.decibel(F.col("power")))
    return db.groupBy("condition", "k", "freq").agg(
        F.avg("db").alias("mean_db"), F.coalesce(F.stddev_samp("db"), F.lit(0.0)).alias("sd_db"), F.count(F.lit(1)).alias("n")
    )


def band_power(spectra: DataFrame, bands=BANDS) -> DataFrame:
    """trial, condition, band, power: the mean over a band's bins, null if it holds none."""
    inside = [
        F.avg(F.when((F.col("freq") >= lo) & (F.col("freq") < hi), F.col("power"))).alias(name) for name, lo, hi in bands
    ]
    wide = spectra.groupBy("trial", "condition").agg(*inside)
    return wide.unpivot(["trial", "condition"], [b[0] for b in bands], "band", "power")


def unresolvable_bands(bands: DataFrame, n: int, fs: float) -> DataFrame:
    """The bands that hold no bin of an n-sample window."""
    first = F.ceil(F.col("lo") * n / fs) * fs / n
    return bands.where((first >= F.col("hi")) | (first > fs / 2)).select("band")


def spectral_peak(by_condition: DataFrame, lo: float, hi: float) -> DataFrame:
    """condition, peak_freq, peak_db: the highest bin of a closed band, the lowest among equals."""
    inside = by_condition.where(F.col("freq").between(lo, hi))
    best = F.max_by(F.struct("freq", "mean_db"), F.struct(F.col("mean_db"), -F.col("freq")))
    return inside.groupBy("condition").agg(best.alias("best")).select(
        "condition", F.col("best.freq").alias("peak_freq"), F.col("best.mean_db").alias("peak_db")
    )


def line_noise(spectra: DataFrame, mains: float, width: float) -> DataFrame:
    """trial, harmonic, ratio: the peak within 1 Hz of mains harmonics over the mean of their neighbourhood."""
    sums = []
    for h in (1, 2, 3):
        off = F.abs(F.col("freq") - mains * h)
        sums.append(F.max(F.when(off <= 1, F.col("power"))).alias(f"peak{h}"))
        sums.append(F.avg(F.when((off <= width) & (off > 1), F.col("power"))).alias(f"near{h}"))
    each = spectra.groupBy("trial").agg(*sums)
    ratios = [F.struct(F.lit(h).cast("long").alias("harmonic"), F.try_divide(F.col(f"peak{h}"), F.col(f"near{h}")).alias("ratio")) for h in (1, 2, 3)]
    return each.select("trial", F.inline(F.array(*ratios))).where("ratio is not null")


def energy_fraction_below(spectra: DataFrame, freq: float) -> DataFrame:
    below = F.sum(F.when(F.col("freq") < freq, F.col("power")))
    return spectra.groupBy("trial").agg(F.try_divide(F.coalesce(below, F.lit(0.0)), F.sum("power")).alias("fraction"))


def phases(spectra: DataFrame, k: int | None = None) -> DataFrame:
    """trial, condition, k, phase of every bin, or of one."""
    kept = spectra if k is None else spectra.where(F.col("k") == k)
    return kept.select("trial", "condition", "k", F.atan2("im", "re").alias("phase"))


def phase_locking(phased: DataFrame, by: list[str]) -> DataFrame:
    """n, plv, ppc and mean_phase per group; ppc is null for a single phase."""
    c, s, n = F.sum(F.cos("phase")), F.sum(F.sin("phase")), F.count("phase")
    out = phased.groupBy(*by).agg(c.alias("c"), s.alias("s"), n.alias("n"))
    r2 = F.col("c") * F.col("c") + F.col("s") * F.col("s")
    pairs = F.col("n") * (F.col("n") - 1)
    return out.select(
        *by, "n", (F.sqrt(r2) / F.col("n")).alias("plv"), F.try_divide(r2 - F.col("n"), pairs).alias("ppc"),
        F.atan2("s", "c").alias("mean_phase"),
    )


def weighted_phase_lag(cross: DataFrame, by: list[str]) -> DataFrame:
    """wpli of cross-spectrum parts: |mean im| / mean |im|."""
    return cross.groupBy(*by).agg(F.try_divide(F.abs(F.avg("im")), F.avg(F.abs("im"))).alias("wpli"))


def aperiodic_fit(by_condition: DataFrame) -> DataFrame:
    """condition, offset, exponent: the straight line of log power over log frequency."""
    x, y = F.log10("freq"), F.col("mean_db") / 10
    logs = by_condition.where("freq > 0").select("condition", x.alias("lx"), y.alias("ly"))
    return logs.groupBy("condition").agg(
        F.regr_intercept("ly", "lx").alias("offset"), (-F.regr_slope("ly", "lx")).alias("exponent")
    )


def averaging_bias(spectra: DataFrame) -> DataFrame:
    """condition, k, log_of_mean, mean_of_log: averaging before or after the logarithm."""
    return spectra.groupBy("condition", "k").agg(
        A.decibel(F.avg("power")).alias("log_of_mean"), F.avg(A.decibel(F.col("power"))).alias("mean_of_log")
    )


def alias_frequency(f: Column, fs: float) -> Column:
    """Where a frequency folds to in [0, fs/2]."""
    return F.abs(f - F.bround(f / fs) * fs)


def add_z(by_condition: DataFrame) -> DataFrame:
    """z of mean_db over conditions of a bin: the grand mean and the pooled SD."""
    over = W.partitionBy("k")
    pooled = F.sqrt(
        F.try_divide(
            F.sum((F.col("n") - 1) * F.col("sd_db") * F.col("sd_db")).over(over), F.sum(F.col("n") - 1).over(over).cast("double")
        )
    )
    z = F.try_divide(F.col("mean_db") - F.avg("mean_db").over(over), pooled)
    return by_condition.withColumn("z", z)
