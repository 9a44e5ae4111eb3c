"""Numpy kernels over epochs, run where Spark has dealt them: one row in, one row or more out."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.functions import kernels as K


def _each(epochs: DataFrame, schema: str, one: Callable[[np.ndarray], dict], least: int = 8) -> DataFrame:
    """trial, condition and what ``one`` makes of each epoch.

    Epochs that are null, shorter than ``least`` or hold a sample that isn't finite give nulls.
    """
    return _stacked(epochs, schema, lambda rows: [one(x) for x in rows], least)


def _stacked(epochs: DataFrame, schema: str, many: Callable[[np.ndarray], list[dict]], least: int = 8) -> DataFrame:
    """The same with ``many``, which takes epochs of one length as rows of a matrix."""
    names = ["trial", "condition", *T._parse_datatype_string(schema).fieldNames()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            by_length: dict[int, list[int]] = {}
            arrays = [np.zeros(0) if x is None else np.asarray(x, float) for x in rows["x"]]
            out: list[dict] = [{} for _ in arrays]
            for i, x in enumerate(arrays):
                if len(x) >= least and np.isfinite(x).all():
                    by_length.setdefault(len(x), []).append(i)
            for own in by_length.values():
                for i, found in zip(own, many(np.stack([arrays[i] for i in own])), strict=True):
                    out[i] = found
            heads = zip(rows["trial"], rows["condition"], out, strict=True)
            yield pd.DataFrame([[t, c, *[found.get(n) for n in names[2:]]] for t, c, found in heads], columns=names, dtype=object)

    return epochs.select("trial", "condition", "x").mapInPandas(run, f"trial long, condition long, {schema}")


def time_frequency(epochs: DataFrame, fs: float, freqs: list[float], cycles: float, step: int) -> DataFrame:
    """trial, condition, freq, t, power of Morlet wavelets, every step-th sample."""

    def many(x: np.ndarray) -> list[dict]:
        return [{"map": each} for each in K.morlet_power(x, fs, np.array(freqs), cycles)[..., ::step].tolist()]

    maps = _stacked(epochs, "map array<array<double>>", many)
    rows = maps.select("trial", "condition", F.posexplode_outer("map").alias("fi", "row"))
    freq = F.element_at(F.array(*map(F.lit, freqs)), F.col("fi") + 1)
    return rows.select("trial", "condition", freq.alias("freq"), F.posexplode_outer("row").alias("ti", "power")).withColumn("t", F.col("ti") * step / fs).drop("ti")


def baseline_log_ratio(maps: DataFrame, t0: float, t1: float) -> DataFrame:
    """condition, freq, t, value: mean power over trials, in log10 over its mean in [t0, t1]."""
    mean = maps.groupBy("condition", "freq", "t").agg(F.avg("power").alias("power"))
    base = mean.where(F.col("t").between(t0, t1)).groupBy("condition", "freq").agg(F.avg("power").alias("base"))
    return mean.join(base, ["condition", "freq"]).select("condition", "freq", "t", F.log10(F.try_divide("power", "base")).alias("value"))


def multitaper(epochs: DataFrame, fs: float) -> DataFrame:
    """trial, condition, k, power."""
    found = _stacked(epochs, "p array<double>", lambda x: [{"p": p} for p in K.multitaper(x, fs).tolist()])
    return found.select("trial", "condition", F.posexplode_outer("p").alias("k", "power"))


def envelope(epochs: DataFrame, fs: float, lo: float, hi: float) -> DataFrame:
    """trial, condition, envelope and phase (arrays) of a band."""

    def many(x: np.ndarray) -> list[dict]:
        z = K.analytic(K.bandpass(x, fs, lo, hi))
        return [{"envelope": a, "phase": p} for a, p in zip(np.abs(z).tolist(), np.angle(z).tolist(), strict=True)]

    return _stacked(epochs, "envelope array<double>, phase array<double>", many)


def comodulation(epochs: DataFrame, fs: float, slow: list[tuple[float, float]], fast: list[tuple[float, float]], bins: int = 9) -> DataFrame:
    """trial, condition, slow, fast (band centres), mi: phase-amplitude coupling on a grid."""

    def one(x: np.ndarray) -> dict:
        phases = [np.angle(K.analytic(K.bandpass(x, fs, *b))) for b in slow]
        sizes = [np.abs(K.analytic(K.bandpass(x, fs, *b))) for b in fast]
        return {"grid": [{"slow": sum(s) / 2, "fast": sum(f) / 2, "mi": K.modulation_index(p, a, bins)} for s, p in zip(slow, phases, strict=True) for f, a in zip(fast, sizes, strict=True)]}

    found = _each(epochs, "grid array<struct<slow:double,fast:double,mi:double>>", one)
    each = found.select("trial", "condition", F.inline("grid"))
    return each.withColumn("mi", F.when(~F.isnan("mi"), F.col("mi")))


def ringing(epochs: DataFrame, fs: float, lo: float, hi: float, fraction: float = 0.2, tolerance: float = 0.3) -> DataFrame:
    """trial, condition, n_extrema, amplitude, freq, tau, r2, peak_freq of a damped oscillation.

    The decay is a straight line through the log magnitudes of the regular run of extrema;
    peak_freq is the highest point of the spectrum of the samples that the run spans.
    """

    def one(x: np.ndarray) -> dict:
        y = K.bandpass(x, fs, lo, hi)
        run = K.regular_run(K.prominent_extrema(y, fraction), tolerance)
        out = {"n_extrema": len(run), "amplitude": float(np.abs(y[run]).max()) if len(run) else None, "freq": None, "tau": None, "r2": None, "peak_freq": None}
        if len(run) > 2:
            out["freq"] = float(fs / (2 * np.median(np.diff(run))))
            out["peak_freq"] = K.band_peak(y[run[0] : run[-1] + 1], fs, lo, hi)
            t, a = run / fs, np.log(np.abs(y[run]))
            slope, base = np.polyfit(t, a, 1)
            rest = ((a - slope * t - base) ** 2).sum()
            total = ((a - a.mean()) ** 2).sum()
            out["r2"] = float(1 - rest / total) if total > 0 else None
            out["tau"] = float(-1 / slope) if slope < 0 else None
        return out

    return _each(epochs, "n_extrema long, amplitude double, freq double, tau double, r2 double, peak_freq double", one)


def ringing_summary(measures: DataFrame, by: list[str]) -> DataFrame:
    """by, n, responding, and medians over the trials that ring (those with a frequency).

    Medians are exact; a group's values are those of one condition or recording.
    """
    rings = F.col("freq").isNotNull()
    return measures.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(rings).alias("responding"),
        *[F.median(F.when(rings, F.col(c))).alias(f"median_{c}") for c in ("freq", "amplitude", "tau", "peak_freq")],
    )


def resampled(epochs: DataFrame, up: int, down: int) -> DataFrame:
    """trial, condition, x at up/down of the rate."""
    cut = 0.45 / max(up, down)
    taps = K.kaiser_lowpass(cut, 60.0, 0.1 / max(up, down))
    return _each(epochs, "x array<double>", lambda x: {"x": K.resample(x, up, down, taps).tolist()})


def tracked(epochs: DataFrame, q: float, r: float) -> DataFrame:
    """trial, condition, x filtered by a random-walk Kalman filter."""
    return _each(epochs, "x array<double>", lambda x: {"x": K.kalman(x, q, r).tolist()})


def halves_granger(epochs: DataFrame, lags: int) -> DataFrame:
    """trial, condition, forward, backward: causality between the halves of an epoch's vector."""

    def one(x: np.ndarray) -> dict:
        a, b = x[: len(x) // 2], x[len(x) // 2 : len(x) // 2 * 2]
        return {"forward": K.granger(a, b, lags), "backward": K.granger(b, a, lags)}

    return _each(epochs, "forward double, backward double", one)


def surrogate_coupling(epochs: DataFrame, fs: float, slow: tuple[float, float], fast: tuple[float, float], bins: int = 9, draws: int = 60) -> DataFrame:
    """trial, condition, mi, z: coupling against circular shifts of the amplitude; seeded by the samples."""

    def one(x: np.ndarray) -> dict:
        phase, size = np.angle(K.analytic(K.bandpass(x, fs, *slow))), np.abs(K.analytic(K.bandpass(x, fs, *fast)))
        draw = np.random.default_rng(zlib.crc32(x.tobytes()))
        found = {"mi": K.modulation_index(phase, size, bins), "z": K.surrogate_z(phase, size, bins, draws, draw)}
        return {k: v if np.isfinite(v) else None for k, v in found.items()}

    return _each(epochs, "mi double, z double", one)


def thirds_granger(epochs: DataFrame, lags: int) -> DataFrame:
    """trial, condition, plain, given: causality from the first to the second third of an epoch, alone and given the last."""

    def one(x: np.ndarray) -> dict:
        a, b, c = np.split(x[: len(x) // 3 * 3], 3)
        return {"plain": K.granger(a, b, lags), "given": K.granger_given(a, b, c, lags)}

    return _each(epochs, "plain double, given double", one, least=9 * lags + 9)


def filtered(epochs: DataFrame, b: list[float], a: list[float]) -> DataFrame:
    """trial, condition, once, both, delay: a recursive filter run once and both ways, and the delay of running it once."""

    def many(x: np.ndarray) -> list[dict]:
        once, both = K.iir(x, np.array(b), np.array(a)), K.zero_phase(x, np.array(b), np.array(a))
        return [{"once": o, "both": z, "delay": int(d)} for o, z, d in zip(once.tolist(), both.tolist(), K.delay(x, once), strict=True)]

    return _stacked(epochs, "once array<double>, both array<double>, delay long", many)


def band_split(epochs: DataFrame, fs: float, split_hz: float) -> DataFrame:
    """trial, condition, low, high: power below and above a frequency after zero-phase filters."""

    def many(x: np.ndarray) -> list[dict]:
        low, high = K.split_at(x - x.mean(axis=-1, keepdims=True), fs, split_hz)
        return [{"low": float(p), "high": float(q)} for p, q in zip((low**2).mean(axis=-1), (high**2).mean(axis=-1), strict=True)]

    return _stacked(epochs, "low double, high double", many)


def leakage(epochs: DataFrame) -> DataFrame:
    """trial, condition, plain, hann: the highest level away from the peak, without and with a window."""

    def many(x: np.ndarray) -> list[dict]:
        n = x.shape[-1]
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        return [{"plain": float(p), "hann": float(h)} for p, h in zip(K.leakage_db(x), K.leakage_db(x, window), strict=True)]

    return _stacked(epochs, "plain double, hann double", many, least=16)


def smoothed(epochs: DataFrame, sigma: float) -> DataFrame:
    return _stacked(epochs, "x array<double>", lambda x: [{"x": r} for r in K.gaussian_smooth(x, sigma).tolist()])


def spectral_peaks(spectra: DataFrame, by: str, lo: float, hi: float) -> DataFrame:
    """by, offset, exponent, peaks: each group's mean spectrum (by, freq, power) taken apart. A group is one spectrum."""
    kind = dict(spectra.dtypes)[by]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[(rows["freq"] >= lo) & (rows["freq"] <= hi) & (rows["power"] > 0)].sort_values("freq")
        if len(rows) < 8:
            return pd.DataFrame(columns=[by, "offset", "exponent", "peaks"])
        offset, exponent, peaks = K.fit_spectrum(rows["freq"].to_numpy(), rows["power"].to_numpy())
        told = [dict(zip(("centre", "height", "width"), p, strict=True)) for p in peaks]
        return pd.DataFrame({by: [rows[by].iloc[0]], "offset": [offset], "exponent": [exponent], "peaks": [told]})

    schema = f"{by} {kind}, offset double, exponent double, peaks array<struct<centre:double,height:double,width:double>>"
    return spectra.select(by, "freq", "power").groupBy(by).applyInPandas(run, schema)
