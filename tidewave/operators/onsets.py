"""Time-frequency power around onsets, with as much signal on either side as the wavelets reach."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators.events import cut_at
from tidewave.operators.grid import mapped_windows

#: A wavelet reaches this many standard deviations of its envelope to either side.
REACH = 5.0
MIN_PHASE_CYCLES = 10.0


def frequencies(low: float, high: float, n: int) -> np.ndarray:
    """n frequencies in equal ratios."""
    if not 0 < low <= high or n < 1:
        raise ValueError(f"frequencies rise from above 0, not from {low} to {high}")
    return np.geomspace(low, high, n)


def cycles(freqs: np.ndarray, factor: float, least: float) -> np.ndarray:
    """Cycles per wavelet: in proportion to frequency, so all last as long, but no fewer than ``least``."""
    return np.maximum(np.asarray(freqs) * factor, least)


def reach(freqs: np.ndarray, n_cycles: np.ndarray, rate: float) -> int:
    """Samples that the widest wavelet needs on either side."""
    return int(np.ceil(np.max(REACH * n_cycles / (2 * np.pi * np.asarray(freqs))) * rate))


def wavelet(freq: float, n_cycles: float, rate: float) -> np.ndarray:
    """A complex Morlet wavelet of unit energy over two."""
    s = n_cycles / (2 * np.pi * freq)
    half = int(np.floor(REACH * s * rate))
    t = np.arange(-half, half + 1) / rate
    w = np.exp(2j * np.pi * freq * t - t * t / (2 * s * s))
    return w / (np.sqrt(0.5) * np.linalg.norm(w))


def power(x: np.ndarray, waves: Sequence[np.ndarray], pad: int, step: int) -> np.ndarray:
    """(rows, frequency, time) of padded stretches in rows, without the padding, every step-th sample."""
    n = x.shape[1]
    out = np.empty((len(x), len(waves), len(range(pad, n - pad, step))))
    for i, w in enumerate(waves):
        size = n + len(w) - 1
        full = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(w, size))
        begin = (len(w) - 1) // 2
        out[:, i] = np.abs(full[:, begin + pad : begin + n - pad : step]) ** 2
    return out


def onset_power(
    chunks: DataFrame, by: Sequence[str], onsets: DataFrame, rate: float, freqs: np.ndarray, n_cycles: np.ndarray, tmin: float, tmax: float, step: int = 1
) -> DataFrame:
    """onsets' columns, freq, t (seconds from the onset), power, in [tmin, tmax].

    onsets: series, id (unique), onset (seconds). Signal is fetched as far beyond the range as
    the widest wavelet reaches, so no value depends on what lies past an edge; an onset
    without that much signal around it has a null power and no freq.
    """
    pad = reach(freqs, n_cycles, rate)
    a, b = round(tmin * rate), round(tmax * rate)
    at = F.round(F.col("onset") * rate).cast("long")
    starts = onsets.withColumn("first", at + (a - pad)).withColumn("last", at + (b + pad + 1))
    found = cut_at(chunks, by, starts.where("first >= 0").unionByName(starts.where("first < 0").withColumn("last", F.col("first"))))
    waves = [wavelet(f, c, rate) for f, c in zip(freqs, n_cycles, strict=True)]
    names = [c for c in onsets.columns if c != "x"]

    def many(rows: list[dict]) -> list[dict]:
        maps = power(np.stack([r["x"] for r in rows]), waves, pad, step) if rows else []
        return [{"p": m.reshape(-1)} for m in maps]

    mapped = mapped_windows(found, names, [], "p array<double>", many)
    width = len(range(a, b + 1, step))
    each = mapped.select(*names, F.posexplode_outer("p").alias("_i", "power"))
    freq = F.element_at(F.array(*[F.lit(float(f)) for f in freqs]), (F.floor(F.col("_i") / width) + 1).cast("int"))
    return each.select(*names, freq.alias("freq"), ((F.col("_i") % width * step + a) / rate).alias("t"), "power")


def against_baseline(maps: DataFrame, by: Sequence[str], t0: float, t1: float, how: str = "logratio") -> DataFrame:
    """maps with ``value``: power against its own [t0, t1] as 10 log10 ratio, percent or z; a baseline without samples is refused by a null."""
    rows = maps.where("power is not null")
    base = rows.where(F.col("t").between(t0, t1)).groupBy(*by, "freq").agg(F.avg("power").alias("_m"), F.stddev_samp("power").alias("_s"))
    tiny = F.lit(float(np.finfo(float).tiny))
    if how == "logratio":
        value = 10 * F.log10(F.greatest("power", tiny) / F.greatest("_m", tiny))
    elif how == "percent":
        value = 100 * (F.col("power") - F.col("_m")) / F.greatest("_m", tiny)
    elif how == "zscore":
        value = F.try_divide(F.col("power") - F.col("_m"), F.nullif("_s", F.lit(0.0)))
    else:
        raise ValueError(f"a baseline is taken by logratio, percent or zscore, not by {how}")
    return rows.join(base, [*by, "freq"], "left").withColumn("value", value).drop("_m", "_s")


def coupling_grid(low: float, high: float, step: float) -> np.ndarray:
    """Centres from low up to, not including, high."""
    return np.arange(low, high, step)


def too_short(seconds: float, slowest_hz: float, least_cycles: float = MIN_PHASE_CYCLES) -> str | None:
    """Why a stretch can't hold a comodulogram, or None."""
    needed = least_cycles / slowest_hz
    return None if seconds >= needed else f"{seconds:.2f} s is less than the {needed:.2f} s that {least_cycles:g} cycles of {slowest_hz:g} Hz take"
