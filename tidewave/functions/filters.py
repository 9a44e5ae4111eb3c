"""Filters for changing rates: designs whose response is measured, and kernels that know where in the signal they are."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from fractions import Fraction

import numpy as np

#: Denominators beyond this are no rate of a recorder, but a rounding.
MOST_DENOMINATOR = 3125


class RateNotRational(ValueError):
    """A rate that no small fraction gives exactly."""


@dataclass(frozen=True)
class FilterSpec:
    """Edges as shares of the lower Nyquist, attenuation, and the worst alias that is let pass."""

    passband: float = 0.8
    stopband: float = 1.0
    attenuation_db: float = 90.0
    alias_floor_db: float = -80.0

    def __post_init__(self):
        if not 0 < self.passband < self.stopband <= 1:
            raise ValueError(f"edges must rise within (0, 1], not {self.passband} to {self.stopband}")
        if self.attenuation_db <= 0:
            raise ValueError("attenuation must be positive")


@dataclass(frozen=True)
class FilterReport:
    """What a filter does, as measured on its response."""

    up: int
    down: int
    n_taps: int
    digest: str
    passband_hz: float
    stopband_hz: float
    at_01_db_hz: float
    at_3_db_hz: float
    stop_reached_hz: float
    at_nyquist_db: float
    alias_floor_db: float
    usable_hz: float


def ratio(rate: float, target: float, most: int = MOST_DENOMINATOR) -> tuple[int, int]:
    """up, down with rate * up / down = target exactly; refused if down would be larger than ``most``."""
    if rate <= 0 or target <= 0:
        raise ValueError("rates are positive")
    found = Fraction(target) / Fraction(rate)
    if found.denominator > most:
        raise RateNotRational(f"{rate} Hz to {target} Hz needs {found.numerator}/{found.denominator}: more than {most}")
    return found.numerator, found.denominator


def antialias(up: int, down: int, rate: float, spec: FilterSpec = FilterSpec()) -> tuple[np.ndarray, FilterReport]:
    """A Kaiser low-pass at rate * up, and its measured response; one whose alias floor misses the specification is refused."""
    if up < 1 or down < 1:
        raise ValueError("up and down are whole and positive")
    out, fast = rate * up / down, rate * up
    limit = min(out, rate) / 2
    lo, hi = spec.passband * limit, spec.stopband * limit
    width = (hi - lo) / (fast / 2)
    a = spec.attenuation_db
    beta = 0.1102 * (a - 8.7) if a > 50 else 0.5842 * max(a - 21, 0.0) ** 0.4 + 0.07886 * max(a - 21, 0.0)
    n = int(np.ceil((a - 7.95) / (2.285 * np.pi * width) + 1)) | 1
    cut = (lo + hi) / 2 / (fast / 2)
    t = np.arange(n) - (n - 1) / 2
    taps = cut * np.sinc(cut * t) * np.kaiser(n, beta)
    taps /= taps.sum()
    report = measure(taps, up, down, rate, lo, hi, spec)
    if report.alias_floor_db > spec.alias_floor_db:
        raise ValueError(f"the alias floor is {report.alias_floor_db:.1f} dB, above {spec.alias_floor_db:.1f} dB")
    return taps, report


def measure(taps: np.ndarray, up: int, down: int, rate: float, lo: float, hi: float, spec: FilterSpec) -> FilterReport:
    out, fast = rate * up / down, rate * up
    points = 1 << int(np.ceil(np.log2(max(8 * len(taps), 1 << 16))))
    size = np.abs(np.fft.rfft(taps, 2 * points))[:points]
    f = np.arange(points) * fast / 2 / points
    db = 20 * np.log10(np.maximum(size, 1e-300) / max(size[0], 1e-300))

    def first_below(level: float) -> float:
        at = np.flatnonzero(db < level)
        return float(f[at[0]]) if len(at) else float(f[-1])

    above = np.flatnonzero(db > -spec.attenuation_db)
    reached = float(f[min(above[-1] + 1, points - 1)]) if len(above) else float(f[-1])
    usable = min(lo, first_below(-0.1))
    # Every frequency past the new Nyquist folds onto its distance from the nearest multiple of the new rate.
    folded = np.abs(f - np.round(f / out) * out)
    alias = (f > out / 2) & (folded <= usable)
    return FilterReport(
        up, down, len(taps), hashlib.sha256(np.ascontiguousarray(taps).tobytes()).hexdigest(), lo, hi, first_below(-0.1), first_below(-3.0), reached,
        float(np.interp(out / 2, f, db)), float(db[alias].max()) if alias.any() else float("-inf"), usable,
    )


def halo(n_taps: int, up: int) -> int:
    """Input samples on either side that an output sample depends on."""
    return -(-(n_taps - 1) // (2 * up)) + 1


def outputs(first: int, last: int, up: int, down: int) -> tuple[int, int]:
    """Output samples whose time lies in input samples [first, last)."""
    return -(-first * up // down), -(-last * up // down)


def resample_part(x: np.ndarray, at: int, first: int, last: int, n: int, ends: tuple[float, float], up: int, down: int, taps: np.ndarray) -> np.ndarray:
    """Output samples of input [first, last) of a signal of n samples, from x, which begins at sample ``at``.

    The line through the signal's end values is kept aside, and nothing stands beyond the ends;
    so any part gives what one pass over the whole signal gives.
    """
    line = lambda t: ends[0] + (ends[1] - ends[0]) * t / max(n - 1, 1)
    rest = x - line(np.arange(at, at + len(x)))
    mid, per = (len(taps) - 1) // 2, -(-len(taps) // up)
    phases = np.zeros(per * up)
    phases[: len(taps)] = taps * up
    phases = phases.reshape(per, up).T  # phase p: taps p, p + up, ...
    j = np.arange(*outputs(first, last, up, down))
    y = line(j * (down / up))
    for k in range(0, len(j), max(1, (1 << 20) // per)):
        part = j[k : k + max(1, (1 << 20) // per)]
        top = part * down + mid
        i = (top // up)[:, None] - np.arange(per) - at
        inside = (i >= 0) & (i < len(rest))
        y[k : k + len(part)] += (np.where(inside, rest[np.clip(i, 0, len(rest) - 1)], 0.0) * phases[top % up]).sum(axis=1)
    return y


# --- recursive decimation -----------------------------------------------------------------


@dataclass(frozen=True)
class Recursion:
    """A recursive filter as a state: y = C s + D v, s = A s + B v."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float

    def run(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Signals in rows, each begun as if its start value had always stood."""
        rest = np.linalg.solve(np.eye(len(self.b)) - self.a, self.b)
        s = start[:, None] * rest
        out = np.empty_like(x)
        for i in range(x.shape[1]):
            v = x[:, i]
            out[:, i] = s @ self.c + self.d * v
            s = s @ self.a.T + v[:, None] * self.b
        return out


def chebyshev(order: int, ripple_db: float, cut: float) -> Recursion:
    """A low-pass with equal ripples of an even order; ``cut`` is a share of Nyquist. Sections of two poles in a row."""
    eps = np.sqrt(10 ** (ripple_db / 10) - 1)
    angle = np.pi * np.arange(1 - order, order, 2) / (2 * order)
    poles = -np.sinh(np.arcsinh(1 / eps) / order + 1j * angle) * 4 * np.tan(np.pi * cut / 2)
    gain = np.prod(-poles).real / np.sqrt(1 + eps * eps) / np.prod(4 - poles).real
    z = (4 + poles) / (4 - poles)
    a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), gain
    for pole in z[z.imag > 0]:
        a1, a2 = -2 * pole.real, abs(pole) ** 2
        own_a, own_b, own_c = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([2 - a1, 1 - a2]), np.array([1.0, 0.0])
        # The section takes what came out so far: its input is C s + D v.
        a = np.block([[a, np.zeros((len(b), 2))], [np.outer(own_b, c), own_a]])
        b, c = np.concatenate([b, own_b * d]), np.concatenate([c, own_c])
    return Recursion(a, b, c, d)


#: Samples by which a signal is mirrored about its ends, and by which a part reaches into its neighbours, per unit of the factor.
MIRRORED, SETTLED = 27, 200


def decimation_filter(factor: int) -> Recursion:
    """Order 8, 0.05 dB of ripple, cut at 0.8 of the new Nyquist."""
    return chebyshev(8, 0.05, 0.8 / factor)


def both_ways(x: np.ndarray, f: Recursion, at_start: bool, at_end: bool) -> np.ndarray:
    """Rows filtered forward and back, so without delay; the signal's own ends are mirrored, others need a halo."""
    n = x.shape[1]
    left = 2 * x[:, :1] - x[:, MIRRORED:0:-1] if at_start else x[:, :0]
    right = 2 * x[:, -1:] - x[:, -2 : -MIRRORED - 2 : -1] if at_end else x[:, :0]
    wide = np.concatenate([left, x, right], axis=1)
    y = f.run(wide, wide[:, 0])[:, ::-1]
    return f.run(y, y[:, 0])[:, ::-1][:, left.shape[1] : left.shape[1] + n]


# --- spectra ------------------------------------------------------------------------------


def median_bias(n: int) -> float:
    """What the median of n periodograms is of their mean, for noise."""
    k = 2 * np.arange(1.0, (n - 1) // 2 + 1)
    return float(1 + (1 / (k + 1) - 1 / k).sum())


def welch_median(x: np.ndarray, rate: float, size: int, overlap: int) -> np.ndarray:
    """Density of a stretch: the median over Hann-windowed segments, each without its mean."""
    step = size - overlap
    parts = np.lib.stride_tricks.sliding_window_view(x, size)[::step]
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    p = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * w)) ** 2 / (rate * (w * w).sum())
    p[:, 1 : (size + 1) // 2] *= 2
    return np.median(p, axis=0) / median_bias(len(p))
