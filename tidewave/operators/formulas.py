"""Formulas as column expressions: sampling, filtering plans, fields, probabilities.

All are null where an input is null; divisions by zero give null.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewave.functions.filters import MOST_DENOMINATOR

#: Anti-alias cutoff as a share of Nyquist, unless a configuration says otherwise.
CUTOFF_SHARE = 0.8
#: Largest factor of a single decimation stage.
MOST_PER_STAGE = 13
#: Conductivity (S/m), a lead's radius (mm), a brain's volume (cm3), half of Euler's series.
SIGMA, LEAD_RADIUS_MM, BRAIN_CM3, EULER = 0.3, 0.635, 1200.0, 0.5772156649015329


def cutoff_share(config: dict | None) -> float:
    """The configured share of Nyquist; the default if none or no number is given; it must lie in (0, 1]."""
    try:
        share = float((config or {})["antialias_cutoff_fraction_of_nyquist"])
    except (KeyError, TypeError, ValueError):
        return CUTOFF_SHARE
    if not 0 < share <= 1:
        raise ValueError(f"the cutoff is a share of Nyquist and must lie in (0, 1], not at {share}")
    return share


def usable_bandwidth(rate: Column, share: float = CUTOFF_SHARE) -> Column:
    return rate / 2 * share


def decimation_factor(rate: Column, target: Column) -> Column:
    """The largest whole factor that keeps the rate at or above the target; 1 if there is nothing to gain."""
    gain = (target > 0) & (target < rate)
    return F.when(gain, F.greatest(F.floor(F.try_divide(rate, target)), F.lit(1))).otherwise(1).cast("long")


def decimation_stages(factor: Column, most: int = MOST_PER_STAGE) -> Column:
    """The factor as a product of stages: one if it is small enough, else the largest divisors first; a large prime stays whole."""
    start = F.struct(F.array().cast("array<bigint>").alias("done"), factor.cast("long").alias("rest"))

    def take(state: Column, divisor: Column) -> Column:
        fits = (state["rest"] > most) & (state["rest"] % divisor == 0)
        return F.when(
            fits, F.struct(F.concat(state["done"], F.array(divisor)).alias("done"), (state["rest"] / divisor).cast("long").alias("rest"))
        ).otherwise(state)

    # A divisor may be taken several times: 2 at most 62 times in a long, 13 at most 17 times.
    tries = [d for d in range(most, 1, -1) for _ in range(int(62 / math.log2(d)))]
    state = F.aggregate(F.array(*[F.lit(d).cast("long") for d in tries]), start, take)
    return F.when(factor <= most, F.array(factor.cast("long"))).otherwise(
        F.element_at(F.transform(F.array(state), lambda s: F.when(s["rest"] > 1, F.concat(s["done"], F.array(s["rest"]))).otherwise(s["done"])), 1)
    )


def exact_fraction(rate: Column, bits: int = 20) -> tuple[Column, Column]:
    """Numerator and denominator of a rate that is a whole number of 2^-bits, in lowest terms; null if it isn't."""
    scaled = rate * float(1 << bits)
    whole = F.when((scaled == F.floor(scaled)) & (scaled > 0), scaled.cast("long"))
    powers = F.sequence(F.lit(0), F.lit(bits))
    shift = F.array_max(F.filter(powers, lambda p: whole % F.pow(F.lit(2.0), p).cast("long") == 0))
    return (whole / F.pow(F.lit(2.0), shift)).cast("long"), F.pow(F.lit(2.0), F.lit(bits) - shift).cast("long")


def greatest_common_divisor(a: Column, b: Column) -> Column:
    """Euclid's steps; 93 are enough for longs."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.greatest(s["b"], F.lit(1))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["a"])


def resample_ratio(rate: Column, target: Column, most: int | None = MOST_DENOMINATOR) -> tuple[Column, Column]:
    """up, down with rate * up / down = target exactly; null where a rate is no such fraction, or (refused) down would exceed ``most``; None refuses none."""
    (n1, d1), (n2, d2) = exact_fraction(rate), exact_fraction(target)
    up, down = n2 * d1, d2 * n1
    common = greatest_common_divisor(up, down)
    up, down = (up / common).cast("long"), (down / common).cast("long")
    if most is None:
        return up, down
    return F.when(down <= most, up), F.when(down <= most, down)


def harmonics(f: Column, rate: Column, count: int) -> Column:
    """Where the first harmonics of f fold to in [0, rate / 2]."""
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda k: F.abs(k * f - F.bround(F.try_divide(k * f, rate)) * rate))


def wavelet_resolution(f: Column, cycles: Column) -> tuple[Column, Column]:
    """Standard deviations in time (s) and frequency (Hz) of a Morlet wavelet."""
    time = F.try_divide(cycles, 2 * math.pi * f)
    return time, F.try_divide(F.lit(1.0), 2 * math.pi * time)


def dipole_potential(moment: Column, distance: Column, cosine: Column, sigma: float = SIGMA) -> Column:
    return F.try_divide(moment * cosine, 4 * math.pi * sigma * distance * distance)


def reach(amplitude: Column, at: Column, exponent: Column, noise: float) -> Column:
    """The distance at which an amplitude known at one distance falls to the noise."""
    return at * F.pow(amplitude / noise, F.try_divide(F.lit(1.0), exponent))


def contact_area(height: Column, diameter: Column, segments: Column) -> Column:
    return F.try_divide(math.pi * diameter * height, segments)


def field_around(angle_deg: Column, radius: Column, weights: list[Column]) -> Column:
    """Potential (per ampere, distances in mm) at a point around a lead from segments spaced evenly on it."""
    out = F.lit(0.0)
    for i, w in enumerate(weights):
        at = 2 * math.pi * i / len(weights)
        x = radius * F.cos(F.radians(angle_deg)) - LEAD_RADIUS_MM * math.cos(at)
        y = radius * F.sin(F.radians(angle_deg)) - LEAD_RADIUS_MM * math.sin(at)
        out = out + w / (4 * math.pi * SIGMA * F.greatest(F.sqrt(x * x + y * y), F.lit(1e-4)) * 1e-3)
    return out


def disc_mean_potential(current: Column, offset: Column, diameter: Column, depth: float, rings: int = 20) -> Column:
    """Mean potential over a disc contact of a source below it, offset from its centre: rings of equal area, 16 points each."""
    points = [(((i + 0.5) / rings) ** 0.5, 2 * math.pi * (j + 0.5 * (i % 2)) / 16) for i in range(rings) for j in range(16)]
    grid = F.array(*[F.struct(F.lit(r * math.cos(t)).alias("x"), F.lit(r * math.sin(t)).alias("y")) for r, t in points])
    near = lambda p: F.sqrt((p["x"] * diameter / 2 - offset) ** 2 + (p["y"] * diameter / 2) ** 2 + depth**2)
    return F.aggregate(grid, F.lit(0.0), lambda s, p: s + current / (4 * math.pi * SIGMA * near(p) * 1e-3)) / len(points)


def spatial_alias(frequency: Column, spacing: Column) -> Column:
    """The apparent spatial frequency after sampling every ``spacing``."""
    sampling = F.try_divide(F.lit(1.0), spacing)
    folded = frequency % sampling
    return F.least(folded, sampling - folded)


def implant_coverage(shafts: Column, contacts: Column, reach_mm: float, spacing_mm: float) -> tuple[Column, Column]:
    """Share of a brain's volume within reach of any contact, and that volume (cm3)."""
    volume = shafts * (math.pi * reach_mm**2) * ((contacts - 1) * spacing_mm + 2 * reach_mm) / 1000
    return volume / BRAIN_CM3, volume


def sites_within(reach_um: Column, pitch_um: Column, per_row: int) -> Column:
    return ((2 * F.floor(F.try_divide(reach_um, pitch_um)) + 1) * per_row).cast("long")


def data_rate(channels: Column, rate: Column, bits: int = 10) -> Column:
    """MB a second."""
    return channels * rate * bits / 8e6


def loop_latency(filter_ms: Column, cycles: Column, centre: Column, smoothing_ms: Column, device_ms: Column) -> Column:
    return filter_ms + F.try_divide(1000 * cycles, 2 * math.pi * centre) + smoothing_ms + device_ms


def normal_tail(z: Column) -> Column:
    """P(N > z): the series of the error function for small z, its continued fraction beyond 2.5."""
    x = F.abs(z) / math.sqrt(2)
    # erf(x) = 2/sqrt(pi) exp(-x^2) sum_n 2^n x^(2n+1) / (2n+1)!!
    start = F.struct(x.alias("term"), x.alias("sum"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), start,
        lambda s, n: F.struct((s["term"] * 2 * x * x / (2 * n + 1)).alias("term"), (s["sum"] + s["term"] * 2 * x * x / (2 * n + 1)).alias("sum")),
        lambda s: 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * s["sum"],
    )
    # erfc(x) = exp(-x^2)/sqrt(pi) / (x + (1/2)/(x + (2/2)/(x + ...)))
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda f, n: x + n / 2 / f)
    outer = F.exp(-x * x) / math.sqrt(math.pi) / fraction
    upper = F.when(x < 2.5, series).otherwise(outer) / 2
    return F.when(z >= 0, upper).otherwise(1 - upper)


def flip_probability(margin: Column, sigma: Column) -> Column:
    """The chance that a contact this far inside a boundary is outside it; 0 without any spread."""
    return F.when(sigma <= 0, 0.0).otherwise(normal_tail(F.try_divide(margin, sigma)))


def student_two_sided(t: Column, df: int) -> Column:
    """P(|T| > |t|) for df degrees of freedom, by the finite sums for even and odd df."""
    theta = F.atan(F.abs(t) / math.sqrt(df))
    c, s = F.cos(theta), F.sin(theta)
    if df == 1:
        return 1 - 2 / math.pi * theta
    if df % 2 == 0:
        ks, first = range(1, df // 2), F.lit(1.0)
        step = lambda k: (2 * k - 1) / (2 * k)
    else:
        ks, first = range(1, (df - 1) // 2), c
        step = lambda k: 2 * k / (2 * k + 1)
    factors = F.array(*[F.lit(step(k)) for k in ks]).cast("array<double>")
    start = F.struct(first.alias("term"), first.alias("sum"))
    total = F.aggregate(
        factors, start, lambda a, f: F.struct((a["term"] * f * c * c).alias("term"), (a["sum"] + a["term"] * f * c * c).alias("sum")), lambda a: a["sum"]
    )
    inside = s * total if df % 2 == 0 else 2 / math.pi * (theta + s * total)
    return F.greatest(1 - inside, F.lit(0.0))


def student_quantile(p: float, df: int) -> float:
    """The t that |T| exceeds with probability p, by bisection on the same sums."""

    def tail(t: float) -> float:
        theta = math.atan(t / math.sqrt(df))
        c, s = math.cos(theta), math.sin(theta)
        if df == 1:
            return 1 - 2 / math.pi * theta
        term = total = 1.0 if df % 2 == 0 else c
        for k in range(1, df // 2 if df % 2 == 0 else (df - 1) // 2):
            term *= ((2 * k - 1) / (2 * k) if df % 2 == 0 else 2 * k / (2 * k + 1)) * c * c
            total += term
        return 1 - (s * total if df % 2 == 0 else 2 / math.pi * (theta + s * total))

    low, high = 0.0, 1.0
    while tail(high) > p:
        high *= 2
    for _ in range(200):
        low, high = ((low + high) / 2, high) if tail((low + high) / 2) > p else (low, (low + high) / 2)
    return (low + high) / 2


def averaged_db_bias(k: Column) -> Column:
    """Decibels by which the mean logarithm of a mean of k periodograms lies below the logarithm of the mean: digamma(k) - ln k."""
    digamma = F.aggregate(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))), F.lit(-EULER), lambda s, i: s + F.when(i < k, 1.0 / i).otherwise(0.0))
    return 10 / math.log(10) * (digamma - F.log(k))


def sessions_for_power(mean: Column, sd: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """How many sessions a paired comparison of this size and spread needs."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return F.pow(F.try_divide(z * sd, F.abs(mean)), 2)


def peaked_spectrum(f: Column, offset: Column, exponent: Column, peaks: Column) -> Column:
    """Power of an aperiodic component and Gaussian peaks (array of centre, height, width)."""
    base = F.pow(F.lit(10.0), offset) / F.pow(f, exponent)
    return F.aggregate(peaks, base, lambda s, p: s + p["height"] * F.exp(-F.pow(f - p["centre"], 2) / (2 * p["width"] * p["width"])))
