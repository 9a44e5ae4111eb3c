"""Array expressions that stay inside Spark's code generation: sums, products, spectra."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The smallest normal double: the floor below which a power has no logarithm.
TINY = 2.2250738585072014e-308


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(x))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    """Cosine of the angle between two vectors; null if either has length 0."""
    return F.try_divide(dot(x, y), norm(x) * norm(y))


def demean(x: Column) -> Column:
    """Constant detrend. The array is bound once, so its mean isn't taken again per element."""
    return F.element_at(F.transform(F.array(F.struct(x.alias("x"), mean(x).alias("m"))),
                                    lambda s: F.transform(s["x"], lambda v: v - s["m"])), 1)


def hann(n: int) -> list[float]:
    """The periodic Hann window."""
    return [0.5 - 0.5 * math.cos(2 * math.pi * i / n) for i in range(n)]


def windowed(x: Column, window: list[float]) -> Column:
    return F.zip_with(x, F.array(*map(F.lit, window)), lambda v, w: v * w)


def decibel(power: Column) -> Column:
    return 10 * F.log10(F.greatest(power, F.lit(TINY)))


def dft_parts(x: Column, k: Column, n: int) -> tuple[Column, Column]:
    """Real and imaginary part of bin k of the discrete Fourier transform."""
    turn = 2 * math.pi / n
    re = total(F.transform(x, lambda v, i: v * F.cos(k * i * turn)))
    im = total(F.transform(x, lambda v, i: -v * F.sin(k * i * turn)))
    return re, im
