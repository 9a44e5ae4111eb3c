"""Signals in chunks of any size, put on a fixed grid of windows that reach into their neighbours.

Chunks are rows (series..., t0_idx, x). A window [k * width, (k + 1) * width) takes a halo of
samples from either side, so that filters and spectra cross chunk borders; what comes out
doesn't depend on how the signal was cut. A chunk is dealt in slices to the windows it
touches, and a window is put together from its slices: no group is larger than a window
and its halo, however long the signal.

A window with a gap or a doubled sample has no samples (x is null), and what is computed
from it is null. Results of one window are a row; sums over windows merge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.functions import filters as K


def chunked(samples: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """Rows (series, i, value) as chunks of ``size`` samples on a grid."""
    each = samples.withColumn("_k", F.floor(F.col("i") / size)).groupBy(*by, "_k").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("s"))
    return each.select(*by, F.get("s", F.lit(0))["i"].alias("t0_idx"), F.transform("s", lambda v: v["value"]).alias("x"))


def grid_windows(chunks: DataFrame, by: Sequence[str], width: int, left: int = 0, right: int = 0) -> DataFrame:
    """series, k, at (first sample of x), first, last (the window without halo), x."""
    a, b = F.col("t0_idx"), F.col("t0_idx") + F.size("x")
    lowest = F.greatest(F.floor((a - right) / width), F.lit(0))
    highest = F.ceil((b + left) / width) - 1
    dealt = chunks.where(F.size("x") > 0).select(*by, "t0_idx", "x", F.explode(F.sequence(lowest, F.greatest(highest, lowest))).alias("k"))
    begin, end = F.col("k") * width, (F.col("k") + 1) * width
    lo, hi = F.greatest(a, begin - left), F.least(b, end + right)
    core = F.greatest(F.least(b, end) - F.greatest(a, begin), F.lit(0))
    slices = dealt.where(lo < hi).select(
        *by, "k", F.greatest(a, begin).alias("_first"), F.least(b, end).alias("_last"), core.alias("_core"),
        F.struct(lo.alias("lo"), F.slice("x", (lo - a + 1).cast("int"), (hi - lo).cast("int")).alias("x")).alias("s"),
    )
    grouped = slices.groupBy(*by, "k").agg(
        F.array_sort(F.collect_list("s")).alias("s"), F.min(F.when(F.col("_core") > 0, F.col("_first"))).alias("first"), F.max(F.when(F.col("_core") > 0, F.col("_last"))).alias("last")
    )
    ends = F.transform("s", lambda s: s["lo"] + F.size(s["x"]))
    joint = F.forall(F.sequence(F.lit(1), F.size("s")), lambda i: (i == 1) | (F.get("s", i - 1)["lo"] == F.get(ends, i - 2)))
    whole = F.when(joint, F.flatten(F.transform("s", lambda s: s["x"])))
    # A window of halo alone lies past the signal's end.
    return grouped.where("first is not null").select(*by, "k", F.get("s", F.lit(0))["lo"].alias("at"), "first", "last", whole.alias("x"))


def extents(chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    """series, n, head, tail: a signal's length and end values."""
    some = chunks.where(F.size("x") > 0)
    return some.groupBy(*by).agg(
        F.max(F.col("t0_idx") + F.size("x")).alias("n"), F.min_by(F.get("x", F.lit(0)), "t0_idx").alias("head"),
        F.max_by(F.element_at("x", -1), F.col("t0_idx") + F.size("x")).alias("tail"),
    )


def mapped_windows(windows: DataFrame, by: Sequence[str], columns: Sequence[str], schema: str, many: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """What ``many`` makes of whole windows (dicts with numpy x), beside their series; windows without samples give nulls."""
    names = [f.split()[0] for f in schema.split(", ")]
    slim = windows.select(*by, *columns, "x")
    kinds = [f"{c} {t}" for c, t in slim.dtypes if c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [batch[c].to_pylist() for c in columns]
            rows = [{c: values[i] for c, values in zip(columns, held, strict=True)} for i in range(batch.num_rows)]
            for i, row in enumerate(rows):
                row["x"] = batch["x"][i].values.to_numpy(zero_copy_only=False).astype(float) if batch["x"][i].is_valid else None
            whole = [i for i, r in enumerate(rows) if r["x"] is not None]
            out: list[dict] = [{} for _ in rows]
            for i, found in zip(whole, many([rows[i] for i in whole]), strict=True):
                out[i] = found
            made = pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out], schema=target)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in by), *made.columns], names=[*by, *names])

    arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    target = pa.schema([(f.split()[0], arrow[f.split()[1]]) for f in schema.split(", ")])
    return slim.mapInArrow(run, ", ".join([*kinds, schema]))


def resample(chunks: DataFrame, by: Sequence[str], up: int, down: int, taps: np.ndarray, width: int = 1 << 16) -> DataFrame:
    """Chunks at rate * up / down: polyphase filtering with the given taps, the same as one pass over the whole signal."""
    if up == down:
        return chunks.select(*by, "t0_idx", "x")
    reach = K.halo(len(taps), up)
    ends = extents(chunks, by)
    windows = grid_windows(chunks, by, width, reach, reach).join(ends, list(by))

    def many(rows: list[dict]) -> list[dict]:
        return [
            {"t0_idx": K.outputs(r["first"], r["last"], up, down)[0], "x": K.resample_part(r["x"], r["at"], r["first"], r["last"], r["n"], (r["head"], r["tail"]), up, down, taps)}
            for r in rows
        ]

    return mapped_windows(windows, by, ["at", "first", "last", "n", "head", "tail"], "t0_idx long, x array<double>", many)


def resample_to(chunks: DataFrame, by: Sequence[str], rate: float, target: float, spec: K.FilterSpec = K.FilterSpec(), width: int = 1 << 16) -> tuple[DataFrame, K.FilterReport | None]:
    """The chunks at another rate, and what the filter does; rates without a small exact ratio and filters that let aliases pass are refused."""
    up, down = K.ratio(rate, target)
    if up == down:
        return chunks, None
    taps, report = K.antialias(up, down, rate, spec)
    return resample(chunks, by, up, down, taps, width), report


def decimate(chunks: DataFrame, by: Sequence[str], stages: Sequence[int], width: int = 1 << 14) -> DataFrame:
    """Every factor-th sample after a zero-phase recursive low-pass, stage by stage; signals too short to mirror give null."""
    out = chunks.select(*by, "t0_idx", "x")
    for factor in stages:
        if factor > 1:
            out = _decimate_once(out, by, factor, max(1, width // factor) * factor)
    return out


def _decimate_once(chunks: DataFrame, by: Sequence[str], factor: int, width: int) -> DataFrame:
    reach = K.SETTLED * factor
    low = K.decimation_filter(factor)
    windows = grid_windows(chunks, by, width, reach, reach).join(extents(chunks, by).select(*by, "n"), list(by))

    def many(rows: list[dict]) -> list[dict]:
        out: list[dict] = [{} for _ in rows]
        alike: dict[tuple, list[int]] = {}
        for i, r in enumerate(rows):
            alike.setdefault((len(r["x"]), r["at"] == 0, r["at"] + len(r["x"]) == r["n"]), []).append(i)
        for (size, start, end), own in alike.items():
            if (start or end) and size <= K.MIRRORED:
                continue
            y = K.both_ways(np.stack([rows[i]["x"] for i in own]), low, start, end)
            for i, line in zip(own, y, strict=True):
                r = rows[i]
                out[i] = {"t0_idx": r["first"] // factor, "x": line[r["first"] - r["at"] : r["last"] - r["at"] : factor]}
        return out

    return mapped_windows(windows, by, ["at", "first", "last", "n"], "t0_idx long, x array<double>", many)


def window_states(chunks: DataFrame, by: Sequence[str], width: int, rate: float, segment: int, overlap: int, rails: tuple[float, float] | float | None = None) -> DataFrame:
    """The state of every window: counts, sums, extremes, samples at the rails, and one spectrum if it holds a segment."""
    if overlap >= segment:
        overlap = segment - 1
    low, high = rail_bounds(rails)

    def many(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            good = np.isfinite(r["x"])
            x = r["x"][good]
            lo, hi = (float(x.min()), float(x.max())) if len(x) else (None, None)
            at_rail = None if low is None else int((x == low).sum() + ((x == high).sum() if high != low else 0))
            p = K.welch_median(r["x"], rate, segment, overlap) if good.all() and len(r["x"]) >= segment else None
            out.append({"n": len(x), "n_bad": int((~good).sum()), "ss": float((x * x).sum()), "lo": lo, "hi": hi, "n_lo": int((x == lo).sum()), "n_hi": int((x == hi).sum()), "n_rail": at_rail, "p": p})
        return out

    schema = "n long, n_bad long, ss double, lo double, hi double, n_lo long, n_hi long, n_rail long, p array<double>"
    return mapped_windows(grid_windows(chunks, by, width), by, ["k"], schema, many)


def rail_bounds(rails: tuple[float, float] | float | None) -> tuple[float | None, float | None]:
    """One value stands for itself on both sides of zero; a pair must rise."""
    if rails is None:
        return None, None
    if isinstance(rails, tuple):
        if len(rails) != 2 or rails[0] > rails[1]:
            raise ValueError(f"rails are a value or a rising pair, not {rails}")
        return float(rails[0]), float(rails[1])
    return -abs(float(rails)), abs(float(rails))


def merge_states(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """series, n, n_windows, n_bad, rms, lo, hi, n_lo, n_hi, n_rail: states of any windows merged. Non-finite samples leave no result but their count."""
    low = states.groupBy(*by, "lo").agg(F.sum("n_lo").alias("c")).groupBy(*by).agg(F.min_by("c", "lo").alias("n_lo"))
    high = states.groupBy(*by, "hi").agg(F.sum("n_hi").alias("c")).groupBy(*by).agg(F.max_by("c", "hi").alias("n_hi"))
    sums = states.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count("p").alias("n_windows"), F.sum("n_bad").alias("n_bad"), F.sqrt(F.try_divide(F.sum("ss"), F.sum("n"))).alias("rms"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n_rail").alias("n_rail"),
    )
    good = lambda c: F.when(F.col("n_bad") == 0, F.col(c)).alias(c)
    joined = sums.join(low, list(by)).join(high, list(by))
    return joined.select(*by, "n", "n_windows", "n_bad", *[good(c) for c in ("rms", "lo", "hi", "n_lo", "n_hi", "n_rail")])


def merge_spectra(states: DataFrame, by: Sequence[str], how: str = "median") -> DataFrame:
    """series, k, db: over windows the median, or the mean, of each bin's density, in decibels."""
    if how not in ("median", "mean"):
        raise ValueError(f"spectra merge by median or mean, not {how}")
    each = states.where("p is not null").select(*by, F.posexplode("p").alias("k", "v"))
    value: Column = F.percentile("v", F.lit(0.5)) if how == "median" else F.avg("v")
    return each.groupBy(*by, F.col("k").cast("long").alias("k")).agg((10 * F.log10(F.greatest(value, F.lit(float(np.finfo(np.float32).tiny))))).alias("db"))
