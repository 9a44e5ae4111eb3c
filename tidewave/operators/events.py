"""Events in signals and between streams: stimulation by hysteresis, pulse trains, matching, phases at events.

States run along sorted rows: windows with running frames, or a stream over sorted
partitions that remembers a few rows. Neither holds a series in memory.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions import kernels as K
from tidewave.operators.grid import mapped_windows, grid_windows
from tidewave.operators.relations import refractory

#: What a run uses where neither it nor the configuration says otherwise.
STIMULATION = {
    "stim.source": "amplitude_threshold", "stim.threshold_mad": 12.0, "stim.refractory_ms": 100.0, "stim.condition": "", "stim.epoch_store": "",
    "window.blanking_ms": 4.0, "window.analysis_ms": 100.0, "band.low_hz": 100.0, "band.high_hz": 500.0, "peaks.min_peaks": 4,
    "peaks.min_prominence_fraction": 0.1, "peaks.max_interval_jitter": 0.35, "decay.fit": True, "decay.min_r_squared": 0.5, "quality.max_frequency_disagreement": 0.25,
}
#: A median absolute deviation times this is a standard deviation, for normal data.
MAD_TO_SD = 1.4826


def settings(given: Mapping[str, object], config: Mapping | None = None) -> dict[str, dict]:
    """Every setting with its value and where that is from: the run, the configuration, or the default."""
    unknown = set(given) - set(STIMULATION)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    out = {}
    for path, default in STIMULATION.items():
        group, key = path.split(".")
        block = (config or {}).get(group)
        if given.get(path) is not None:
            out[path] = {"value": given[path], "source": "run"}
        elif isinstance(block, Mapping) and key in block:
            out[path] = {"value": block[key], "source": "configuration"}
        else:
            out[path] = {"value": default, "source": "default"}
    return out


def hysteresis(samples: DataFrame, by: Sequence[str], order: str, value: str, on: Column, off: Column) -> DataFrame:
    """The samples with ``state``: true from a value of at least ``on`` to the last before one below ``off``; null values change nothing."""
    running = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = F.when(F.col(value) >= on, F.lit(True)).when(F.col(value) < off, F.lit(False))
    return samples.withColumn("state", F.coalesce(F.last(turn, ignorenulls=True).over(running), F.lit(False)))


def bursts(samples: DataFrame, by: Sequence[str], order: str, value: str, on: Column, off: Column) -> DataFrame:
    """series, burst, first, last, n, peak: the stretches in which the state is on, with their edges."""
    states = hysteresis(samples, by, order, value, on, off)
    line = Window.partitionBy(*by).orderBy(order)
    begins = F.col("state") & ~F.coalesce(F.lag("state").over(line), F.lit(False))
    numbered = states.withColumn("_b", begins).withColumn("burst", F.sum(F.col("_b").cast("long")).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.where("state").groupBy(*by, "burst").agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"), F.max(value).alias("peak")
    )


def robust_level(samples: DataFrame, by: Sequence[str], value: str, spreads: float) -> DataFrame:
    """series, level: the median plus so many standard deviations as the median absolute deviation tells; null where that is 0."""
    centre = samples.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    away = samples.join(centre, list(by)).groupBy(*by).agg(F.min("_m").alias("_m"), F.percentile(F.abs(F.col(value) - F.col("_m")), F.lit(0.5)).alias("_d"))
    return away.select(*by, F.when(F.col("_d") > 0, F.col("_m") + spreads * MAD_TO_SD * F.col("_d")).alias("level"))


def artifact_onsets(samples: DataFrame, by: Sequence[str], rate: float, threshold_mad: float = 12.0, refractory_ms: float = 100.0) -> DataFrame:
    """series, onset (samples): where the largest magnitude over all channels crosses its robust level, at least a refractory time apart.

    samples: series, channel, i, value. A series whose magnitude hardly varies has no onsets.
    """
    trace = samples.groupBy(*by, "i").agg(F.max(F.abs(F.col("value"))).alias("size"))
    levels = robust_level(trace, by, "size", threshold_mad)
    line = Window.partitionBy(*by).orderBy("i")
    above = trace.join(levels, list(by)).withColumn("above", F.coalesce(F.col("size") > F.col("level"), F.lit(False)))
    starts = above.withColumn("new", F.col("above") & ~F.coalesce(F.lag("above").over(line), F.lit(False))).where("new")
    return refractory(starts.select(*by, F.col("i").alias("onset")), list(by), round(refractory_ms * rate / 1000))


def stimulation_events(
    chosen: Mapping[str, object], by: Sequence[str], rate: float, samples: DataFrame | None = None, windows: DataFrame | None = None, events: DataFrame | None = None
) -> DataFrame:
    """series, onset (seconds) from the chosen source: the artifact in the signal, condition windows, or a store of events."""
    source = chosen["stim.source"]
    if source == "amplitude_threshold":
        found = artifact_onsets(samples, by, rate, chosen["stim.threshold_mad"], chosen["stim.refractory_ms"])
        return found.select(*by, (F.col("onset") / rate).alias("onset"))
    if source == "windows":
        kept = windows.where(F.col("condition") == chosen["stim.condition"]) if chosen["stim.condition"] else windows
        return kept.select(*by, F.col("t_start_s").cast("double").alias("onset"))
    if source == "epochs":
        store = chosen["stim.epoch_store"]
        labels = sorted(r[0] for r in events.select("label").distinct().limit(1000).collect())
        if store not in labels and len(labels) != 1:
            raise ValueError(f"{store or 'no store'} is not one of {', '.join(labels)}: name one in stim.epoch_store")
        return events.where(F.col("label") == (store if store in labels else labels[0])).select(*by, F.col("onset").cast("double").alias("onset"))
    raise ValueError(f"events come from amplitude_threshold, windows or epochs, not from {source}")


def pulse_trains(pulses: DataFrame, by: Sequence[str], most_gap: float) -> DataFrame:
    """series, train, t_on, t_off, n, rate: pulses no further apart than ``most_gap``; the rate is that of the mean gap."""
    line = Window.partitionBy(*by).orderBy("onset")
    gap = F.col("onset") - F.lag("onset").over(line)
    new = (gap.isNull() | (gap > most_gap)).cast("long")
    numbered = pulses.where("onset is not null").select(*by, "onset").withColumn("_n", new)
    numbered = numbered.withColumn("train", F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = numbered.groupBy(*by, "train").agg(F.min("onset").alias("t_on"), F.max("onset").alias("t_off"), F.count(F.lit(1)).alias("n"))
    return found.withColumn("rate", F.when(F.col("n") > 1, F.try_divide(F.col("n") - 1, F.col("t_off") - F.col("t_on"))))


def cut_at(chunks: DataFrame, by: Sequence[str], starts: DataFrame, cell: int = 4096) -> DataFrame:
    """starts' columns and x: samples [first, last) of their series, from chunks of any size.

    starts: series, id (unique), first, last. Chunks and windows meet in cells of time, by
    equality; a window that the signal doesn't hold in full has no x.
    """
    over = lambda a, b: F.sequence(F.floor(a / cell), F.floor((b - 1) / cell))
    end = F.col("t0_idx") + F.size("x")
    cells = chunks.where(F.size("x") > 0).select(*by, "t0_idx", "x", F.explode(over(F.col("t0_idx"), end)).alias("_cell"))
    asked = starts.where(F.col("last") > F.col("first"))
    dealt = asked.select(*by, "id", "first", "last", F.explode(over(F.col("first"), F.col("last"))).alias("_cell"))
    low, high = F.greatest("t0_idx", "first", F.col("_cell") * cell), F.least(end, F.col("last"), (F.col("_cell") + 1) * cell)
    both = dealt.join(cells, [*by, "_cell"]).select("id", "first", "last", low.alias("_lo"), high.alias("_hi"), "t0_idx", "x").where("_lo < _hi")
    slices = both.select("id", "first", "last", F.struct("_lo", F.slice("x", (F.col("_lo") - F.col("t0_idx") + 1).cast("int"), (F.col("_hi") - F.col("_lo")).cast("int")).alias("x")).alias("s"))
    whole = slices.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("s"), F.min(F.col("last") - F.col("first")).alias("_n"))
    ends = F.transform("s", lambda s: s["_lo"] + F.size(s["x"]))
    joint = F.forall(F.sequence(F.lit(1), F.size("s")), lambda i: (i == 1) | (F.get("s", i - 1)["_lo"] == F.get(ends, i - 2)))
    found = whole.select("id", F.flatten(F.transform("s", lambda s: s["x"])).alias("_x"), joint.alias("_joint"), "_n")
    found = found.select("id", F.when(F.col("_joint") & (F.size("_x") == F.col("_n")), F.col("_x")).alias("x"))
    return starts.join(found, "id", "left")


def responses(chunks: DataFrame, by: Sequence[str], events: DataFrame, rate: float, blanking_ms: float, analysis_ms: float) -> DataFrame:
    """events' columns and x: the stretch after each event's blanking; events whose stretch runs past the end are left out.

    events: series, id, onset (seconds).
    """
    begin = F.round(F.col("onset") * rate).cast("long") + round(blanking_ms * rate / 1000)
    starts = events.select(*events.columns, begin.alias("first"), (begin + round(analysis_ms * rate / 1000)).alias("last"))
    return cut_at(chunks, by, starts).where("x is not null")


# --- two streams --------------------------------------------------------------------------


def match_one_to_one(a: DataFrame, b: DataFrame, by: Sequence[str], tolerance: float) -> DataFrame:
    """series, t_a, t_b: events of two streams in pairs, earliest with earliest, at most ``tolerance`` apart; the rest alone.

    Both streams pass once, merged by time. A task remembers the events without a partner that
    are still within the tolerance, all of one stream.
    """
    tag = lambda rows, k: rows.where("onset is not null").select(*by, F.col("onset").cast("double").alias("onset"), F.lit(k).alias("side"))
    merged = tag(a, 0).unionAll(tag(b, 1))
    kinds = ", ".join(f"{c} {t}" for c, t in merged.dtypes if c in by)
    target = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list | None = None
        waiting: deque[float] = deque()
        side = 0
        for batch in batches:
            target.setdefault("schema", pa.schema([*(batch.schema.field(c) for c in by), ("t_a", pa.float64()), ("t_b", pa.float64())]))
            out: list[tuple] = []

            def alone(t: float) -> None:
                out.append((*group, t, None) if side == 0 else (*group, None, t))  # noqa: B023

            for *key, t, k in zip(*(batch[c].to_pylist() for c in (*by, "onset", "side")), strict=True):
                if key != group:
                    while waiting:
                        alone(waiting.popleft())
                    group = key
                while waiting and t - waiting[0] > tolerance:
                    alone(waiting.popleft())
                if waiting and side != k:
                    other = waiting.popleft()
                    out.append((*group, other, t) if side == 0 else (*group, t, other))
                else:
                    side = k
                    waiting.append(t)
            yield _batch(out, target["schema"])
        if waiting:
            yield _batch([(*group, t, None) if side == 0 else (*group, None, t) for t in waiting], target["schema"])

    ordered = merged.repartition(*by).sortWithinPartitions(*by, "onset", "side")
    return ordered.mapInArrow(run, f"{kinds}, t_a double, t_b double")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def match_scores(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """series, hits, missed, false_alarms, precision, recall, jitter: b's events as found ones, a's as the truth."""
    both = F.col("t_a").isNotNull() & F.col("t_b").isNotNull()
    sums = pairs.groupBy(*by).agg(
        F.count_if(both).alias("hits"), F.count_if(F.col("t_b").isNull()).alias("missed"), F.count_if(F.col("t_a").isNull()).alias("false_alarms"),
        F.stddev_pop(F.col("t_b") - F.col("t_a")).alias("jitter"),
    )
    share = lambda rest: F.try_divide(F.col("hits"), F.col("hits") + F.col(rest))
    return sums.select("*", share("false_alarms").alias("precision"), share("missed").alias("recall"))


def match_counts(a: DataFrame, b: DataFrame, by: Sequence[str], tolerance: float) -> DataFrame:
    """series, hits, missed, false_alarms: events of a with any of b within the tolerance, those without, and events of b without any of a."""
    tag = lambda rows, k: rows.where("onset is not null").select(*by, "onset", F.lit(k).alias("side"))
    merged = tag(a, 0).unionAll(tag(b, 1))
    before = Window.partitionBy(*by).orderBy("onset").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*by).orderBy("onset").rangeBetween(Window.currentRow, Window.unboundedFollowing)

    def near(side: int) -> Column:
        own = F.when(F.col("side") == side, F.col("onset"))
        gap = F.least(F.col("onset") - F.max(own).over(before), F.min(own).over(after) - F.col("onset"))
        return F.coalesce(gap <= tolerance, F.lit(False))

    seen = merged.withColumn("of_a", near(0)).withColumn("of_b", near(1))
    return seen.groupBy(*by).agg(
        F.count_if((F.col("side") == 0) & F.col("of_b")).alias("hits"), F.count_if((F.col("side") == 0) & ~F.col("of_b")).alias("missed"),
        F.count_if((F.col("side") == 1) & ~F.col("of_a")).alias("false_alarms"),
    )


def wrapped(angle: Column) -> Column:
    """An angle within [-pi, pi)."""
    return angle - 2 * math.pi * F.floor((angle + math.pi) / (2 * math.pi))


def band_phase(chunks: DataFrame, by: Sequence[str], rate: float, low: float, high: float, width: int = 1 << 14) -> DataFrame:
    """series, t0_idx, phase (array): the phase within a band, window by window with a halo of ten cycles of the lowest frequency."""
    halo = math.ceil(10 * rate / low)

    def many(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            x = r["x"] - r["x"].mean()
            angle = np.angle(K.analytic(K.bandpass(x, rate, low, high))) if len(x) > 1 else np.zeros(len(x))
            out.append({"t0_idx": r["first"], "phase": angle[r["first"] - r["at"] : r["last"] - r["at"]]})
        return out

    return mapped_windows(grid_windows(chunks, by, width, halo, halo), by, ["at", "first", "last"], "t0_idx long, phase array<double>", many)


def phases_at(phases: DataFrame, events: DataFrame, by: Sequence[str]) -> DataFrame:
    """events with ``at``: the phase there, between its two neighbouring samples along the shorter way round; null outside the samples.

    phases: series, t, phase; events: series, onset. As-of in both directions by running
    windows over the merged rows, so no pairs are made.
    """
    own = phases.where("phase is not null").select(*by, F.col("t").cast("double").alias("_t"), F.struct(F.col("t").cast("double").alias("t"), "phase").alias("_s"), F.lit(None).cast("long").alias("_id"))
    numbered = events.withColumn("_id", F.monotonically_increasing_id())
    asked = numbered.select(*by, F.col("onset").cast("double").alias("_t"), F.lit(None).cast("struct<t: double, phase: double>").alias("_s"), "_id")
    merged = own.withColumn("_s", F.col("_s").cast("struct<t: double, phase: double>")).unionByName(asked)
    line = Window.partitionBy(*by).orderBy("_t")
    before, after = line.rangeBetween(Window.unboundedPreceding, Window.currentRow), line.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    p, q = F.last("_s", ignorenulls=True).over(before), F.first("_s", ignorenulls=True).over(after)
    found = merged.select(*by, "_t", "_id", p.alias("_p"), q.alias("_q")).where("_id is not null")
    share = F.coalesce(F.try_divide(F.col("_t") - F.col("_p.t"), F.col("_q.t") - F.col("_p.t")), F.lit(0.0))
    at = F.when(F.col("_p").isNotNull() & F.col("_q").isNotNull(), wrapped(F.col("_p.phase") + wrapped(F.col("_q.phase") - F.col("_p.phase")) * share))
    return found.select(*by, F.col("_t").alias("onset"), at.alias("at"))


def locking(phases: DataFrame, by: Sequence[str]) -> DataFrame:
    """series, n, plv, mean_phase, ppc of the phases ``at`` events; ppc is the share of pairs, free of the bias of few events."""
    sums = phases.where("at is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.cos("at")).alias("c"), F.sum(F.sin("at")).alias("s"))
    size = F.col("c") * F.col("c") + F.col("s") * F.col("s")
    return sums.select(*by, "n", (F.sqrt(size) / F.col("n")).alias("plv"), F.atan2("s", "c").alias("mean_phase"), F.try_divide(size - F.col("n"), F.col("n") * (F.col("n") - 1)).alias("ppc"))
