"""Joins over windows and events, merges, and ordered relations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def time_to_sample(t: Column, fs: float, n: Column) -> Column:
    """Sample index of a time: rounded half to even, within [0, n]."""
    return F.least(F.greatest(F.bround(t * fs, 0).cast("long"), F.lit(0)), n)


def _cell(t: Column, width: float) -> Column:
    return F.floor(t / width).cast("long")


def in_windows(samples: DataFrame, windows: DataFrame, width: float) -> DataFrame:
    """Pairs of a sample and a half-open window [t0, t1) of its session that holds it.

    Windows are dealt to cells of ``width`` seconds, samples have one cell: an
    equi-join on (session, cell) instead of a range join of whole sessions.
    """
    cells = F.sequence(_cell(F.col("t0"), width), _cell(F.col("t1"), width))
    spread = windows.withColumn("cell", F.explode(cells)).withColumnRenamed("session", "w_session")
    placed = samples.withColumn("cell", _cell(F.col("onset"), width))
    joined = placed.join(spread.withColumnRenamed("cell", "w_cell"), F.expr("session = w_session and cell = w_cell"))
    return joined.where("onset >= t0 and onset < t1").drop("w_session", "cell", "w_cell")


def label_conditions(samples: DataFrame, windows: DataFrame, width: float) -> DataFrame:
    """Every sample with the condition of the last window (by ord) that holds it, '' outside all."""
    held = in_windows(samples.select("session", "channel", "i", "onset"), windows, width)
    last = held.groupBy("session", "channel", "i").agg(F.max_by("condition", "ord").alias("condition"))
    return samples.join(last, ["session", "channel", "i"], "left").withColumn("condition", F.coalesce("condition", F.lit("")))


def events_in_windows(samples: DataFrame, windows: DataFrame, width: float) -> DataFrame:
    """Semi-join: samples inside any window of their session."""
    held = in_windows(samples.select("session", "channel", "i", "onset"), windows, width).select("session", "channel", "i").distinct()
    return samples.join(held, ["session", "channel", "i"], "left_semi")


def within_recording(events: DataFrame, tmin: float, tmax: float) -> DataFrame:
    """Events whose whole epoch lies in [0, end] of their session."""
    over = W.partitionBy("session")
    timed = events.withColumns({"start": F.min("onset").over(over), "end": F.max("onset").over(over)})
    return timed.where((F.col("onset") + tmin >= F.col("start")) & (F.col("onset") + tmax <= F.col("end"))).drop("start", "end")


def next_onset(events: DataFrame) -> DataFrame:
    """As-of forward: the next distinct onset of the session, else the recording's end."""
    each = events.select("session", "onset").distinct()
    over = W.partitionBy("session")
    following = F.lead("onset").over(over.orderBy("onset"))
    end = F.max("onset").over(over)
    return each.select("session", "onset", F.coalesce(following, end).alias("extent_end"))


def merge_decisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer merge by flag_id: reviewer columns of old win, detected ones of new; missing in new is stale."""
    o = old.select("flag_id", F.col("severity").alias("o_severity"), "verdict", "reviewer")
    n = new.select("flag_id", F.col("severity").alias("n_severity"))
    merged = o.join(n, "flag_id", "full_outer")
    state = F.when(F.col("n_severity").isNull(), "stale").when(F.col("o_severity").isNull(), "new").otherwise("kept")
    return merged.select("flag_id", F.coalesce("n_severity", "o_severity").alias("severity"), "verdict", "reviewer", state.alias("state"))


def compare_params(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer diff of (run, key, value) tables: the keys whose values differ, null-safe."""
    x, y = a.select("run", "key", F.col("value").alias("a")), b.select("run", "key", F.col("value").alias("b"))
    return x.join(y, ["run", "key"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def pooled_sd(rows: DataFrame, key: list[str]) -> DataFrame:
    """sqrt of sum((n-1) s^2) / sum(n-1) per key; root mean square if all weights are 0."""
    weight, square = F.col("n") - 1, F.col("sd") * F.col("sd")
    out = rows.groupBy(*key).agg(F.sum(weight * square).alias("s"), F.sum(weight).alias("w"), F.avg(square).alias("q"))
    return out.select(*key, F.sqrt(F.when(F.col("w") > 0, F.try_divide(F.col("s"), F.col("w").cast("double"))).otherwise(F.col("q"))).alias("pooled"))


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page of a totally ordered table."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def moving_excursion(rows: DataFrame, by: list[str], order: str, value: str, width: int | None = None) -> DataFrame:
    """Peak to peak of the moving average of full frames; null for groups with fewer than 5 rows.

    width: rows of a frame; without one a fifth of the group's, at least three. A frame's sum is
    the difference of two running sums, which meet by equality.
    """
    over = W.partitionBy(*by).orderBy(order)
    known = rows.where(F.col(value).isNotNull())
    placed = known.select(*by, F.row_number().over(over).alias("_i"), F.sum(value).over(over.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_s"), F.count(F.lit(1)).over(W.partitionBy(*by)).alias("_n"))
    sized = placed.withColumn("_w", F.lit(width).cast("long") if width is not None else F.greatest(F.floor(F.col("_n") / 5), F.lit(3)))
    before = placed.select(*by, (F.col("_i")).alias("_j"), F.col("_s").alias("_t"))
    frames = sized.where(F.col("_i") >= F.col("_w")).withColumn("_j", F.col("_i") - F.col("_w")).join(before, [*by, "_j"], "left")
    smooth = F.when(F.col("_n") >= 5, (F.col("_s") - F.coalesce("_t", F.lit(0.0))) / F.col("_w"))
    found = frames.groupBy(*by).agg((F.max(smooth) - F.min(smooth)).alias("excursion"))
    return rows.select(*by).distinct().join(found, by, "left")


def contrast_drift(values: DataFrame, by: str, baseline: object) -> DataFrame:
    """by, effect, excursion, ratio: the largest difference of conditions' means, and how far the baseline condition drifts there.

    values: by (a band or row), condition, ord, value. One row, for the value of ``by`` with the
    largest effect, so that drift and effect are of the same; none without two conditions.
    """
    means = values.groupBy(by, "condition").agg(F.avg("value").alias("m"))
    effects = means.groupBy(by).agg((F.max("m") - F.min("m")).alias("effect"), F.count(F.lit(1)).alias("c")).where("c > 1")
    largest = effects.agg(F.max_by(F.struct(F.col(by).alias("b"), "effect"), F.struct("effect", by)).alias("x")).where("x is not null").select(F.col("x.b").alias(by), "x.effect")
    own = values.where(F.col("condition") == baseline).join(largest.select(by), by)
    drift = moving_excursion(own, [by], "ord", "value")
    return largest.join(drift, by, "left").withColumn("ratio", F.try_divide("excursion", "effect"))


def window_span(windows: DataFrame, by: list[str]) -> DataFrame:
    """by, span_s: from the first start to the last end; null if a time is missing or nothing is spanned."""
    bad = F.count_if(F.col("t_start_s").isNull() | F.col("t_end_s").isNull())
    span = F.max("t_end_s") - F.min("t_start_s")
    return windows.groupBy(*by).agg(F.when((bad == 0) & (span > 0), span).alias("span_s"))


def refractory(events: DataFrame, by: list[str], gap: float) -> DataFrame:
    """Events that come at least gap after the last one kept: a pass over each group's sorted onsets.

    Onsets stream by; the last one kept is all a task remembers.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = None, None
        for batch in batches:
            kept = []
            for *key, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                far = key != group or t - last >= gap
                group, last = (key, t) if far else (group, last)
                kept.append(far)
            yield batch.filter(pa.array(kept, pa.bool_()))

    rows = events.where("onset is not null").select(*by, "onset")
    return rows.repartition(*by).sortWithinPartitions(*by, "onset").mapInArrow(keep, rows.schema)


def blank_and_interpolate(rows: DataFrame, by: list[str], order: str, value: str, blank: Column) -> DataFrame:
    """Blanked samples replaced by the straight line between their neighbours; at an edge the nearest value."""
    good = F.when(~blank, F.col(value))
    at = F.when(~blank, F.col(order))
    back = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*by).orderBy(order).rowsBetween(0, W.unboundedFollowing)
    near = rows.withColumns(
        {
            "v0": F.last(good, True).over(back), "t0": F.last(at, True).over(back),
            "v1": F.first(good, True).over(ahead), "t1": F.first(at, True).over(ahead),
        }
    )
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * F.coalesce(F.try_divide(F.col(order) - F.col("t0"), F.col("t1") - F.col("t0")), F.lit(0.0))
    return near.withColumn("filled", F.coalesce(line, F.col("v0"), F.col("v1"))).drop("v0", "t0", "v1", "t1")


def psth(events: DataFrame, triggers: DataFrame, before: float, after: float, bin_s: float) -> DataFrame:
    """session, bin, n: events by their distance from triggers of the session, in [-before, after)."""
    windows = triggers.select(
        "session", (F.col("onset") - before).alias("t0"), (F.col("onset") + after).alias("t1"), F.col("onset").alias("trigger")
    )
    held = in_windows(events, windows, before + after)
    return held.groupBy("session", F.floor((F.col("onset") - F.col("trigger")) / bin_s).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
