"""Proposals about layout: roles by name, contacts by impedance, phrases and windows by label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def classify_by_patterns(rows: DataFrame, name: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """rows with role: that of the one pattern that fits, 'ambiguous' for several roles, 'unmapped' for none; 'ignore' wins."""
    roles = F.array_distinct(F.filter(F.array(*[F.when(F.col(name).rlike(p), F.lit(r)) for p, r in patterns]), lambda r: r.isNotNull()))
    role = (
        F.when(F.array_contains(roles, "ignore"), "ignore")
        .when(F.size(roles) == 1, F.get(roles, F.lit(0)))
        .otherwise(F.when(F.size(roles) > 1, "ambiguous").otherwise("unmapped"))
    )
    return rows.withColumn("role", role)


def contact_kinds(sweep: DataFrame, by: list[str], ratio: float = 1.5) -> DataFrame:
    """segment where the impedance is at least ratio times the lead's least, ring otherwise."""
    least = F.min("kohm").over(W.partitionBy(*by))
    return sweep.withColumn("kind", F.when(F.col("kohm") >= ratio * least, "segment").otherwise("ring"))


def geometry(contacts: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, geometry: the rows of a lead, 1 for a ring, 3s for a run of segments that threes divide, else its length."""
    over = W.partitionBy(*by).orderBy(order)
    new = F.when((F.col("kind") == "ring") | F.coalesce(F.lag("kind").over(over) == "ring", F.lit(True)), 1).otherwise(0)
    runs = contacts.withColumn("run", F.sum(new).over(over)).groupBy(*by, "run", "kind").agg(F.count(F.lit(1)).alias("n"))
    rows = (
        F.when(F.col("kind") == "ring", F.array(F.lit(1)))
        .when(F.col("n") % 3 == 0, F.array_repeat(F.lit(3), (F.col("n") / 3).cast("int")))
        .otherwise(F.array(F.col("n").cast("int")))
    )
    each = runs.select(*by, F.struct("run", rows.alias("rows")).alias("r"))
    merged = F.flatten(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["rows"]))
    return each.groupBy(*by).agg(merged.alias("geometry"))


def contact_quality(kohm: Column) -> Column:
    return F.when(kohm >= 100, "open").when(kohm >= 25, "high").otherwise("good")


def differential_pairs(contacts: DataFrame, by: list[str]) -> DataFrame:
    """Contacts paired in order, (1, 2), (3, 4), ...: the worse impedance of each; a last single one is left out."""
    place = F.row_number().over(W.partitionBy(*by).orderBy("contact")) - 1
    paired = contacts.withColumn("pair", F.floor(place / 2)).groupBy(*by, "pair").agg(
        F.min("contact").alias("a"), F.max("contact").alias("b"), F.max("kohm").alias("kohm"), F.count(F.lit(1)).alias("n")
    )
    return paired.where("n = 2").select(*by, "a", "b", "kohm", contact_quality(F.col("kohm")).alias("quality"))


def longest_pattern(labels: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Each distinct label with the condition of the longest pattern it holds, the first among equals; without one, null."""
    ranked = sorted(patterns, key=lambda p: -len(p[0]))
    condition = F.lit(None).cast("string")
    for pattern, name in reversed(ranked):
        condition = F.when(F.instr(F.col("label"), pattern) > 0, name).otherwise(condition)
    return labels.select("label").distinct().withColumn("condition", condition)


def found_phrases(text: Column, phrases: list[str]) -> Column:
    """Phrases in a text, longest first; one inside a longer one that was found isn't told again."""
    ranked = sorted(set(phrases), key=lambda p: (-len(p), p))
    found = F.filter(F.array(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in ranked]), lambda p: p.isNotNull())
    return F.aggregate(
        found, F.array().cast("array<string>"),
        lambda kept, p: F.when(F.exists(kept, lambda k: F.contains(k, p)), kept).otherwise(F.concat(kept, F.array(p))),
    )


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.9, "high").when(score >= 0.6, "medium").otherwise("low")


def epoch_bounds(windows: DataFrame, length: float, overlap: float) -> DataFrame:
    """Windows cut into epochs of a fixed length; one too short stays whole."""
    step = length * (1 - overlap)
    n = F.floor((F.col("t1") - F.col("t0") - length) / step + 1e-9) + 1
    spans = F.when(
        n >= 1, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1),
                            lambda i: F.struct((F.col("t0") + i * step).alias("a"), (F.col("t0") + i * step + length).alias("b")))
    ).otherwise(F.array(F.struct(F.col("t0").alias("a"), F.col("t1").alias("b"))))
    return windows.select("*", F.inline(spans))


def epoch_matrix(samples: DataFrame, triggers: DataFrame, before: int, after: int) -> DataFrame:
    """session, trigger, x: the samples at trigger-before .. trigger+after-1 of each trigger that has them all.

    A trigger asks for each of its samples by index: an equi-join.
    """
    asked = triggers.select("session", "channel", F.col("i").alias("trigger"), F.explode(F.sequence(F.col("i") - before, F.col("i") + after - 1)).alias("i"))
    held = asked.join(samples.select("session", "channel", "i", "value"), ["session", "channel", "i"])
    whole = held.groupBy("session", "channel", "trigger").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("s"))
    return whole.where(F.size("s") == before + after).select("session", "channel", "trigger", F.transform("s", lambda s: s["value"]).alias("x"))


def decay_fit(points: DataFrame, by: list[str], least_r2: float) -> DataFrame:
    """by, tau, r2: log amplitude over time as a line; tau is null if it doesn't fall or fits badly."""
    logs = points.where("value > 0").withColumn("lv", F.log("value"))
    fit = logs.groupBy(*by).agg(F.regr_slope("lv", "t").alias("slope"), F.regr_r2("lv", "t").alias("r2"))
    good = (F.col("slope") < 0) & (F.col("r2") >= least_r2)
    return fit.select(*by, F.when(good, -1 / F.col("slope")).alias("tau"), "r2")


def drift_over_effect(series: DataFrame, by: list[str], width: int) -> DataFrame:
    """by, excursion, effect, ratio: the smoothed peak to peak of a series over the spread of its conditions' means."""
    over = W.partitionBy(*by).orderBy("ord")
    smooth = F.avg("value").over(over.rowsBetween(-(width - 1), 0))
    full = F.when(F.count("value").over(over.rowsBetween(-(width - 1), 0)) == width, smooth)
    drift = series.withColumn("s", full).groupBy(*by).agg((F.max("s") - F.min("s")).alias("excursion"))
    means = series.groupBy(*by, "condition").agg(F.avg("value").alias("m")).groupBy(*by).agg((F.max("m") - F.min("m")).alias("effect"))
    return drift.join(means, by).withColumn("ratio", F.try_divide("excursion", "effect"))


def blocked_folds(rows: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """Contiguous folds of almost equal size within each group."""
    return rows.withColumn("fold", (F.ntile(k).over(W.partitionBy(*by).orderBy(order)) - 1).cast("long"))
