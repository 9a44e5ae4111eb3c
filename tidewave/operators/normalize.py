"""z-normalisation with a choice of centre and scale, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CENTERS = ("grand_mean", "condition", "whole_recording", "none")
SCALES = ("pooled", "own_condition", "condition", "across_conditions", "none")


def _present(over, condition, value: Column) -> Column:
    """value, where the baseline condition has rows; without them there is no baseline to speak of."""
    there = F.count_if(F.col("condition") == condition).over(over) > 0
    return F.when(there, value).otherwise(F.raise_error(F.lit(f"no rows of the baseline condition {condition}")).cast("double"))


def center_of(choice: str, key: list[str], condition) -> Column:
    over = W.partitionBy(*key)
    if choice == "grand_mean":
        return F.avg("value").over(over)
    if choice == "condition":
        return _present(over, condition, F.avg(F.when(F.col("condition") == condition, F.col("value"))).over(over))
    if choice == "whole_recording":
        return F.try_divide(F.sum(F.col("value") * F.col("n")).over(over), F.sum("n").over(over).cast("double"))
    if choice == "none":
        return F.lit(0.0)
    raise ValueError(f"unknown centre {choice}")


def scale_of(choice: str, key: list[str], condition) -> Column:
    over = W.partitionBy(*key)
    if choice == "pooled":
        weight, square = F.col("n") - 1, F.col("sd") * F.col("sd")
        pooled = F.try_divide(F.sum(weight * square).over(over), F.sum(weight).over(over).cast("double"))
        return F.sqrt(F.when(F.sum(weight).over(over) > 0, pooled).otherwise(F.avg(square).over(over)))
    if choice == "own_condition":
        return F.col("sd")
    if choice == "condition":
        return _present(over, condition, F.avg(F.when(F.col("condition") == condition, F.col("sd"))).over(over))
    if choice == "across_conditions":
        several = F.size(F.collect_set("condition").over(over)) >= 2
        return F.when(several, F.stddev_samp("value").over(over)).otherwise(
            F.raise_error(F.lit("a spread across conditions needs at least two")).cast("double")
        )
    if choice == "none":
        return F.lit(1.0)
    raise ValueError(f"unknown scale {choice}")


def normalize(rows: DataFrame, center: str, scale: str, key: list[str], condition=None) -> DataFrame:
    """rows (key, condition, value, sd, n) with z = (value - centre) / scale, null where the scale is 0."""
    z = F.try_divide(F.col("value") - center_of(center, key, condition), scale_of(scale, key, condition))
    return rows.withColumn("z", z)


def sentence(center: str, scale: str) -> str:
    """What the z means, in words."""
    return f"z of the value less its {center.replace('_', ' ')} centre, over its {scale.replace('_', ' ')} scale"


def options_for_schema(options: dict | None = None) -> dict[str, list[dict]]:
    """What a form shows beside every choice: value, label and the configured texts, blank where nothing is told."""
    told = lambda group, key: (options or {}).get(group, {}).get(key) or {}
    texts = ("description", "when_to_use", "caveat")
    return {
        group: [{"value": key, "label": told(group, key).get("label", key), **{t: str(told(group, key).get(t, "")).strip() for t in texts}} for key in keys]
        for group, keys in (("centers", CENTERS), ("scales", SCALES))
    }
