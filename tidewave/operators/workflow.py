"""Sessions, reviews and plans: projections and small state changes over their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a sample by binary format.
SAMPLE_BYTES = (("INT_16", 2), ("INT_32", 4), ("IEEE_FLOAT_32", 4), ("IEEE_FLOAT_64", 8))
#: What a role may do, by rank.
ROLE_RANK = (("viewer", 0), ("analyst", 1), ("reviewer", 2), ("admin", 3))


def lookup(column: Column, pairs) -> Column:
    """A small table as an expression; null for anything else."""
    out = F.lit(None)
    for name, value in reversed(pairs):
        out = F.when(column == name, value).otherwise(out)
    return out


def stream_info(samples: DataFrame, by: list[str]) -> DataFrame:
    """by, n, t0, duration_s, rate, nyquist: the descriptor of each stream; a rate of 0 has no duration."""
    out = samples.groupBy(*by).agg(F.count("value").alias("n"), F.min("onset").alias("t0"), F.max("onset").alias("t1"))
    rate = F.coalesce(F.try_divide(F.col("n") - 1, F.col("t1") - F.col("t0")), F.lit(0.0))
    return out.withColumn("rate", rate).select(
        *by, "n", "t0", F.coalesce(F.try_divide(F.col("n"), F.col("rate")), F.lit(0.0)).alias("duration_s"), "rate", (F.col("rate") / 2).alias("nyquist")
    )


def first_seen(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The distinct values of each group with their place by first appearance."""
    from pyspark.sql import Window as W

    seen = rows.groupBy(*by, value).agg(F.min(order).alias("first"))
    return seen.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("first", value)).cast("long")).drop("first")


def readable_counts(rows: DataFrame, by: list[str], ok: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if(ok).alias("opened"), F.count_if(~ok).alias("failed"))


def apply_exclusions(contacts: DataFrame, actions: DataFrame, key: list[str]) -> DataFrame:
    """Contacts without those that an exclude action names."""
    return contacts.join(actions.where("action = 'exclude'").select(*key).distinct(), key, "left_anti")


def decide(rows: DataFrame, chosen: Column, verdict: Column, reason: Column) -> DataFrame:
    """A verdict for the rows chosen; a rejection without a reason isn't recorded."""
    valid = chosen & ~((verdict == "reject") & (F.coalesce(F.trim(reason), F.lit("")) == ""))
    return rows.withColumn("verdict", F.when(valid, verdict).otherwise(F.col("verdict")))


def baseline(maps: DataFrame, by: list[str], mode: str, inside: Column) -> DataFrame:
    """value against its mean over the baseline: logratio, percent, zscore or none."""
    if mode == "none":
        return maps
    base = maps.where(inside).groupBy(*by).agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    out = {
        "logratio": F.log10(F.try_divide("value", "_m")),
        "percent": F.try_divide(F.col("value") - F.col("_m"), F.col("_m")),
        "zscore": F.try_divide(F.col("value") - F.col("_m"), F.col("_s")),
    }[mode]
    return maps.join(base, by).withColumn("value", out).drop("_m", "_s")


def plan_products(streams: DataFrame) -> DataFrame:
    """What is built of a stream: its product, rate and reason."""
    product = F.when(F.col("role") == "ignore", None).when(F.col("rate") > 1000, "low_rate").otherwise("native")
    rate = F.when(product == "low_rate", F.lit(1000.0)).when(product == "native", F.col("rate"))
    reason = F.when(product.isNull(), "ignored").when(product == "low_rate", "above the target rate").otherwise("at or below the target rate")
    return streams.select("stream", product.alias("product"), rate.alias("rate_out"), reason.alias("reason"))


def off_clock(events: DataFrame, limits: DataFrame, by: list[str]) -> DataFrame:
    """Event stores with an onset before 0 or after the recording's end."""
    ends = events.groupBy(*by).agg(F.min("onset").alias("lo"), F.max("onset").alias("hi"))
    return ends.join(limits, by).where("lo < 0 or hi > end")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with the same key; the others stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def zoned(stamp: Column) -> Column:
    """Whether a stamp is a time that names its zone."""
    return F.coalesce(stamp.rlike(r"(Z|[+-]\d\d:?\d\d)$") & F.try_to_timestamp(stamp).isNotNull(), F.lit(False))


def bad_bands(bands: DataFrame) -> DataFrame:
    """Bands whose edges aren't numbers, aren't above 0 or aren't in order."""
    lo, hi = F.col("lo").try_cast("double"), F.col("hi").try_cast("double")
    return bands.where(~F.coalesce((lo > 0) & (hi > lo), F.lit(False)))


def monopole(current: Column, distance: Column, conductivity: float) -> Column:
    return F.try_divide(current, 4 * 3.141592653589793 * conductivity * distance)


def effective_bits(full_scale: Column, noise_rms: Column) -> Column:
    """log2 of the range over the noise's step: what a converter resolves."""
    return F.log2(F.try_divide(full_scale, noise_rms * (12**0.5)))
