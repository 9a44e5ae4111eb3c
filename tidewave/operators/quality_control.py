"""Detectors over channels and trials: what looks wrong, with its evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.storage import settled

#: Fixed value: a normal distribution's SD over its median absolute deviation.
MAD_SCALE = 1.4826
#: Ranks of the values between which a median is looked for, as a share of the group on either side; percentile_approx
#: misses a rank by one in ACCURACY. Medians are exact with any value: what isn't found between them is looked for everywhere.
BRACKET, ACCURACY = 0.0002, 10_000


def robust_z(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """rows with z = (value - median) / (1.4826 MAD) within ``by``; 0 where the MAD is 0.

    Medians are aggregated per group and joined back, so no group is held in one window. An aggregation
    holds a group's distinct values: for groups of millions there is ``robust_z_of_large_groups``.
    """
    mid = rows.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("_med"))
    off = rows.join(mid, by)
    mad = off.groupBy(*by).agg(F.percentile(F.abs(F.col(value) - F.col("_med")), F.lit(0.5)).alias("_mad"))
    z = F.coalesce(F.try_divide(F.col(value) - F.col("_med"), MAD_SCALE * F.col("_mad")), F.lit(0.0))
    return off.join(mad, by).withColumn("z", z).drop("_med", "_mad")


def with_groups(rows: DataFrame, groups: DataFrame, by: list[str], how: str) -> DataFrame:
    """rows joined with one row per group; null is a group like others."""
    named = groups.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = [rows[c].eqNullSafe(named[f"_by_{c}"]) for c in by]
    return rows.join(named, same, how).drop(*(f"_by_{c}" for c in by))


def medians(rows: DataFrame, value: str, by: list[str], bracket: float | None = BRACKET) -> DataFrame:
    """by, median: the exact medians (as percentile's) of groups of any size; groups without a value have none.

    Two values that have the median between them come from percentile_approx. Values below the lower one
    are only counted, those between both are counted each, and cumulative counts give the median's rank.
    Groups whose median is elsewhere after all are counted whole. The rows are read twice and never
    shuffled; per group a task holds about 2 * (bracket + 1 / ACCURACY) of its distinct values.
    """
    own = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    if bracket is None:
        low, high = F.lit(float("-inf")), F.lit(float("nan"))  # Spark orders NaN last
    else:
        ends = F.percentile_approx("_v", F.array(F.lit(0.5 - bracket), F.lit(0.5 + bracket)), ACCURACY)
        low, high = ends[0], ends[1]
    bounds = settled(own.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), low.alias("_low"), high.alias("_high")))
    near = with_groups(own, bounds, by, "inner").where("_v <= _high")
    counts = near.groupBy(*by, "_n", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_count"))
    order = W.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    upto = counts.withColumn("_upto", F.sum("_count").over(order))
    first, last = F.expr("_upto >= (_n + 1) div 2"), F.expr("_upto >= _n div 2 + 1")
    found = settled(
        upto.groupBy(*by).agg(
            F.min(F.when(first, F.col("_v"))).alias("_a"), F.min(F.when(last, F.col("_v"))).alias("_b"),
            (F.bool_or(F.col("_v").isNull() & first) | ~F.bool_or(last)).alias("_missed"),
        )
    )
    median = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(0.5 * F.col("_a") + 0.5 * F.col("_b"))
    out, missed = found.where("not _missed").select(*by, median.alias("median")), found.where("_missed").select(*by)
    if missed.isEmpty():
        return out
    return out.unionByName(medians(with_groups(own, missed, by, "left_semi"), "_v", by, None))


def robust_z_of_large_groups(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """As robust_z, for groups of any size: rows should be cheap to read, as they are read five times."""
    off = with_groups(rows, medians(rows, value, by).withColumnRenamed("median", "_med"), by, "left")
    far = off.select(*by, F.abs(F.col(value) - F.col("_med")).alias("_far"))
    mad = medians(far, "_far", by).withColumnRenamed("median", "_mad")
    z = F.coalesce(F.try_divide(F.col(value) - F.col("_med"), MAD_SCALE * F.col("_mad")), F.lit(0.0))
    return with_groups(off, mad, by, "left").withColumn("z", z).drop("_med", "_mad")


def flat_channels(samples: DataFrame, by: list[str], fraction: float) -> DataFrame:
    """Channels whose SD (population) is below a fraction of the session's median SD."""
    sd = samples.groupBy(*by, "channel").agg(F.stddev_pop("value").alias("sd"))
    mid = sd.groupBy(*by).agg(F.percentile("sd", F.lit(0.5)).alias("median_sd"))
    return sd.join(mid, by).where(F.col("sd") < fraction * F.col("median_sd"))


def group_outliers(stats: DataFrame, value: str, by: list[str], limit: float, least: int) -> DataFrame:
    """Rows beyond a robust z in their group, and one row per group too small to judge."""
    sizes = stats.groupBy(*by).agg(F.count(F.lit(1)).alias("members"))
    sized = stats.join(sizes, by)
    judged = robust_z(sized.where(F.col("members") >= least), value, by).where(F.abs("z") > limit)
    small = sizes.where(F.col("members") < least)
    flagged = judged.select(*by, "channel", "z", F.lit("outlier").alias("flag"))
    none = small.select(*by, F.lit(None).cast("string").alias("channel"), F.lit(None).cast("double").alias("z"), F.lit("insufficient_channels").alias("flag"))
    return flagged.unionByName(none)


def unbiased_kurtosis(n: Column, population: Column) -> Column:
    """Excess kurtosis corrected for bias; null below four values."""
    return F.when(n > 3, ((n - 1) / ((n - 2) * (n - 3))) * ((n + 1) * population + 6))


def block_kurtosis(samples: DataFrame, by: list[str], width: int) -> DataFrame:
    """Median over blocks of the unbiased excess kurtosis."""
    blocks = samples.groupBy(*by, F.floor(F.col("i") / width).alias("block")).agg(
        F.count("value").cast("double").alias("n"), F.kurtosis("value").alias("g2")
    )
    each = blocks.withColumn("k", unbiased_kurtosis(F.col("n"), F.col("g2")))
    return each.groupBy(*by).agg(F.percentile("k", F.lit(0.5)).alias("kurtosis"), F.count("k").alias("blocks"))


def clipping(samples: DataFrame, by: list[str]) -> DataFrame:
    """Fraction of samples at the channel's largest magnitude."""
    rail = samples.groupBy(*by).agg(F.max(F.abs("value")).alias("rail"))
    at = F.abs(F.abs("value") - F.col("rail")) <= 1e-8 + 1e-6 * F.col("rail")
    return samples.join(rail, by).groupBy(*by, "rail").agg(F.avg(F.when(at, 1.0).otherwise(0.0)).alias("fraction"))


def amplitude_episodes(samples: DataFrame, by: list[str], width: int, limit: float, least: int) -> DataFrame:
    """Runs of blocks whose peak to peak stands out: log robust z per channel, islands merged.

    Channels with fewer than ``least`` blocks aren't judged.
    """
    blocks = samples.groupBy(*by, F.floor(F.col("i") / width).alias("block")).agg((F.max("value") - F.min("value")).alias("p2p"))
    many = blocks.groupBy(*by).agg(F.count(F.lit(1)).alias("blocks")).where(F.col("blocks") >= least).drop("blocks")
    logs = blocks.join(many, by).withColumn("lp", F.log10(F.greatest("p2p", F.lit(1e-12))))
    loud = robust_z(logs, "lp", by).where(F.col("z") > limit)
    island = F.col("block") - F.row_number().over(W.partitionBy(*by).orderBy("block"))
    return loud.withColumn("island", island).groupBy(*by, "island").agg(
        F.min("block").alias("first"), F.max("block").alias("last"), F.max("z").alias("z")
    ).drop("island")


def trial_outliers(epochs: DataFrame, limit: float) -> DataFrame:
    """Trials whose peak to peak stands out among those of their condition."""
    p2p = epochs.select("trial", "condition", (F.array_max("x") - F.array_min("x")).alias("p2p"))
    return robust_z(p2p, "p2p", ["condition"]).where(F.abs("z") > limit)


def spikes(samples: DataFrame, by: list[str], k: float, gap: int) -> DataFrame:
    """Peaks beyond k robust sigmas: samples less than ``gap`` apart are one, at its largest."""
    mid = samples.groupBy(*by).agg((F.percentile(F.abs("value"), F.lit(0.5)) / 0.6745).alias("sigma"))
    over = samples.join(mid, by).where(F.abs("value") > k * F.col("sigma"))
    order = W.partitionBy(*by).orderBy("i")
    far = F.coalesce(F.col("i") - F.lag("i").over(order) > gap, F.lit(True))
    island = F.sum(F.when(far, 1).otherwise(0)).over(order)
    return over.withColumn("island", island).groupBy(*by, "island").agg(
        F.max_by("i", F.struct(F.abs("value"), -F.col("i"))).alias("i"), F.max(F.abs("value")).alias("peak")
    ).drop("island")


def flag_id(*parts: str) -> Column:
    """A stable id: 16 hex digits of the hash of type, target, flag and detector."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def summarize_evidence(evidence: Column, limit: int = 200) -> Column:
    """'k=v, ...' of a map's entries in key order, cut with an ellipsis."""
    entries = F.array_sort(F.transform(F.map_entries(evidence), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    text = F.array_join(entries, ", ")
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def comparison_group(region: Column, kind: Column, by_kind: bool = True) -> Column:
    """The peers it is fair to compare a channel with: of its region, rings apart from segments."""
    return F.when(kind.isNotNull() & (kind != "") & F.lit(by_kind), F.concat(region, F.lit("/"), kind)).otherwise(region)


def channels_by_role(channels: DataFrame, by: list[str], role: Column, order: str) -> DataFrame:
    """by, role, indices (ascending): the channels of each role; those without one are in no group."""
    named = channels.withColumn("role", role).where("role is not null and role <> ''")
    return named.groupBy(*by, "role").agg(F.sort_array(F.collect_list(order)).alias("indices"))
