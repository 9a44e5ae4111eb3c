"""Contrasts, multiple testing, clusters and resampling."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.operators.formulas import student_quantile


def pairwise_contrasts(values: DataFrame, by: list[str]) -> DataFrame:
    """by, a, b, n_a, n_b, effect: mean of b less mean of a for every pair of conditions.

    Means come first, so the self-join pairs conditions, never observations.
    """
    means = values.groupBy(*by, "condition").agg(F.count("value").alias("n"), F.avg("value").alias("m"))
    left = means.select(*by, F.col("condition").alias("a"), F.col("n").alias("n_a"), F.col("m").alias("m_a"))
    right = means.select(*by, F.col("condition").alias("b"), F.col("n").alias("n_b"), F.col("m").alias("m_b"))
    # Without groups there is one row per condition on either side.
    pairs = left.join(right, by) if by else left.join(right, F.col("a") < F.col("b"))
    return pairs.where("a < b").select(*by, "a", "b", "n_a", "n_b", (F.col("m_b") - F.col("m_a")).alias("effect"))


def benjamini_hochberg(tests: DataFrame, alpha: float, by: list[str]) -> DataFrame:
    """rank, threshold and rejected of every p: the step-up procedure within each family."""
    family, order = W.partitionBy(*by), W.partitionBy(*by).orderBy("p")
    ranked = tests.withColumns({"rank": F.row_number().over(order).cast("long"), "m": F.count(F.lit(1)).over(family)})
    limit = ranked.withColumn("threshold", F.col("rank") * alpha / F.col("m"))
    last = F.max(F.when(F.col("p") <= F.col("threshold"), F.col("p"))).over(family)
    return limit.withColumn("rejected", F.coalesce(F.col("p") <= last, F.lit(False))).drop("m")


def runs(rows: DataFrame, by: list[str], order: str, flag: Column) -> DataFrame:
    """Flagged rows with the number of their run: gaps and islands over consecutive ``order``."""
    inside = rows.where(flag)
    island = F.col(order) - F.row_number().over(W.partitionBy(*by).orderBy(order))
    return inside.withColumn("island", island)


def cluster_masses(t_map: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """by, sign, first, last, mass: runs of |t| above a threshold, of one sign, and the sum of |t|."""
    signed = t_map.withColumn("sign", F.signum("t_value").cast("long"))
    flagged = runs(signed, [*by, "sign"], "t", F.abs("t_value") > threshold)
    return flagged.groupBy(*by, "sign", "island").agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.sum(F.abs("t_value")).alias("mass")
    ).drop("island")


def t_map(values: DataFrame, by: list[str]) -> DataFrame:
    """by, t, t_value: one-sample t of every point over trials; null without spread."""
    out = values.groupBy(*by, "t").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("value").alias("n"))
    return out.select(*by, "t", F.try_divide("m", F.col("s") / F.sqrt("n")).alias("t_value"))


def _seed(*key) -> int:
    return zlib.crc32("|".join(map(str, key)).encode())


def permutation_contrast(values: DataFrame, group: str, draws: int = 5000, boots: int = 2000, chunk: int = 2048) -> DataFrame:
    """group, a, b, effect, p, lo, hi: label permutation and percentile bootstrap of mean b less mean a, for every pair.

    Trials are dealt by hash into chunks of about ``chunk`` values. A draw's labels (or its
    draws with replacement) are first split over the chunks by the multivariate hypergeometric
    (multinomial) law, then dealt inside each chunk, which gives exactly a permutation (a
    bootstrap sample) of all; sums of the chunks add up. A task holds chunks and blocks of
    draws, never a comparison. Draws are seeded by names and chunk, so results don't depend on
    partitions. Null and NaN values are left out.
    """
    kept = values.where("value is not null and not isnan(value)").select(F.col(group).alias("key"), "condition", "trial", "value")
    key, label = (dict(kept.dtypes)[c] for c in ("key", "condition"))
    most = kept.groupBy("key", "condition").count().agg(F.max("count")).first()[0] or 0
    chunks = max(1, -(-most // chunk))
    block = max(10, min(1000, 1_000_000 // chunks))
    dealt = F.pmod(F.xxhash64("trial"), F.lit(chunks)).cast("int").alias("chunk")
    parts = kept.groupBy("key", "condition", dealt).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("trial", "value"))), lambda r: r["value"].cast("double")).alias("xs")
    )
    sizes = parts.groupBy("key", "condition").agg(
        F.sum(F.size("xs")).alias("n"), F.sum(F.aggregate("xs", F.lit(0.0), lambda x, y: x + y)).alias("total"),
        F.collect_list(F.struct("chunk", F.size("xs").alias("n"))).alias("held"),
    )

    def counts(held) -> np.ndarray:
        out = np.zeros(chunks, np.int64)
        for x in held:
            out[x["chunk"]] += x["n"]
        return out

    def blocks(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(-(-n // block) - 1))).alias("block")

    def shares(names: list[str], n: int, split):
        """How many values each chunk gives to each draw of a block."""

        def run(batches):
            for rows in batches:
                for row in rows.to_dict("records"):
                    size = min(block, n - block * row["block"])
                    draw = np.random.default_rng([_seed(*[row[c] for c in names]), row["block"]])
                    held = counts(row["held"])
                    take = split(draw, held, row, size)
                    full = np.flatnonzero(held)
                    yield pd.DataFrame({**{c: [row[c]] * len(full) for c in [*names, "block"]}, "chunk": full, "take": [take[:, c] for c in full]})

        return run

    def sums(names: list[str], pick):
        """Each draw's sum over the values that a chunk gives."""

        def run(batches):
            for rows in batches:
                for row in rows.to_dict("records"):
                    draw = np.random.default_rng([_seed(*[row[c] for c in names]), row["block"], row["chunk"]])
                    take, xs = np.asarray(row["take"], np.int64), np.asarray(row["xs"], float)
                    found = [pick(draw, xs, take[i : i + 100]) for i in range(0, len(take), 100)]
                    yield pd.DataFrame({**{c: [row[c]] for c in [*names, "block"]}, "sums": [np.concatenate(found)]})

        return run

    def permuted(draw, xs, take):
        mixed = draw.permuted(np.tile(xs, (len(take), 1)), axis=1)
        upto = np.concatenate([np.zeros((len(take), 1)), np.cumsum(mixed, axis=1)], axis=1)
        return upto[np.arange(len(take)), take]

    def resampled(draw, xs, take):
        return np.array([xs[draw.integers(0, len(xs), k)].sum() for k in take])

    def added(found: DataFrame, names: list[str]) -> DataFrame:
        return found.select(*names, "block", F.posexplode("sums").alias("i", "s")).groupBy(*names, "block", "i").agg(F.sum("s").alias("s"))

    # Permutations of every pair's labels.
    left, right = (sizes.select("key", F.col("condition").alias(c), F.col("n").alias(f"n_{c}"), F.col("total").alias(f"total_{c}"), F.col("held").alias(f"held_{c}")) for c in "ab")
    pairs = left.join(right, "key").where("a < b")
    asked = pairs.select("key", "a", "b", "n_a", F.concat("held_a", "held_b").alias("held"), blocks(draws)).repartition("key", "a", "b", "block")
    names = ["key", "a", "b"]
    took = asked.mapInPandas(
        shares(names, draws, lambda draw, held, row, size: draw.multivariate_hypergeometric(held, row["n_a"], size, method="marginals")),
        f"key {key}, a {label}, b {label}, block int, chunk int, take array<long>",
    )
    xa, xb = (parts.select("key", F.col("condition").alias(c), "chunk", F.col("xs").alias(f"x_{c}")) for c in "ab")
    none = F.array().cast("array<double>")
    both = took.join(xa, ["key", "a", "chunk"], "left").join(xb, ["key", "b", "chunk"], "left").select(
        *names, "block", "chunk", "take", F.concat(F.coalesce("x_a", none), F.coalesce("x_b", none)).alias("xs")
    ).repartition(*names, "block", "chunk")
    drawn = added(both.mapInPandas(sums(names, permuted), f"key {key}, a {label}, b {label}, block int, sums array<double>"), names)
    flat = pairs.select(*names, "n_a", "n_b", "total_a", "total_b", (F.col("total_b") / F.col("n_b") - F.col("total_a") / F.col("n_a")).alias("effect"))
    mixed = (F.col("total_a") + F.col("total_b") - F.col("s")) / F.col("n_b") - F.col("s") / F.col("n_a")
    tested = drawn.join(flat, names).groupBy(*names, "effect").agg(
        ((F.count_if(F.abs(mixed) >= F.abs("effect") - 1e-12) + 1) / (draws + 1)).alias("p")
    )

    # Bootstrap means of every condition; those of a pair are independent.
    own = ["key", "condition"]
    took = sizes.select(*own, "n", "held", blocks(boots)).repartition(*own, "block").mapInPandas(
        shares(own, boots, lambda draw, held, row, size: draw.multinomial(row["n"], held / held.sum(), size)),
        f"key {key}, condition {label}, block int, chunk int, take array<long>",
    )
    again = took.join(parts, [*own, "chunk"]).repartition(*own, "block", "chunk")
    means = added(again.mapInPandas(sums(own, resampled), f"key {key}, condition {label}, block int, sums array<double>"), own)
    means = means.join(sizes.select(*own, "n"), own).select(*own, "block", "i", (F.col("s") / F.col("n")).alias("m"))
    x, y = (means.select("key", F.col("condition").alias(c), "block", "i", F.col("m").alias(f"m_{c}")) for c in "ab")
    apart = x.join(y, ["key", "block", "i"]).where("a < b").groupBy(*names).agg(
        *[F.percentile(F.col("m_b") - F.col("m_a"), F.lit(q)).alias(c) for c, q in (("lo", 0.025), ("hi", 0.975))]
    )
    return tested.join(apart, names).withColumnRenamed("key", group)


def tested_contrast(values: DataFrame, group: str, draws: int = 5000, boots: int = 2000, least: int = 5) -> DataFrame:
    """permutation_contrast of the conditions that have at least ``least`` usable values in a group."""
    usable = values.where("value is not null and not isnan(value)")
    enough = usable.groupBy(group, "condition").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")
    return permutation_contrast(usable.join(enough, [group, "condition"]), group, draws, boots)


# --- randomisation of whole trials ------------------------------------------------------


def _relabelled(batch_x: np.ndarray, labels: np.ndarray, draw: np.random.Generator, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of squares over the trials labelled 1: first as they are, then under each relabelling."""
    masks = np.empty((draws + 1, len(labels)))
    masks[0] = labels
    masks[1:] = draw.permuted(np.tile(labels, (draws, 1)), axis=1)
    return masks @ batch_x, masks @ (batch_x * batch_x)


def relabelled_moments(trials: DataFrame, draws: int, chunk: int = 512, seed: int = 0) -> DataFrame:
    """draw, sums, squares, n1, total, total_squares, n: what a two-sample statistic needs, per relabelling.

    trials: trial, label (0 or 1), x. Draw 0 is the labelling as it is. Labels are permuted
    within chunks of trials that a hash deals: a subgroup of all permutations, under which
    the test stays exact, while no task holds more than a chunk. Sums of chunks add up.
    """
    fine = trials.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    chunks = max(1, -(-fine.count() // chunk))
    dealt = fine.withColumn("chunk", F.pmod(F.xxhash64("trial"), F.lit(chunks)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("trial", kind="stable")
        x, labels = np.stack(rows["x"].to_list()), rows["label"].to_numpy(float)
        draw = np.random.default_rng([seed, int(rows["chunk"].iloc[0])])
        sums, squares = _relabelled(x, labels, draw, draws)
        times = x.shape[1]
        total, total_squares = x.sum(axis=0), (x * x).sum(axis=0)
        return pd.DataFrame(
            {
                "draw": np.repeat(np.arange(draws + 1), times), "t": np.tile(np.arange(times), draws + 1), "s": sums.ravel(), "q": squares.ravel(),
                "total": np.tile(total, draws + 1), "total_q": np.tile(total_squares, draws + 1), "n1": labels.sum(), "n": float(len(x)),
            }
        )

    names = ("s", "q", "total", "total_q", "n1", "n")
    parts = dealt.groupBy("chunk").applyInPandas(run, "draw long, t long, " + ", ".join(f"{c} double" for c in names))
    return parts.groupBy("draw", "t").agg(*[F.sum(c).alias(c) for c in names])


def two_sample_t() -> Column:
    """Pooled t of label 1 less label 0, from relabelled_moments."""
    n0, m1, m0 = F.col("n") - F.col("n1"), F.col("s") / F.col("n1"), (F.col("total") - F.col("s")) / (F.col("n") - F.col("n1"))
    v1 = (F.col("q") - F.col("n1") * m1 * m1) / (F.col("n1") - 1)
    v0 = (F.col("total_q") - F.col("q") - n0 * m0 * m0) / (n0 - 1)
    pooled = F.sqrt(((F.col("n1") - 1) * v1 + (n0 - 1) * v0) / (F.col("n") - 2))
    return F.try_divide(m1 - m0, pooled * F.sqrt(1 / F.col("n1") + 1 / n0))


def cluster_test(trials: DataFrame, draws: int = 199, alpha: float = 0.05, chunk: int = 512, seed: int = 0) -> DataFrame:
    """sign, first, last, mass, p of every cluster of times where the labels differ.

    A cluster is a run of |t| above the two-sided critical value, of one sign; its p is the
    share of relabellings whose largest run weighs as much, its own labelling among them.
    """
    moments = relabelled_moments(trials, draws, chunk, seed).withColumn("t_value", two_sample_t())
    one = moments.first()
    if one is None:
        return trials.sparkSession.createDataFrame([], "sign long, first long, last long, mass double, p double")
    threshold = student_quantile(alpha, int(one["n"]) - 2)
    masses = cluster_masses(moments, ["draw"], threshold)
    # In the null, runs are of |t|, whatever their signs: the largest of them is no smaller than that of one sign.
    flagged = runs(moments, ["draw"], "t", F.abs("t_value") > threshold)
    largest = flagged.groupBy("draw", "island").agg(F.sum(F.abs("t_value")).alias("mass")).groupBy("draw").agg(F.max("mass").alias("top"))
    null = largest.where("draw > 0").agg(F.sort_array(F.collect_list("top")).alias("null"))  # at most one number per draw
    seen = masses.where("draw = 0").join(null)
    above = F.size(F.filter("null", lambda m: m >= F.col("mass") - 1e-12))
    return seen.select("sign", "first", "last", "mass", ((above + 1) / (draws + 1)).alias("p"))


def pair_flip_test(pairs: DataFrame, by: list[str], draws: int = 299, seed: int = 0) -> DataFrame:
    """by, n, mean, p of paired differences (pair, d): signs are flipped at random.

    A sign follows from the pair's number and the draw alone; tasks add up flipped sums.
    """
    sign = lambda k: F.when(F.pmod(F.xxhash64(F.col("pair"), k, F.lit(seed)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    flips = pairs.where("d is not null").select(*by, "d", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(draws)), sign)).alias("k", "s"))
    sums = flips.groupBy(*by, "k").agg(F.avg(F.col("d") * F.col("s")).alias("m"), F.avg("d").alias("seen"), F.count("d").alias("n"))
    out = sums.groupBy(*by).agg(F.first("n").alias("n"), F.first("seen").alias("mean"), F.count_if(F.abs("m") >= F.abs("seen") - 1e-12).alias("above"))
    return out.select(*by, "n", "mean", ((F.col("above") + 1) / (draws + 1)).alias("p"))


def shuffle_units(trials: DataFrame, draws: int = 199, chunk: int = 512, seed: int = 0) -> DataFrame:
    """unit, effect, p: labels shuffled over trials' means, and (wrongly, for comparison) over single samples."""
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")
    right = trials.select("trial", "label", F.array(mean).alias("x"))
    wrong = trials.select("trial", "label", F.posexplode("x").alias("i", "v")).select(F.xxhash64("trial", "i").alias("trial"), "label", F.array("v").alias("x"))
    out = None
    for unit, rows, size in (("trials", right, chunk), ("samples", wrong, chunk * 16)):
        m = relabelled_moments(rows, draws, size, seed).withColumn("effect", F.col("s") / F.col("n1") - (F.col("total") - F.col("s")) / (F.col("n") - F.col("n1")))
        told = m.agg(
            F.max(F.when(F.col("draw") == 0, F.abs("effect"))).alias("seen"), F.max_by("effect", -F.col("draw")).alias("effect"),
            F.collect_list(F.when(F.col("draw") > 0, F.abs("effect"))).alias("null"),
        )
        above = F.size(F.filter("null", lambda v: v >= F.col("seen") - 1e-12))
        part = told.select(F.lit(unit).alias("unit"), "effect", ((above + 1) / (draws + 1)).alias("p"))
        out = part if out is None else out.union(part)
    return out
