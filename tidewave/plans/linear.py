"""Queries of covariance, components, inverse problems and decoding over epochs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.operators import linear as L
from tidewave.plans.spectral import r6
from tidewave.plans.tables import EPOCHS_SQL, epochs

ALPHA, RIDGE, FOLDS = 0.1, 0.5, 5
#: Electrodes on a line every millimetre, sources 2 mm below every 16th of them.
ELECTRODES, SOURCES, DEPTH, SIGMA = 64, 4, 2.0, 0.3


def _by_condition(spark, sf_dir):
    return L.moments(epochs(spark, sf_dir), ["condition"])


def shrunk_covariance(spark, sf_dir):
    return L.covariances(_by_condition(spark, sf_dir), ["condition"], ALPHA).select("condition", "a", "b", *r6("cov"))


def covariance_summary(spark, sf_dir):
    out = L.summary_of(_by_condition(spark, sf_dir), ["condition"])
    return out.select("condition", *r6("condition_number", "common_mode", "participation", "pc1", "pc1_correlation"))


def common_mode_fraction(spark, sf_dir):
    return L.summary_of(_by_condition(spark, sf_dir), ["condition"]).select("condition", *r6("common_mode"))


def eigen_spectrum(spark, sf_dir):
    return L.spectrum_of(_by_condition(spark, sf_dir), ["condition"]).select("condition", "k", *r6("eigenvalue", "explained"))


def pca_scores(spark, sf_dir):
    """Every epoch on the first three principal directions of its condition."""
    axes = L.directions(_by_condition(spark, sf_dir), ["condition"], 3)
    both = epochs(spark, sf_dir).join(axes, "condition").withColumn("x", F.zip_with("x", "mean", lambda v, m: v - m))
    scores = F.transform("axes", lambda axis: F.aggregate(F.zip_with("x", axis, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    each = both.select("trial", "condition", F.posexplode(scores).alias("k", "score"))
    return each.select("trial", "condition", F.col("k").cast("long").alias("k"), *r6("score"))


def ged_ratios(spark, sf_dir):
    """How much more each condition varies than the others, by direction."""
    return L.against_rest(_by_condition(spark, sf_dir), "condition").select("condition", "k", *r6("ratio"))


def rayleigh_quotient(spark, sf_dir):
    """Variance of the plain mean of an epoch, for every pair of conditions."""
    means = epochs(spark, sf_dir).select("condition", (F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")).alias("m"))
    v = means.groupBy("condition").agg(F.var_samp("m").alias("v"))
    a, b = v.toDF("a", "va"), v.toDF("b", "vb")
    pairs = a.join(b, F.col("a") < F.col("b"))
    return pairs.select("a", "b", (F.round(F.col("va") / F.col("vb"), 6) + 0.0).alias("quotient"))


def leadfield_matrix() -> np.ndarray:
    """Potential at each electrode of a unit current in each source: 1 / (4 pi sigma r)."""
    along = np.arange(ELECTRODES)[:, None] - (np.arange(SOURCES)[None, :] * 16 + 8)
    return 1 / (4 * np.pi * SIGMA * np.sqrt(along**2 + DEPTH**2))


def tikhonov_sources(spark, sf_dir):
    """Source currents of every epoch, taken as potentials at 64 electrodes."""
    s = L.apply_matrix(F.col("x"), L.inverse_operator(leadfield_matrix(), RIDGE))
    each = epochs(spark, sf_dir).select("trial", F.posexplode(s).alias("source", "current"))
    return each.select("trial", F.col("source").cast("long").alias("source"), *r6("current"))


def mixing_misfit(spark, sf_dir):
    """How far the covariance that the estimated sources imply is from the measured one, by condition."""
    m = leadfield_matrix()
    inverse = L.inverse_operator(m, RIDGE)

    def one(s):
        c = L.covariance(s)
        found = inverse @ c @ inverse.T
        noise = max(0.0, float(np.trace(c - m @ found @ m.T)) / len(c))
        implied = L.mixed_covariance(m, np.diag(found), noise)
        return [{"misfit": float(np.linalg.norm(c - implied) / np.linalg.norm(c)), "noise": noise}]

    return L.per_group(_by_condition(spark, sf_dir), ["condition"], "misfit double, noise double", one).select("condition", *r6("misfit", "noise"))


def _decoding(spark, sf_dir, folds, guard):
    """Epochs without their last sample as features, the last sample as what to predict."""
    return epochs(spark, sf_dir).select("trial", "x", folds.cast("long").alias("fold")).withColumn("guard", guard)


def _random(spark, sf_dir):
    return _decoding(spark, sf_dir, F.pmod(F.xxhash64("trial"), F.lit(FOLDS)), F.array("fold"))


def _blocked(spark, sf_dir, embargo=10):
    """Folds of neighbouring trials; a row within the embargo of a fold doesn't teach it."""
    span = epochs(spark, sf_dir).agg(F.min("trial").alias("lo"), F.max("trial").alias("hi"))
    rows = epochs(spark, sf_dir).join(span)
    place = lambda t: F.floor((t - F.col("lo")) * FOLDS / (F.col("hi") - F.col("lo") + 1)).cast("long")
    near = F.array_distinct(F.array(place(F.greatest(F.col("trial") - embargo, "lo")), place(F.col("trial")), place(F.least(F.col("trial") + embargo, "hi"))))
    return rows.select("trial", "x", place(F.col("trial")).alias("fold"), near.alias("guard"))


def _score(predictions, by):
    off = F.sum((F.col("y") - F.col("predicted")) * (F.col("y") - F.col("predicted")))
    return predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (1 - off / (F.var_pop("y") * F.count("y"))).alias("r2"))


def cross_val_random(spark, sf_dir):
    return _score(L.cross_predictions(_random(spark, sf_dir), RIDGE), ["fold"]).select("fold", "n", *r6("r2"))


def cross_val_blocked(spark, sf_dir):
    return _score(L.cross_predictions(_blocked(spark, sf_dir), RIDGE), ["fold"]).select("fold", "n", *r6("r2"))


def decoder_patterns(spark, sf_dir):
    """Weights of each fold's decoder beside the pattern they read (covariance times weights)."""
    models = L.fit_folds(_random(spark, sf_dir), RIDGE)
    each = models.select("fold", F.posexplode(F.arrays_zip("weights", "pattern")).alias("j", "z"))
    return each.select("fold", F.col("j").cast("long").alias("j"), (F.round("z.weights", 6) + 0.0).alias("weight"), (F.round("z.pattern", 6) + 0.0).alias("pattern"))


def bootstrap_weights(spark, sf_dir):
    return L.bootstrap_spread(epochs(spark, sf_dir), RIDGE, 50).select("j", *r6("mean", "sd"))


def network_decoding(spark, sf_dir):
    """A tanh layer of eight units on what the ridge decoder sees: each fold is scored by the network that never saw it."""
    found, _ = L.cross_val_network(_random(spark, sf_dir), FOLDS, 8, 15, 0.05)
    return _score(found, ["fold"]).select("fold", "n", *r6("r2"))


def block_effective_size(spark, sf_dir):
    """By condition: the variance of single epochs' means over that of means of ten in a row."""
    m = epochs(spark, sf_dir).select("condition", "trial", (F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")).alias("m"))
    at = m.withColumn("block", F.floor((F.row_number().over(W.partitionBy("condition").orderBy("trial")) - 1) / 10).cast("long"))
    sized = at.withColumn("whole", F.count(F.lit(1)).over(W.partitionBy("condition", "block")) == 10)
    blocks = sized.where("whole").groupBy("condition", "block").agg(F.avg("m").alias("b")).groupBy("condition").agg(F.var_pop("b").alias("vb"), F.count(F.lit(1)).alias("blocks"))
    single = m.groupBy("condition").agg(F.var_pop("m").alias("v"))
    return single.join(blocks, "condition").select("condition", "blocks", (F.round(F.try_divide("v", "vb"), 6) + 0.0).alias("n_eff"))


QUERIES = {
    f.__name__: f
    for f in (
        shrunk_covariance, covariance_summary, common_mode_fraction, eigen_spectrum, pca_scores, ged_ratios, rayleigh_quotient, tikhonov_sources,
        mixing_misfit, cross_val_random, cross_val_blocked, decoder_patterns, bootstrap_weights, network_decoding, block_effective_size,
    )
}

_COV = f"""with {EPOCHS_SQL}, cov as (
  select x.condition, x.t as a, y.t as b, covar_samp(x.value, y.value) as c from long_epochs x join long_epochs y on x.trial = y.trial group by 1, 2, 3
), scale as (select condition, sum(c) filter (where a = b) / 64 as mean_var from cov group by 1)
"""
_M = L.inverse_operator(leadfield_matrix(), RIDGE)
ORACLES = {
    "shrunk_covariance": _COV + f"""select condition, a::bigint as a, b::bigint as b, round({1 - ALPHA} * c + case when a = b then {ALPHA} * mean_var else 0 end, 6) + 0.0 as cov
      from cov join scale using (condition) where a <= b""",
    "common_mode_fraction": _COV + "select condition, round(sum(c) / 64 / sum(c) filter (where a = b), 6) + 0.0 as common_mode from cov group by 1",
    "rayleigh_quotient": f"""with {EPOCHS_SQL}, v as (select condition, var_samp(list_avg(x)) as v from epochs group by 1)
      select x.condition as a, y.condition as b, round(x.v / y.v, 6) + 0.0 as quotient from v x join v y on x.condition < y.condition""",
    "tikhonov_sources": f"with {EPOCHS_SQL}, m as (select * from (values "
    + ", ".join(f"({i}, {[float(v) for v in row]}::double[])" for i, row in enumerate(_M))
    + ") q(source, row_)) select trial, source::bigint as source, round(list_inner_product(x, row_), 6) + 0.0 as current from epochs, m",
    "block_effective_size": f"""with {EPOCHS_SQL}, m as (select condition, trial, list_avg(x) as m from epochs),
      n as (select *, (row_number() over (partition by condition order by trial) - 1) // 10 as block from m),
      b as (select condition, block, avg(m) as b from n group by 1, 2 having count(*) = 10)
      select s.condition, blocks, round(v / vb, 6) + 0.0 as n_eff from (select condition, var_pop(m) as v from m group by 1) s
      join (select condition, var_pop(b) as vb, count(*) as blocks from b group by 1) using (condition)""",
}
