"""Formulas against the standard library and literal values."""

import math
from fractions import Fraction
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tests.test_oracle import SF
from tidewave.operators import formulas as M
from tidewave.plans import formulas as P
from tidewave.plans.tables import table


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_normal_tail(spark):
    zs = [-40.0, -6.0, -2.5, -0.3, 0.0, 0.7, 1.96, 3.53, 3.54, 5.0, 8.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", M.normal_tail(F.col("z")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(math.erfc(r["z"] / 2**0.5) / 2, rel=1e-9, abs=1e-300)
    assert one(spark, M.flip_probability(F.lit(1.0), F.lit(0.0))) == 0.0


def test_student_tails(spark):
    # Critical values of the usual tables.
    for df, t in ((1, 12.7062), (2, 4.30265), (5, 2.570582), (30, 2.042272), (61, 1.999624)):
        assert one(spark, M.student_two_sided(F.lit(t), df)) == pytest.approx(0.05, abs=2e-6)
        assert M.student_quantile(0.05, df) == pytest.approx(t, abs=2e-4)
    assert one(spark, M.student_two_sided(F.lit(0.0), 7)) == pytest.approx(1.0)


def test_stages_multiply_to_the_factor(spark):
    got = {f: one(spark, M.decimation_stages(F.lit(f))) for f in (1, 13, 14, 26, 48, 17, 169, 1024, 34)}
    assert got == {1: [1], 13: [13], 14: [7, 2], 26: [13, 2], 48: [12, 4], 17: [17], 169: [13, 13], 1024: [8, 8, 8, 2], 34: [2, 17]}
    rows = P.decimation_stages(spark, SF).collect()
    assert len(rows) == 200 and all(r["product"] == r["p_partkey"] for r in rows)


def test_exact_ratios(spark):
    def ratio(rate, target):
        up, down = M.resample_ratio(F.lit(rate), F.lit(target))
        return one(spark, up), one(spark, down)

    for rate, target in ((48828.125, 1000.0), (1000.0, 250.0), (24414.0625, 8000.0), (512.0, 1000.0)):
        want = Fraction(target) / Fraction(rate)
        assert ratio(rate, target) == (want.numerator, want.denominator)
    assert ratio(1000.1, 250.0) == (None, None)


def test_every_part_has_its_exact_ratio(spark):
    parts = {r["p_partkey"]: Fraction(math.floor(r["p_retailprice"] * 8), 8) + r["p_size"] * 100 for r in table(spark, SF, "part").collect()}
    rows = P.exact_ratio(spark, SF).collect()
    assert {r["p_partkey"]: Fraction(r["rate"]) for r in rows} == parts
    want = {k: 1000 / rate for k, rate in parts.items()}
    assert {r["p_partkey"]: (r["up"], r["down"]) for r in rows} == {k: (w.numerator, w.denominator) for k, w in want.items()}
    assert any(w.denominator > M.MOST_DENOMINATOR for w in want.values())


def test_ratios_are_refused_only_beyond_a_limit(spark):
    both = lambda *a: tuple(one(spark, c) for c in M.resample_ratio(F.lit(1007.125), F.lit(1000.0), *a))
    assert both() == both(8056) == (None, None)
    assert both(8057) == both(None) == (8000, 8057)


def test_plans_and_shares():
    assert M.cutoff_share(None) == 0.8 and M.cutoff_share({"antialias_cutoff_fraction_of_nyquist": "0.5"}) == 0.5
    assert M.cutoff_share({"antialias_cutoff_fraction_of_nyquist": "x"}) == 0.8
    with pytest.raises(ValueError):
        M.cutoff_share({"antialias_cutoff_fraction_of_nyquist": 1.5})


def test_discs_and_fields(spark):
    point = 1e-9 / (4 * math.pi * 0.3 * 1e-3)
    assert one(spark, M.disc_mean_potential(F.lit(1e-9), F.lit(0.0), F.lit(0.0), 1.0)) == pytest.approx(point)
    # Over a disc of radius a, depth d, the mean of 1/r is 2 (sqrt(a^2 + d^2) - d) / a^2.
    want = point * 2 * (math.hypot(1.15, 1.0) - 1.0) / 1.15**2
    assert one(spark, M.disc_mean_potential(F.lit(1e-9), F.lit(0.0), F.lit(2.3), 1.0)) == pytest.approx(want, rel=1e-3)
    assert P.disc_potentials(spark, SF).where("potential > 0").count() == 200
    assert P.flip_probabilities(spark, SF).agg(F.sum("n")).first()[0] == 6000


def test_correlations_of_noise_are_rejected_at_their_level(spark):
    rows = spark.range(4000).select(F.col("id").alias("trial"), F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.xxhash64("id", i) / 2.0**63).alias("a"), F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.xxhash64("id", i + 100) / 2.0**63).alias("b"))
    r = rows.select("trial", F.explode(F.arrays_zip("a", "b")).alias("z")).groupBy("trial").agg(F.corr("z.a", "z.b").alias("r"))
    t = F.col("r") * F.sqrt(30 / (1 - F.col("r") * F.col("r")))
    share = r.select(F.avg((M.student_two_sided(t, 30) < 0.05).cast("double"))).first()[0]
    assert share == pytest.approx(0.05, abs=0.012)
    assert P.correlation_rejection(spark, SF).where("rejected between 0 and 1").count() > 0


def test_sessions_for_power():
    z = NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)
    assert z == pytest.approx(2.8016, abs=1e-3)
