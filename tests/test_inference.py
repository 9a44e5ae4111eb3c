"""Randomisation tests and the newer kernels on planted and empty effects."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_oracle import SF
from tidewave.functions import kernels as K
from tidewave.operators import stats as T
from tidewave.plans import kernels as P

rng = np.random.default_rng(8)


def trials(spark, x, labels):
    return spark.createDataFrame([(i, int(b), v.tolist()) for i, (b, v) in enumerate(zip(labels, x, strict=True))], "trial long, label int, x array<double>").repartition(3)


def test_moments_of_the_labelling_as_it_is(spark):
    x, labels = rng.normal(size=(90, 5)), rng.integers(0, 2, 90)
    m = T.relabelled_moments(trials(spark, x, labels), 20, chunk=16).withColumn("tv", T.two_sample_t()).toPandas()
    seen = m[m["draw"] == 0].sort_values("t")["tv"].to_numpy()
    a, b = x[labels == 1], x[labels == 0]
    pooled = np.sqrt(((len(a) - 1) * a.var(0, ddof=1) + (len(b) - 1) * b.var(0, ddof=1)) / 88)
    assert np.allclose(seen, (a.mean(0) - b.mean(0)) / (pooled * np.sqrt(1 / len(a) + 1 / len(b))))
    assert m.groupby("draw")["n1"].nunique().eq(1).all() and m["n1"].nunique() == 1 and m["draw"].nunique() == 21


def test_a_planted_cluster_is_found_where_it_is(spark):
    x, labels = rng.normal(size=(80, 40)), np.arange(80) % 2
    x[labels == 1, 12:20] += 1.5
    x[labels == 0, 30:36] += 1.5
    found = T.cluster_test(trials(spark, x, labels), draws=99, chunk=20).toPandas()
    strong = found[found["p"] <= 0.02].sort_values("first")
    assert strong["sign"].tolist() == [1, -1]
    assert abs(strong["first"] - [12, 30]).max() <= 1 and abs(strong["last"] - [19, 35]).max() <= 1
    nothing = T.cluster_test(trials(spark, rng.normal(size=(80, 40)), labels), draws=99, chunk=20)
    assert nothing.where("p <= 0.01").count() == 0
    assert T.cluster_test(trials(spark, x, labels).limit(0)).count() == 0


def test_samples_are_no_unit(spark):
    # Trials differ by chance alone, but their samples stick together.
    labels, level = np.arange(40) % 2, rng.normal(size=40)
    for k in (0, 1):
        level[labels == k] += 0.35 * k - level[labels == k].mean()
    levels = level[:, None] + 0.1 * rng.normal(size=(40, 30))
    p = {r["unit"]: r["p"] for r in T.shuffle_units(trials(spark, levels, labels), draws=199).collect()}
    assert p["samples"] == pytest.approx(1 / 200) and p["trials"] > 0.02


def test_pair_flips(spark):
    rows = [("a", i, 0.5 + float(v)) for i, v in enumerate(rng.normal(size=200))] + [("b", i, float(v)) for i, v in enumerate(rng.normal(size=200) * 0.01 * np.array([1, -1] * 100))]
    got = {r["g"]: r for r in T.pair_flip_test(spark.createDataFrame(rows, "g string, pair long, d double"), ["g"]).collect()}
    assert got["a"]["p"] == pytest.approx(1 / 300) and got["b"]["p"] > 0.01 and got["a"]["n"] == 200


def test_filters():
    x = rng.normal(size=(4, 100))
    b, a = np.array([0.3, 0.2, 0.1]), np.array([2.0, -0.5, 0.2])
    y = np.zeros_like(x)
    for i in range(100):
        for k in range(3):
            y[:, i] += (b[k] * x[:, i - k] if i >= k else 0) - (a[k] * y[:, i - k] if k and i >= k else 0)
        y[:, i] /= 2.0
    assert np.allclose(K.iir(x, b, a), y)
    assert np.allclose(K.iir(x, np.array([2.0]), np.array([4.0])), x / 2)
    pulse = np.zeros((1, 101))
    pulse[0, 50] = 1.0
    both = K.zero_phase(pulse, np.array([0.2]), np.array([1.0, -0.8]))
    assert both.argmax() == 50 and np.allclose(both[0, 45:56], both[0, 45:56][::-1], atol=1e-6)
    t = np.arange(2000) / 1000
    low, high = K.split_at(np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 200 * t), 1000.0, 50.0)
    assert np.allclose(low[200:-200], np.sin(2 * np.pi * 5 * t)[200:-200], atol=1e-3) and np.allclose(high[200:-200], np.sin(2 * np.pi * 200 * t)[200:-200], atol=1e-3)


def test_delays_leakage_and_smoothing():
    x = rng.normal(size=(3, 200))
    assert K.delay(x, np.roll(x, 7, axis=1)).tolist() == [7, 7, 7] and K.delay(x, np.roll(x, -4, axis=1)).tolist() == [-4] * 3
    odd = np.sin(2 * np.pi * 10.5 * np.arange(256) / 256)[None]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    assert K.leakage_db(odd, window)[0] < K.leakage_db(odd)[0] - 20
    k = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    assert np.allclose(K.gaussian_smooth(x, 2.0), [np.convolve(v, k / k.sum(), "same") for v in x]) and K.gaussian_smooth(x, 0) is x


def test_conditional_causality_sees_through_a_common_driver():
    n = 4000
    z, e = rng.normal(size=n), rng.normal(size=(2, n)) * 0.1
    x, y = np.roll(z, 1) + e[0], np.roll(z, 2) + e[1]
    assert K.granger(x, y, 3) > 1 and K.granger_given(x, y, z, 3) < 0.02


def test_surrogates_tell_coupling_from_none():
    t = np.arange(10_000) / 500
    slow = np.sin(2 * np.pi * 8 * t)
    coupled = slow + 0.6 * (1 + slow) / 2 * np.sin(2 * np.pi * 80 * t) + 0.1 * rng.normal(size=len(t))
    plain = slow + 0.3 * np.sin(2 * np.pi * 80 * t) + 0.1 * rng.normal(size=len(t))
    z = []
    for x in (coupled, plain):
        phase, size = np.angle(K.analytic(K.bandpass(x, 500, 6, 10))), np.abs(K.analytic(K.bandpass(x, 500, 65, 95)))
        # A shift by whole slow cycles keeps the coupling, so the phase is given some drift.
        phase = np.angle(np.exp(1j * (phase)))
        z.append(K.modulation_index(phase, size, 18))
    assert z[0] > 20 * z[1]
    noise = rng.normal(size=(2, 4000))
    assert abs(K.surrogate_z(np.angle(K.analytic(noise[0])), np.abs(noise[1]), 9, 60, np.random.default_rng(0))) < 4


def test_peaks_over_an_aperiodic_line():
    f = np.arange(2.0, 80.5, 0.5)
    power = 10**1.0 / f**1.5 * 10 ** (0.8 * np.exp(-((f - 20) ** 2) / 8) + 0.5 * np.exp(-((f - 50) ** 2) / 18))
    offset, exponent, peaks = K.fit_spectrum(f, power)
    assert exponent == pytest.approx(1.5, abs=0.1) and offset == pytest.approx(1.0, abs=0.15)
    assert sorted(round(p[0]) for p in peaks)[:2] == [20, 50] and peaks[0][1] == pytest.approx(0.8, abs=0.1)
    assert K.fit_spectrum(f, 10 / f)[2] == []


def test_queries_cover_their_tables(spark):
    assert P.iir_filters(spark, SF).where("both is not null").count() == 500 and P.band_split(spark, SF).where("low >= 0 and high >= 0").count() == 500
    assert P.leakage_floor(spark, SF).where("hann is not null").count() == 500 and P.granger_conditional(spark, SF).count() == 500
    assert P.pac_surrogate(spark, SF).agg(F.sum("n")).first()[0] > 0 and P.fit_spectrum(spark, SF).where("exponent is not null").count() > 0
    assert P.pair_flip(spark, SF).where("p between 0 and 1").count() > 0 and P.shuffle_units(spark, SF).count() == 2
    assert P.cluster_test(spark, SF).where("p between 0 and 1").count() >= 0
