"""Kernels and their operators recover what is planted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import kernels as K
from tidewave.operators import kernels as O
from tidewave.operators import spectral as S

FS = 256.0


def tone(f, n=512, fs=FS, phase=0.0):
    return np.sin(2 * np.pi * f * np.arange(n) / fs + phase)


def epochs(spark, rows):
    return spark.createDataFrame([(i, c, x.tolist()) for i, (c, x) in enumerate(rows)], "trial long, condition long, x array<double>")


def test_analytic_signal_of_a_tone_has_a_flat_envelope():
    z = K.analytic(tone(16))
    assert np.allclose(np.abs(z), 1, atol=1e-9) and np.allclose(z.real, tone(16))


def test_bandpass_keeps_the_band_without_delay():
    x = tone(20) + tone(60) + 1.0
    y = K.bandpass(x, FS, 14, 28)
    inside = slice(64, -64)
    assert np.corrcoef(y[inside], tone(20)[inside])[0, 1] > 0.995
    assert np.abs(np.fft.rfft(y[inside] * np.hanning(384)))[int(60 / FS * 384)] < 1


def test_tapers_are_orthonormal():
    t = K.slepian(64, 3, 5)
    assert np.allclose(t @ t.T, np.eye(5), atol=1e-10)


def test_multitaper_power_adds_up_to_variance():
    x = np.random.default_rng(0).normal(size=4096)
    assert K.multitaper(x, 1.0).sum() / 4096 == pytest.approx(x.var(), rel=0.1)


def test_resampling_keeps_a_slow_tone_and_a_line():
    x = tone(8, 1024) + np.linspace(0, 5, 1024)
    y = K.resample(x, 1, 4, K.kaiser_lowpass(0.45 / 4, 60, 0.1 / 4))
    assert np.abs(y - x[::4])[16:-16].max() < 0.01


def test_lowpass_has_its_stop_band():
    h = np.abs(np.fft.rfft(K.kaiser_lowpass(0.1, 60, 0.05), 4096))
    f = np.fft.rfftfreq(4096)
    assert h[f > 0.13].max() < 10 ** (-57 / 20) and abs(h[0] - 1) < 1e-9


def test_modulation_index_finds_coupling():
    t = np.arange(4096) / FS
    phase = np.angle(np.exp(2j * np.pi * 6 * t))
    assert K.modulation_index(phase, 1 + np.cos(phase)) > 0.05
    assert K.modulation_index(phase, np.ones(4096)) == pytest.approx(0, abs=1e-9)


def test_regular_run_stops_where_spacing_breaks():
    assert K.regular_run(np.array([0, 10, 20, 31, 60, 70]), 0.3).tolist() == [0, 10, 20, 31]


def test_kalman_tracks_a_step():
    y = np.concatenate([np.zeros(100), np.ones(100)])
    out = K.kalman(y, 0.1, 0.1)
    assert abs(out[99]) < 1e-6 and abs(out[-1] - 1) < 1e-6


def test_granger_points_forward():
    draw = np.random.default_rng(1)
    x = draw.normal(size=800)
    y = np.concatenate([[0], 0.8 * x[:-1]]) + 0.3 * draw.normal(size=800)
    assert K.granger(x, y, 2) > 1 > 10 * K.granger(y, x, 2)


def test_spectrum_of_a_planted_tone(spark):
    frame = epochs(spark, [(0, tone(16, 64, 128.0)), (1, tone(40, 64, 128.0))])
    peaks = S.spectral_peak(S.spectrum_by_condition(S.spectrum(frame, 128.0)), 1, 60).collect()
    assert {r["condition"]: r["peak_freq"] for r in peaks} == {0: 16.0, 1: 40.0}
    power = S.spectrum(frame, 128.0).where("condition = 0").agg(F.sum("power") * 2.0).first()[0]
    assert power == pytest.approx(0.5, rel=0.02)  # density times bin width: the tone's variance


def test_time_frequency_peaks_where_the_burst_is(spark):
    x = np.random.default_rng(2).normal(size=512) * 0.05
    x[256:320] += tone(32, 64)
    maps = O.time_frequency(epochs(spark, [(0, x)]), FS, [8.0, 16.0, 32.0, 64.0], 5.0, 4)
    best = maps.orderBy(F.desc("power")).first()
    assert best["freq"] == 32.0 and 1.0 <= best["t"] <= 1.25


def test_ringing_measures_a_damped_oscillation(spark):
    t = np.arange(256) / 2000.0
    x = np.exp(-t / 0.02) * np.sin(2 * np.pi * 250 * t)
    row = O.ringing(epochs(spark, [(0, x)]), 2000.0, 150, 400, 0.05).first()
    assert row["freq"] == pytest.approx(250, rel=0.05) and row["tau"] == pytest.approx(0.02, rel=0.25) and row["r2"] > 0.9


def test_comodulation_prefers_the_coupled_pair(spark):
    t = np.arange(2048) / FS
    x = np.sin(2 * np.pi * 6 * t) + (1 + np.sin(2 * np.pi * 6 * t)) * 0.4 * np.sin(2 * np.pi * 60 * t)
    x += 0.05 * np.random.default_rng(3).normal(size=2048)
    best = O.comodulation(epochs(spark, [(0, x)]), FS, [(4, 8), (10, 14)], [(40.0, 80.0), (90.0, 110.0)]).orderBy(F.desc("mi")).first()
    assert (best["slow"], best["fast"]) == (6.0, 60.0)


def test_odd_epochs_have_no_power(spark):
    frame = epochs(spark, [(0, np.zeros(3)), (0, np.array([np.nan] * 64)), (0, tone(16, 64, 128.0))])
    found = {r["trial"]: r["n"] for r in O.multitaper(frame, 128.0).groupBy("trial").agg(F.count("power").alias("n")).collect()}
    assert found == {0: 0, 1: 0, 2: 33}
    assert O.multitaper(frame.limit(0), 128.0).count() == 0


def test_queries_of_pairs_and_bins_reach_every_position(spark):
    from tests.test_oracle import SF
    from tidewave.plans import registry

    count = lambda name, *by: registry.QUERIES[name](spark, SF).select(*by).distinct().count()
    assert count("channel_covariance", "a", "b") == 64 * 65 // 2
    assert count("pearson_by_condition", "k") == 63
    assert count("phase_locking", "k") == 33 and count("weighted_phase_lag", "k") == 32
    assert count("tfr_morlet", "freq", "t") == 40 * 16


def test_permutation_contrast_of_all_pairs_in_chunks(spark):
    from tidewave.operators import stats

    r = np.random.default_rng(3)
    x = {c: r.normal(c == 2, 1, 300) for c in range(3)}
    rows = [(0, c, 1000 * c + i, float(v)) for c, xs in x.items() for i, v in enumerate(xs)]
    frame = spark.createDataFrame(rows, "quarter long, condition long, trial long, value double")
    got = {(g["a"], g["b"]): g for g in stats.permutation_contrast(frame, "quarter", chunk=50).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2)}
    for (a, b), g in got.items():
        both, effect = np.concatenate([x[a], x[b]]), x[b].mean() - x[a].mean()
        mixed = r.permuted(np.tile(both, (5000, 1)), axis=1)
        want = (np.abs(mixed[:, 300:].mean(axis=1) - mixed[:, :300].mean(axis=1)) >= abs(effect)).mean()
        width = 2 * 1.96 * np.sqrt(x[a].var() / 300 + x[b].var() / 300)
        assert g["effect"] == pytest.approx(effect) and g["p"] == pytest.approx(want, abs=0.03)
        assert g["hi"] - g["lo"] == pytest.approx(width, rel=0.1) and g["lo"] < effect < g["hi"]
    assert got[0, 2]["p"] == pytest.approx(1 / 5001)


def test_variance_outliers_judge_every_session_of_four_channels(spark):
    from tests.test_oracle import SF
    from tidewave.operators import quality_control as Q
    from tidewave.plans import registry
    from tidewave.plans.tables import samples

    few = {r["session"] for r in samples(spark, SF).groupBy("session").agg(F.countDistinct("channel").alias("n")).where("n < 4").collect()}
    found = registry.QUERIES["qc_variance_outlier"](spark, SF).where("flag = 'insufficient_channels'").collect()
    assert {r["session"] for r in found} == few
    rows = [(1, c, v) for c, v in zip("abcde", (1.0, 1.1, 0.9, 1.05, 9.0))] + [(2, c, 1.0) for c in "abc"]
    got = Q.group_outliers(spark.createDataFrame(rows, "session long, channel string, value double"), "value", ["session"], 3.0, 4).collect()
    assert {(r["session"], r["channel"], r["flag"]) for r in got} == {(1, "e", "outlier"), (2, None, "insufficient_channels")}


def test_welch_segments_against_plain_numpy(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(3, 1000))
    frame = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "trial long, condition long, x array<double>")
    got = S.spectrum(frame, 250.0, 200, 0.5, 5.0, 100.0).orderBy("trial", "segment", "k").toPandas()
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(200) / 200)
    want = []
    for row in x:
        for at in range(0, 801, 100):
            part = row[at : at + 200]
            z = np.fft.rfft((part - part.mean()) * window)
            want.append((np.abs(z) ** 2 * 2 / (250.0 * (window**2).sum()))[4:81])
    assert np.allclose(got["power"], np.concatenate(want)) and got["freq"].between(5, 100).all()
    assert got.groupby("trial")["segment"].nunique().eq(9).all()
    # Averaged segments keep the variance of white noise.
    whole = S.spectrum(frame, 250.0, 200).groupBy("k").agg(F.avg("power").alias("p")).agg(F.sum("p") * 1.25).first()[0]
    assert whole == pytest.approx(1.0, abs=0.15)


def test_odd_epochs_give_nulls_instead_of_vanishing(spark):
    rows = [(0, 0, [1.0, 2.0, 1.5, 0.5] * 4), (1, 0, [1.0]), (2, 0, None), (3, 0, [float("nan")] * 16), (4, 1, [0.0, 1.0] * 10)]
    frame = spark.createDataFrame(rows, "trial long, condition long, x array<double>")
    got = S.spectrum(frame, 16.0).groupBy("trial").agg(F.count(F.lit(1)).alias("n"), F.count("power").alias("bins")).collect()
    assert {r["trial"]: (r["n"], r["bins"]) for r in got} == {0: (9, 9), 1: (1, 0), 2: (1, 0), 3: (1, 0), 4: (11, 11)}
    envelope = {r["trial"]: r["envelope"] for r in O.envelope(frame, 16.0, 2.0, 4.0).collect()}
    assert [envelope[i] is None for i in range(5)] == [False, True, True, True, False] and len(envelope[4]) == 20


def test_a_regular_run_is_not_set_by_its_first_gap():
    assert K.regular_run(np.array([0, 4, 14, 24, 34, 44]), 0.3).tolist() == [0]
    assert K.regular_run(np.array([0, 10, 20, 31, 40, 47, 70]), 0.35).tolist() == [0, 10, 20, 31, 40, 47]
    assert K.regular_run(np.array([3, 9]), 0.3).tolist() == [3, 9]
