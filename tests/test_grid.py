"""Chunk grids, rate changes and spectra: the same whatever the chunking, and as one pass over the whole signal."""

import numpy as np
import pytest

from tidewave.functions import filters as K
from tidewave.operators import grid as G


def cut_up(spark, signals, sizes, seed=0):
    """Chunks of drawn sizes, in drawn order."""
    draw, rows = np.random.default_rng(seed), []
    for name, x in signals.items():
        at = 0
        while at < len(x):
            n = int(draw.choice(sizes))
            rows.append((name, at, x[at : at + n].tolist()))
            at += n
    draw.shuffle(rows)
    return spark.createDataFrame([(str(a), int(b), c) for a, b, c in rows], "series string, t0_idx long, x array<double>").repartition(3)


def together(rows, t0="t0_idx", x="x"):
    out = {}
    for r in sorted(rows, key=lambda r: (r["series"], r[t0])):
        parts = out.setdefault(r["series"], [])
        assert r[t0] == sum(map(len, parts))
        parts.append(r[x])
    return {k: np.concatenate(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def signals():
    draw = np.random.default_rng(1)
    return {"a": np.cumsum(draw.normal(size=5000)), "b": draw.normal(size=1777) + 3, "c": draw.normal(size=300), "d": np.array([2.0])}


@pytest.mark.parametrize("sizes", [[1, 7, 500], [4096], [64]])
def test_windows_with_halos_hold_what_the_signal_holds(spark, signals, sizes):
    windows = G.grid_windows(cut_up(spark, signals, sizes), ["series"], 256, 40, 25).collect()
    assert len(windows) == sum(-(-len(x) // 256) for x in signals.values())
    for w in windows:
        x, k = signals[w["series"]], w["k"]
        lo, hi = max(0, k * 256 - 40), min(len(x), (k + 1) * 256 + 25)
        assert (w["at"], w["first"], w["last"]) == (lo, k * 256, min(len(x), (k + 1) * 256)) and w["x"] == x[lo:hi].tolist()


def test_gaps_and_doubled_samples_leave_a_window_empty(spark):
    rows = [("gap", 0, [1.0] * 10), ("gap", 12, [1.0] * 20), ("twice", 0, [1.0] * 20), ("twice", 15, [1.0] * 5), ("none", 0, [])]
    frame = spark.createDataFrame(rows, "series string, t0_idx long, x array<double>")
    got = {(r["series"], r["k"]): r["x"] for r in G.grid_windows(frame, ["series"], 16).collect()}
    assert got == {("gap", 0): None, ("gap", 1): [1.0] * 16, ("twice", 0): None, ("twice", 1): None}


@pytest.mark.parametrize(("up", "down"), [(2, 3), (3, 2), (1, 4), (512, 3125)])
def test_resampling_chunks_equals_one_pass(spark, signals, up, down):
    taps = K.antialias(up, down, 1000.0)[0] if up < 100 else K.antialias(up, down, 48828.125, K.FilterSpec(attenuation_db=60.0, alias_floor_db=-50.0, passband=0.4))[0]
    want = {k: K.resample_part(x, 0, 0, len(x), len(x), (x[0], x[-1]), up, down, taps) for k, x in signals.items()}
    for width, sizes in ((512, [100, 33]), (1 << 16, [999])):
        got = together(G.resample(cut_up(spark, signals, sizes), ["series"], up, down, taps, width).collect())
        for k, y in want.items():
            assert len(got[k]) == -(-len(signals[k]) * up // down) == len(y)
            assert np.abs(got[k] - y).max() < 1e-9 * max(1.0, np.abs(y).max())


def test_one_pass_is_up_filter_down():
    draw = np.random.default_rng(2)
    x, up, down = draw.normal(size=400), 3, 4
    taps = K.antialias(up, down, 100.0)[0]
    line = np.linspace(x[0], x[-1], 400)
    wide = np.zeros(400 * up)
    wide[::up] = x - line
    mid = (len(taps) - 1) // 2
    plain = np.convolve(wide, taps * up)[mid : mid + 400 * up][::down]
    plain += x[0] + (x[-1] - x[0]) * np.arange(len(plain)) * down / up / 399
    assert np.abs(K.resample_part(x, 0, 0, 400, 400, (x[0], x[-1]), up, down, taps) - plain).max() < 1e-10


def test_the_filter_is_measured():
    taps, report = K.antialias(*K.ratio(48828.125, 8000.0), 48828.125)
    assert (report.up, report.down, report.n_taps, report.usable_hz) == (512, 3125, 178_595, 3200.0)
    assert report.at_nyquist_db == pytest.approx(-92.7, abs=0.5) and report.alias_floor_db == pytest.approx(-100.9, abs=0.5)
    assert report.passband_hz < report.at_01_db_hz < report.at_3_db_hz < report.stop_reached_hz < 4100.0
    with pytest.raises(ValueError, match="alias floor"):
        K.antialias(1, 4, 1000.0, K.FilterSpec(attenuation_db=30.0))
    with pytest.raises(K.RateNotRational):
        K.ratio(44100.0, 48828.125)
    assert K.ratio(48828.125, 1000.0) == (64, 3125)
    for bad in ((0.8, 0.7), (0.0, 1.0), (0.5, 1.2)):
        with pytest.raises(ValueError):
            K.FilterSpec(*bad)


def test_rates_that_are_the_same_pass(spark, signals):
    chunks = cut_up(spark, {"b": signals["b"]}, [100])
    same, report = G.resample_to(chunks, ["series"], 250.0, 250.0)
    assert report is None and (together(same.collect())["b"] == signals["b"]).all()
    half, report = G.resample_to(chunks, ["series"], 250.0, 125.0)
    assert report.usable_hz == 50.0 and len(together(half.collect())["b"]) == 889


@pytest.mark.parametrize("stages", [[4], [13], [3, 5]])
def test_decimating_chunks_equals_one_pass(spark, stages):
    t = np.arange(20_000) / 1000
    x = np.sin(2 * np.pi * 3 * t) + 0.5 * np.sin(2 * np.pi * 330 * t) + 4
    want = x
    for q in stages:
        want = K.both_ways(want[None], K.decimation_filter(q), True, True)[0][::q]
    for width, sizes in ((2000, [701]), (1 << 14, [5000, 17])):
        got = together(G.decimate(cut_up(spark, {"x": x}, sizes), ["series"], stages, width).collect())["x"]
        assert len(got) == len(want) and np.abs(got - want).max() < 1e-9
    # The slow part stays in place, the fast one is gone.
    at = np.arange(len(want)) * np.prod(stages) / 1000
    inner = slice(len(want) // 10, -len(want) // 10)
    assert np.abs(want - (np.sin(2 * np.pi * 3 * at) + 4))[inner].max() < 0.06 * len(stages)
    short = spark.createDataFrame([("s", 0, [1.0] * 20)], "series string, t0_idx long, x array<double>")
    assert G.decimate(short, ["series"], [4]).first()["x"] is None


def test_the_decimation_filter_has_its_ripple_and_cut():
    f = K.decimation_filter(5)
    z = np.exp(1j * np.pi * np.linspace(0, 1, 4000, endpoint=False))
    h = np.abs([f.c @ np.linalg.solve(v * np.eye(8) - f.a, f.b) + f.d for v in z])
    db, cut = 20 * np.log10(h), int(4000 * 0.8 / 5)
    assert -0.0501 < db[: cut + 1].min() and db[: cut + 1].max() < 1e-6 and db[cut] == pytest.approx(-0.05, abs=1e-3)
    assert db[0] == pytest.approx(-0.05, abs=1e-6) and db[int(4000 * 1.6 / 5)] < -60


@pytest.mark.parametrize("sizes", [[50, 900], [3000]])
def test_summaries_and_spectra_do_not_depend_on_the_chunking(spark, signals, sizes):
    own = {k: np.round(x, 2) for k, x in signals.items()}
    states = G.window_states(cut_up(spark, own, sizes), ["series"], 512, 100.0, 64, 32, rails=(own["b"].min(), own["b"].max())).cache()
    got = {r["series"]: r for r in G.merge_states(states, ["series"]).collect()}
    db = {}
    for r in G.merge_spectra(states, ["series"]).collect():
        db[(r["series"], r["k"])] = r["db"]
    for k, x in own.items():
        r = got[k]
        assert (r["n"], r["n_bad"], r["lo"], r["hi"], r["n_lo"], r["n_hi"]) == (len(x), 0, x.min(), x.max(), (x == x.min()).sum(), (x == x.max()).sum())
        assert r["rms"] == pytest.approx(np.sqrt((x * x).mean()))
        windows = [x[i : i + 512] for i in range(0, len(x), 512) if len(x[i : i + 512]) >= 64]
        assert r["n_windows"] == len(windows)
        if windows:
            want = np.median([K.welch_median(w, 100.0, 64, 32) for w in windows], axis=0)
            assert [db[(k, j)] for j in range(33)] == pytest.approx(10 * np.log10(want))
    assert got["b"]["n_rail"] == 2 * 1 or got["b"]["n_rail"] == (own["b"] == own["b"].min()).sum() + (own["b"] == own["b"].max()).sum()
    states.unpersist()


def test_rails_and_bad_samples(spark):
    assert G.rail_bounds(None) == (None, None) and G.rail_bounds(-2) == (-2.0, 2.0) and G.rail_bounds((1, 3)) == (1.0, 3.0)
    for bad in ((3, 1), (1, 2, 3)):
        with pytest.raises(ValueError):
            G.rail_bounds(bad)
    frame = spark.createDataFrame([("s", 0, [1.0, float("nan"), 2.0]), ("t", 0, [1.0, -1.0, 1.0])], "series string, t0_idx long, x array<double>")
    got = {r["series"]: r for r in G.merge_states(G.window_states(frame, ["series"], 8, 1.0, 4, 9, rails=1.0), ["series"]).collect()}
    assert (got["s"]["n_bad"], got["s"]["rms"], got["s"]["n"]) == (1, None, 2)
    assert (got["t"]["n_rail"], got["t"]["n_windows"]) == (3, 0)


def test_a_spectrum_has_the_power_of_its_signal():
    x = np.random.default_rng(3).normal(size=200_000)
    p = K.welch_median(x, 100.0, 256, 128)
    assert p[1:-1].mean() == pytest.approx(2 / 100.0, rel=0.02)
