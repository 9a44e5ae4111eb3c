"""Stimulation, trains, matching, phases at events and padded wavelets against planted truths and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_grid import cut_up
from tidewave.functions import kernels as K
from tidewave.operators import events as E
from tidewave.operators import grid as G
from tidewave.operators import onsets as O


def sample_frame(spark, signals):
    rows = [(s, c, i, float(v)) for (s, c), x in signals.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series string, channel string, i long, value double").repartition(3)


def test_hysteresis_against_a_loop(spark):
    draw = np.random.default_rng(0)
    signals = {("a", "x"): draw.normal(size=400), ("b", "x"): np.cumsum(draw.normal(size=300)) / 4}
    got = sorted((r["series"], r["first"], r["last"], r["n"], round(r["peak"], 9)) for r in E.bursts(sample_frame(spark, signals), ["series"], "i", "value", F.lit(1.0), F.lit(-0.5)).collect())
    want = []
    for (s, _), x in signals.items():
        on, first = False, 0
        for i, v in enumerate([*x, -9.0]):
            if not on and v >= 1.0:
                on, first = True, i
            elif on and v < -0.5:
                want.append((s, first, i - 1, i - first, round(float(max(x[first:i])), 9)))
                on = False
    assert got == sorted(want)


def test_planted_stimulation_is_found_with_its_trains(spark):
    rate, draw = 1000.0, np.random.default_rng(1)
    truth = np.concatenate([1000 + 130 * np.arange(10), 6000 + 130 * np.arange(25)])
    noise = [draw.normal(size=12_000) for _ in range(3)]
    for at in truth:
        noise[1][at : at + 3] += [60, -50, 40]
        noise[2][at + 1] -= 30
    flat = {("still", c): np.zeros(50) for c in "pq"}
    samples = sample_frame(spark, {("s", c): x for c, x in zip("pqr", noise, strict=True)} | flat)
    found = E.artifact_onsets(samples, ["series"], rate)
    assert sorted(r["onset"] for r in found.collect()) == truth.tolist()
    trains = E.pulse_trains(found.select("series", (F.col("onset") / rate).alias("onset")), ["series"], 0.5).collect()
    assert sorted((r["t_on"], round(r["t_off"], 6), r["n"], round(r["rate"], 6)) for r in trains) == [(1.0, 2.17, 10, round(1 / 0.13, 6)), (6.0, 9.12, 25, round(1 / 0.13, 6))]
    # A longer refractory time takes every second pulse.
    assert E.artifact_onsets(samples, ["series"], rate, 12.0, 200.0).count() == 5 + 13


def test_events_come_from_the_chosen_source(spark):
    windows = spark.createDataFrame([("s", "stim", 3.0), ("s", "rest", 1.0), ("t", "stim", 2.0)], "series string, condition string, t_start_s double")
    chosen = {k: v["value"] for k, v in E.settings({"stim.source": "windows", "stim.condition": "stim"}).items()}
    assert sorted(tuple(r) for r in E.stimulation_events(chosen, ["series"], 1.0, windows=windows).collect()) == [("s", 3.0), ("t", 2.0)]
    assert E.stimulation_events(chosen | {"stim.condition": ""}, ["series"], 1.0, windows=windows).count() == 3
    events = spark.createDataFrame([("s", "Cam1", 0.5), ("s", "Pul", 0.7)], "series string, label string, onset double")
    epochs = chosen | {"stim.source": "epochs"}
    assert [r["onset"] for r in E.stimulation_events(epochs | {"stim.epoch_store": "Pul"}, ["series"], 1.0, events=events).collect()] == [0.7]
    with pytest.raises(ValueError, match="Cam1"):
        E.stimulation_events(epochs, ["series"], 1.0, events=events)
    assert E.stimulation_events(epochs, ["series"], 1.0, events=events.where("label = 'Pul'")).count() == 1
    with pytest.raises(ValueError):
        E.stimulation_events(chosen | {"stim.source": "guess"}, ["series"], 1.0)


def test_settings_say_where_they_are_from():
    got = E.settings({"window.blanking_ms": 6.0}, {"window": {"blanking_ms": 5.0, "analysis_ms": 80.0}, "peaks": None})
    assert got["window.blanking_ms"] == {"value": 6.0, "source": "run"}
    assert got["window.analysis_ms"] == {"value": 80.0, "source": "configuration"}
    assert got["peaks.min_peaks"] == {"value": 4, "source": "default"}
    with pytest.raises(ValueError):
        E.settings({"window.blank": 1.0})


@pytest.mark.parametrize("cell", [16, 4096])
def test_stretches_are_cut_across_chunks(spark, cell):
    draw = np.random.default_rng(2)
    signals = {"a": draw.normal(size=900), "b": draw.normal(size=70)}
    starts = [(f"{s}{k}", s, int(a), int(a + n)) for s in ("a", "b") for k, (a, n) in enumerate(zip(draw.integers(-20, 900, 30), draw.integers(0, 150, 30), strict=True))]
    frame = spark.createDataFrame(starts, "id string, series string, first long, last long")
    got = {r["id"]: r["x"] for r in E.cut_at(cut_up(spark, signals, [1, 60, 200]), ["series"], frame, cell).collect()}
    for i, s, a, b in starts:
        x = signals[s]
        assert got[i] == (x[a:b].tolist() if 0 <= a < b <= len(x) else None)


def test_responses_ring_at_the_planted_rate(spark):
    rate, draw = 2000.0, np.random.default_rng(3)
    x, onsets = draw.normal(size=8000) * 0.02, [0.5, 1.5, 2.5, 3.98]
    for t in onsets:
        i = round(t * rate)
        n = min(200, 8000 - i - 8)
        x[i : i + 4] += 50
        x[i + 8 : i + 8 + n] += np.exp(-np.arange(n) / rate / 0.02) * np.sin(2 * np.pi * 250 * np.arange(n) / rate)
    events = spark.createDataFrame([(k, "s", t) for k, t in enumerate(onsets)], "id long, series string, onset double")
    found = E.responses(cut_up(spark, {"s": x}, [512]), ["series"], events, rate, 4.0, 100.0).collect()
    assert sorted(r["id"] for r in found) == [0, 1, 2]  # the last one's stretch runs past the end
    for r in found:
        assert len(r["x"]) == 200 and K.band_peak(np.array(r["x"]), rate, 100.0, 500.0) == pytest.approx(250, abs=5)


def greedy(a, b, tol):
    """Two pointers."""
    i = j = 0
    out = []
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and abs(a[i] - b[j]) <= tol:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and a[i] < b[j]:
            out.append((a[i], None))
            i += 1
        else:
            out.append((None, b[j]))
            j += 1
    return sorted(out, key=str)


@pytest.mark.parametrize("tol", [0.0, 0.3, 5.0])
def test_matching_against_two_pointers(spark, tol):
    draw = np.random.default_rng(4)
    streams = {s: tuple(np.sort(np.round(draw.uniform(0, span, n), 1)).tolist() for n in sizes) for s, span, sizes in (("p", 30, (60, 50)), ("q", 300, (40, 80)), ("r", 9, (0, 5)), ("s", 9, (3, 0)))}
    frames = [spark.createDataFrame([(s, t) for s, both in streams.items() for t in both[k]] + [("p", None)], "series string, onset double").repartition(3) for k in (0, 1)]
    pairs = E.match_one_to_one(*frames, ["series"], tol)
    rows = pairs.collect()
    for s, (a, b) in streams.items():
        assert sorted(((r["t_a"], r["t_b"]) for r in rows if r["series"] == s), key=str) == greedy(a, b, tol)
    scores = {r["series"]: r for r in E.match_scores(pairs, ["series"]).collect()}
    for s, (a, b) in streams.items():
        want = greedy(a, b, tol)
        hits = [(x, y) for x, y in want if x is not None and y is not None]
        assert (scores[s]["hits"], scores[s]["missed"], scores[s]["false_alarms"]) == (len(hits), len(a) - len(hits), len(b) - len(hits))
        if hits:
            assert scores[s]["jitter"] == pytest.approx(np.std([y - x for x, y in hits])) and scores[s]["recall"] == len(hits) / len(a)
    counts = {r["series"]: tuple(r)[1:] for r in E.match_counts(*frames, ["series"], tol + 1e-9).collect()}
    for s, (a, b) in streams.items():
        near = lambda t, other: any(abs(t - u) <= tol + 1e-9 for u in other)
        hit = sum(near(t, b) for t in a)
        assert counts[s] == (hit, len(a) - hit, sum(not near(t, a) for t in b))


def test_phases_are_taken_between_samples(spark):
    # Events at a planted phase of an oscillation that is sampled unevenly lock to it.
    draw = np.random.default_rng(5)
    t = np.sort(draw.uniform(0, 50, 4000))
    f, planted = 3.0, 1.1
    phase = (2 * np.pi * f * t + np.pi) % (2 * np.pi) - np.pi
    spikes = (planted / (2 * np.pi) + np.arange(20, 120)) / f
    phases = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(t, phase, strict=True)] + [("s", 1.0, None)], "series string, t double, phase double")
    events = spark.createDataFrame([("s", float(v)) for v in spikes] + [("s", -5.0), ("s", 99.0), ("none", 1.0), ("s", float(t[7]))], "series string, onset double")
    got = E.phases_at(phases, events, ["series"]).collect()
    at = {r["onset"]: r["at"] for r in got}
    assert len(got) == 104 and at[-5.0] is None and at[99.0] is None and at[1.0] is None and at[float(t[7])] == pytest.approx(phase[7])
    assert all(at[float(v)] == pytest.approx(planted, abs=1e-6) for v in spikes)
    locked = E.locking(E.phases_at(phases, events.where("onset > 6 and onset < 41"), ["series"]), ["series"]).first()
    assert locked["n"] == 100 and locked["plv"] == pytest.approx(1, abs=1e-9) and locked["mean_phase"] == pytest.approx(planted, abs=1e-6) and locked["ppc"] == pytest.approx(1, abs=1e-9)


def test_wavelets_have_no_edges(spark):
    rate, freqs = 200.0, O.frequencies(4.0, 40.0, 5)
    n_cycles = O.cycles(freqs, 0.5, 4.0)
    assert n_cycles[0] == 4.0 and n_cycles[-1] == 20.0
    pad = O.reach(freqs, n_cycles, rate)
    assert pad >= max(5 * c / (2 * np.pi * f) * rate for f, c in zip(freqs, n_cycles, strict=True)) > pad - 1
    draw = np.random.default_rng(6)
    x = draw.normal(size=3000) * 0.2 + np.where(abs(np.arange(3000) - 1550) < 100, np.sin(2 * np.pi * freqs[2] * np.arange(3000) / rate), 0)
    onsets = spark.createDataFrame([("mid", "s", 7.0), ("early", "s", 0.2), ("late", "s", 14.9)], "id string, series string, onset double")
    maps = O.onset_power(cut_up(spark, {"s": x}, [333]), ["series"], onsets, rate, freqs, n_cycles, -0.5, 1.0, 2)
    rows = maps.collect()
    assert {r["id"] for r in rows if r["power"] is None} == {"early", "late"}
    for i, f in enumerate(freqs):
        w = O.wavelet(f, n_cycles[i], rate)
        whole = np.abs(np.convolve(x, w, mode="full")[len(w) // 2 : len(w) // 2 + 3000]) ** 2
        own = {round(r["t"] * rate): r["power"] for r in rows if r["id"] == "mid" and abs(r["freq"] - f) < 1e-9}
        assert sorted(own) == list(range(-100, 201, 2))
        assert all(p == pytest.approx(whole[1400 + k], rel=1e-9, abs=1e-12) for k, p in own.items())
    value = {(round(r["freq"], 6), round(r["t"], 6)): r["value"] for r in O.against_baseline(maps, ["id"], -0.5, -0.2).collect()}
    assert max(value, key=value.get)[0] == round(freqs[2], 6)
    with pytest.raises(ValueError):
        O.against_baseline(maps, ["id"], 0.0, 1.0, "ratio")


def test_ranges_of_coupling():
    assert O.coupling_grid(4.0, 10.0, 2.0).tolist() == [4.0, 6.0, 8.0]
    assert O.too_short(10.0, 2.0) is None and "less" in O.too_short(1.0, 2.0)
    with pytest.raises(ValueError):
        O.frequencies(0.0, 5.0, 3)


def test_a_band_has_its_phase_across_chunks(spark):
    t = np.arange(6000) / 250
    x = np.sin(2 * np.pi * 10 * t + 0.4) + 3 + 0.1 * np.sin(2 * np.pi * 60 * t)
    rows = E.band_phase(cut_up(spark, {"s": x}, [90, 400]), ["series"], 250.0, 8.0, 12.0, width=1024).collect()
    got = np.concatenate([r["phase"] for r in sorted(rows, key=lambda r: r["t0_idx"])])
    want = np.angle(np.exp(1j * (2 * np.pi * 10 * t + 0.4 - np.pi / 2)))
    assert len(got) == 6000 and np.abs(np.angle(np.exp(1j * (got - want))))[250:-250].max() < 0.02
    assert G.extents(cut_up(spark, {"s": x}, [90]), ["series"]).first()["n"] == 6000
