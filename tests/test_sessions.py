"""Sessions: what the manifest says of one recording, its derived signals, epochs and facts."""

import numpy as np
import pytest

from tests.test_grid import cut_up, together
from tidewave import sessions as S
from tidewave.functions import filters as K
from tidewave.operators import guardrails as G
from tidewave.operators import manifest as M

RATE = 1000.0
MODEL = {"contacts": [{"id": c, "row": r, "kind": k} for c, r, k in (("t", 0, "ring"), ("u1", 1, "segment"), ("u2", 1, "segment"), ("v1", 2, "segment"), ("v2", 2, "segment"), ("w", 3, "ring"))]}
CONFIGS = {"leads": {"leads": {"six": MODEL}}, "privacy": {"filenames_deidentified": {"tank": True}}, "guardrails": {}}


def tables(spark, windows=None):
    rows = {
        "subjects": [("S01", "one", "R", "tank", "data/S01", "", "", ""), ("S02", "one", "R", "edf", "data/S02", "", "", "")],
        "leads": [("S01", "one", "L1", "stn", "R", "six", "1", "6", "", "")],
        "channels": [("S01", "one", "neur", str(i + 1), f"c{i}", "stn", "L1", c["id"], "", "no" if c["id"] == "v2" else "yes", "") for i, c in enumerate(MODEL["contacts"])],
        "windows": windows or [("S01", "one", "rest", "1", "3", "log", "in_use", ""), ("S01", "one", "overt", "3.5", "5", "emg", "in_use", ""), ("S01", "one", "rest", "6", "6.3", "log", "in_use", ""), ("S02", "one", "x", "0", "1", "", "", "")],
    }
    return {n: spark.createDataFrame(rows.get(n, []), ", ".join(f"{c} string" for c in M.columns_of(n))).coalesce(1) for n in M.TABLES}


@pytest.fixture(scope="module")
def session(spark):
    return S.open_session(spark, tables(spark), CONFIGS, "S01", "one")


@pytest.fixture(scope="module")
def recorded(spark):
    draw = np.random.default_rng(0)
    x = {f"c{i}": draw.normal(size=7000) for i in range(6)}
    return x, cut_up(spark, x, [777, 100]).withColumnRenamed("series", "channel").selectExpr("'neur' as stream", "channel", "t0_idx", "x")


def test_what_the_manifest_says(spark, session):
    assert session.conditions() == ["rest", "overt"] and session.windows("rest").count() == 2 and session.windows().count() == 3
    assert session.leads() == ["L1"]
    labels = {r["contact"]: (r["row_label"], r["available"]) for r in session.contacts.collect()}
    assert labels == {"t": ("ventral_ring", True), "u1": ("lower_segments", True), "u2": ("lower_segments", True), "v1": ("upper_segments", True), "v2": ("upper_segments", False), "w": ("dorsal_ring", True)}
    for study, configs in (("S09", CONFIGS), ("S01", {"leads": {"leads": {}}})):
        with pytest.raises(KeyError):
            S.open_session(spark, tables(spark), configs, study, "one")


def test_derived_signals_are_weighted_sums(session, recorded):
    x, chunks = recorded
    got = session.derived(chunks, "L1", "bipolar_vertical", RATE, width=512)
    signals = together(got.signal.withColumnRenamed("derivation", "series").collect())
    assert set(signals) == {"u1-t", "u2-t", "v1-w", "w-t"} and (got.factor, got.bandwidth_hz) == (1, 400.0)
    assert np.abs(signals["v1-w"] - (x["c3"] - x["c5"])).max() < 1e-12
    assert {r["derivation"]: r["row_label"] for r in got.rows.collect()} == {"u1-t": "lower_segments", "u2-t": "lower_segments", "v1-w": "upper_segments", "w-t": "dorsal_ring"}
    assert [(r["derivation"], r["missing"]) for r in got.notes.collect()] == [("v2-w", ["v2"])]
    slow = session.derived(chunks, "L1", "monopolar", RATE, target=240.0)
    kept = together(slow.signal.withColumnRenamed("derivation", "series").collect())
    want = K.both_ways(x["c0"][None], K.decimation_filter(4), True, True)[0][::4]
    assert (slow.rate, slow.factor, slow.bandwidth_hz) == (250.0, 4, 100.0) and np.abs(kept["t"] - want).max() < 1e-9


def test_decisions_take_effect_or_are_told(session, recorded):
    actions = [{"action": "exclude_channel", "target": "L1:u2"}, {"action": "exclude_channel", "target": "L1:v2"}, {"action": "annotate_window", "target": "L1:t@2.00s"}, {"action": "notch", "target": "L1:t"}, {"action": "exclude_channel", "target": "L9:t"}]
    after = session.apply_qc(actions)
    assert [a["effect"].split()[0] for a in after.applied] == ["dropped", "annotated,", "recommended,"] and len(after.annotations) == 1
    names = {r["derivation"] for r in after.derived(recorded[1], "L1", "bipolar_vertical", RATE).signal.select("derivation").distinct().collect()}
    assert names == {"u1-t", "v1-w", "w-t"} and session.contacts.where("available").count() == 5


def test_windows_become_epochs(session, recorded):
    x, chunks = recorded
    signal = session.derived(chunks, "L1", "monopolar", RATE).signal
    rows = session.epochs(signal, RATE, 0.5, 0.5).where("derivation = 'w'").orderBy("trial").collect()
    starts = [1.0 + 0.25 * i for i in range(7)] + [3.5 + 0.25 * i for i in range(5)] + [6.0]
    assert [(r["condition"], len(r["x"])) for r in rows] == [("rest", 500)] * 7 + [("overt", 500)] * 5 + [("rest", 300)]
    for r, t in zip(rows, starts, strict=True):
        assert r["x"] == x["c5"][round(t * RATE) : round(t * RATE) + len(r["x"])].tolist()
    assert session.epochs(signal, RATE, 0.5, conditions=["overt"]).select("trial").distinct().count() == 3


def test_stages_and_excursions():
    assert S.stages(6) == [6] and S.stages(26) == [13, 2] and S.stages(17) == [17] and np.prod(S.stages(360)) == 360 and max(S.stages(360)) <= 13
    assert S.excursion([1.0] * 4) is None and S.excursion([0.0] * 10 + [3.0] * 10) == 3.0


def fired(spark, facts):
    names = [f.split()[0] for f in G.FACTS.split(", ")]
    plan = spark.createDataFrame([tuple({"plan": "p", **facts}.get(n) for n in names)], G.FACTS)
    return {r["rule"] for r in G.run_checks(plan).collect()}


def test_every_rule_fires_from_what_a_session_and_a_plan_state(spark, session):
    usual = {"scheme": "bipolar_vertical", "bandwidth_hz": 400.0, "bands": {"beta": (13, 30)}, "conditions": ["rest"], "window_s": 1.0}
    assert fired(spark, session.facts(**usual)) == set()
    odd = [("S01", "one", "rest", "1", "3", "assumed", "in_use", "")]
    suspect = S.open_session(spark, tables(spark, odd), CONFIGS, "S01", "one")
    open_names = S.open_session(spark, tables(spark), {**CONFIGS, "privacy": {"filenames_deidentified": False}}, "S01", "one")
    cases = {
        "g01": session.facts(**usual | {"scheme": "monopolar"}), "g02": session.facts(**usual, contact_baseline=False), "g03": session.facts(**usual, ratio_per_channel=False),
        "g04": session.facts(**usual, threshold_within=False), "g05": session.facts(**usual | {"event_s": 0.1}), "g06": session.facts(**usual | {"bands": {"high": (300, 450)}}),
        "g07": session.facts(**usual | {"bands": {"gamma": (70, 150)}, "conditions": ["overt", "metro"]}), "g08": session.facts(**usual, reports_db=True),
        "g09": session.facts(**usual, excursion_db=S.excursion([0.0] * 10 + [3.0] * 10), effect_db=1.0), "g10": suspect.facts(**usual), "g11": session.facts(**usual | {"conditions": None}),
        "g12": session.facts(**usual, baseline_smoothed=True), "g13": {**open_names.facts(**usual), "paths": ["data/S01"]},
    }
    assert set(cases) == set(G.RULES)
    for rule, facts in cases.items():
        assert fired(spark, facts) == {rule}, rule
    # A site that declares its names safe has its paths told; one that doesn't has none.
    assert session.facts(**usual)["paths"] == ["data/S01"] and open_names.facts(**usual)["paths"] == []
