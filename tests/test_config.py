"""Configurations are refused for what would be misread."""

import pytest

from tidewave import config as C
from tidewave.operators import guardrails, normalize

TOLD = {f: "x" for f in ("label", "description", "when_to_use", "caveat", "means")}
GOOD = {
    "bands": {"bands": {"beta": [13, 30]}},
    "guardrails": {"guardrails": {r: {"severity": "warn"} for r in guardrails.CHECKS}},
    "qc_thresholds": {"actions": {"none": TOLD, "drop": TOLD}, "detectors": {"flat": {"proposed_action": "drop", "severity": "low", **TOLD}}},
    "statistics": {"centers": {c: TOLD for c in normalize.CENTERS}, "scales": {c: TOLD for c in normalize.SCALES}},
    "erna": {
        "band": {"low_hz": 100, "high_hz": 500}, "window": {"analysis_ms": 40, "blanking_ms": 1}, "peaks": {"min_peaks": 3, "prominence": 0.2},
        "stim": {"source": "epochs"}, "defaults_reviewed": True, "reviewed_by": "a name",
    },
}


def changed(name, *path_and_value):
    import copy

    out = copy.deepcopy(GOOD[name])
    *path, last, value = path_and_value
    node = out
    for p in path:
        node = node[p]
    if value is None:
        del node[last]
    else:
        node[last] = value
    return out


@pytest.mark.parametrize("name", sorted(GOOD))
def test_good_ones_pass(name):
    assert C.validate(name, GOOD[name]) is GOOD[name]
    with pytest.raises(C.ConfigError):
        C.validate(name, {})
    assert C.validate("other", {}) == {}
    with pytest.raises(C.ConfigError):
        C.validate(name, [])


@pytest.mark.parametrize(
    "name, path",
    [
        ("bands", ("bands", "beta", [30, 13])), ("bands", ("bands", "beta", [0, 13])), ("bands", ("bands", "beta", [1])), ("bands", ("bands", "beta", ["a", 2])),
        ("bands", ("bands", {})), ("guardrails", ("guardrails", "g01", {"severity": "loud"})), ("guardrails", ("guardrails", "g07", None)),
        ("guardrails", ("guardrails", "g07", [])), ("qc_thresholds", ("actions", "none", None)), ("qc_thresholds", ("actions", "drop", {"label": "x"})),
        ("qc_thresholds", ("detectors", "flat", "proposed_action", "burn")), ("qc_thresholds", ("detectors", "flat", "severity", "odd")),
        ("qc_thresholds", ("detectors", "flat", "means", " ")), ("statistics", ("centers", "grand_mean", None)), ("statistics", ("scales", "pooled", {"label": "x"})),
        ("erna", ("peaks", "prominence", None)), ("erna", ("band", "low_hz", 600)), ("erna", ("window", "analysis_ms", 0)), ("erna", ("window", "blanking_ms", -1)),
        ("erna", ("peaks", "min_peaks", 1)), ("erna", ("stim", "source", "guess")), ("erna", ("reviewed_by", " ")),
    ],
)
def test_faults_are_named(name, path):
    with pytest.raises(C.ConfigError):
        C.validate(name, changed(name, *path))


def test_extents():
    assert C.extent_of("annotation") == ("annotation", None) and C.extent_of({"fixed_s": 2}) == ("fixed_s", 2.0)
    assert C.extent_of("odd") == C.extent_of({"odd": 1}) == ("until_next", None) and C.extent_of(None, "annotation") == ("annotation", None)


def test_ringing_summaries(spark):
    import numpy as np

    from tidewave.operators import kernels as K

    t = np.arange(600) / 8000
    ring = np.exp(-t / 0.012) * np.sin(2 * np.pi * 250 * t)
    rows = [(0, 0, ring.tolist()), (1, 0, (2 * ring).tolist()), (2, 0, [0.0] * 4), (3, 1, [0.0] * 600)]
    frame = spark.createDataFrame(rows, "trial long, condition long, x array<double>")
    measures = K.ringing(frame, 8000.0, 100.0, 500.0)
    one = measures.where("trial = 0").first()
    assert one["peak_freq"] == pytest.approx(250, rel=0.06) and one["freq"] == pytest.approx(250, rel=0.06)
    got = {r["condition"]: r for r in K.ringing_summary(measures, ["condition"]).collect()}
    assert (got[0]["n"], got[0]["responding"]) == (3, 2) and got[1]["responding"] == 0 and got[1]["median_freq"] is None
    assert got[0]["median_freq"] == pytest.approx(250, rel=0.06)


def test_all_faults_are_reported_at_once():
    wrong = C.faults({"bands": {"a": [3, 1], "b": [0, 2], "c": [1, 2]}}, C.TABLES["bands"])
    assert wrong == [("bands.a", "must be two rising numbers"), ("bands.b", "must be above 0")]
    with pytest.raises(C.ConfigError) as error:
        C.validate("erna", {"band": {"low_hz": 9, "high_hz": 5}})
    assert {p for p, _ in error.value.faults} == {"band.low_hz", "window.analysis_ms", "window.blanking_ms", "peaks.min_peaks", "peaks.prominence", "stim.source"}
