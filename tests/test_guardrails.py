"""Every rule with literal plans: what fires, how much it matters, and what an override resolves."""

import pytest

from tidewave.operators import guardrails as G

#: facts, the rules that fire on them
CASES = [
    ({}, []),
    ({"scheme": "monopolar"}, ["g01"]),
    ({"scheme": "monopolar", "shared_reference": True}, ["g01"]),
    ({"scheme": "monopolar", "shared_reference": False}, []),
    ({"scheme": "bipolar_vertical", "shared_reference": True}, []),
    ({"contact_baseline": False}, ["g02"]),
    ({"contact_baseline": True}, []),
    ({"ratio_per_channel": False}, ["g03"]),
    ({"ratio_per_channel": True}, []),
    ({"threshold_within": False}, ["g04"]),
    ({"threshold_within": True}, []),
    ({"window_s": 2.0, "event_s": 0.1}, ["g05"]),
    ({"window_s": 0.5, "event_s": 0.1}, []),
    ({"window_s": 2.0, "event_s": 0.0}, []),
    ({"bands": [("gamma", 70.0, 150.0)], "bandwidth_hz": 100.0}, ["g06"]),
    ({"bands": [("gamma", 70.0, 150.0)], "bandwidth_hz": 150.0}, []),
    ({"bands": [("gamma", 70.0, 150.0)]}, []),
    ({"bands": [("gamma", 70.0, 150.0)], "conditions": ["overt", "metro"]}, ["g07"]),
    ({"bands": [("gamma", 70.0, 150.0)], "conditions": ["overt", "metro"], "scheme": "bipolar_vertical", "emg_regressed": True}, []),
    ({"bands": [("gamma", 70.0, 150.0)], "conditions": ["overt", "metro"], "scheme": "bipolar_vertical"}, ["g07"]),
    ({"bands": [("gamma", 70.0, 150.0)], "conditions": ["overt", "metro"], "scheme": "car", "emg_regressed": True}, ["g07"]),
    ({"bands": [("beta", 13.0, 30.0)], "conditions": ["overt", "metro"]}, []),
    ({"bands": [("gamma", 70.0, 150.0)], "conditions": ["rest"]}, []),
    ({"reports_db": True}, ["g08"]),
    ({"reports_db": True, "reports_z": True}, []),
    ({"reports_db": False}, []),
    ({"excursion_db": -3.0, "effect_db": 2.0}, ["g09"]),
    ({"excursion_db": 1.0, "effect_db": -2.0}, []),
    ({"excursion_db": 1.0, "effect_db": 0.0}, []),
    ({"windows": [("rest", "assumed", "in_use")]}, ["g10"]),
    ({"windows": [("rest", "emg", "in_use"), ("overt", "emg", "draft")]}, ["g10"]),
    ({"windows": [("rest", "emg", "in_use")]}, []),
    ({"windows": [("rest", None, None)]}, []),
    ({"conditions": ["overt", "rest"]}, ["g11"]),
    ({"conditions": ["overt", "move", "rest"]}, []),
    ({"conditions": ["move"]}, ["g11"]),
    ({"conditions": ["dbs_on", "dbs_off"]}, []),
    ({"conditions": ["task", "cue"]}, []),
    ({"conditions": []}, []),
    ({"baseline_smoothed": True}, ["g12"]),
    ({"baseline_smoothed": False}, []),
    ({"paths": ["/raw/x"]}, ["g13"]),
    ({"paths": ["/raw/x"], "deidentified": True}, []),
    ({"paths": []}, []),
]


def plans_of(spark, facts):
    names = [x.split()[0] for x in G.FACTS.split(", ")]
    return spark.createDataFrame([tuple({"plan": str(i), **f}.get(n) for n in names) for i, f in enumerate(facts)], G.FACTS)


def test_when_rules_fire(spark):
    found = {}
    for r in G.run_checks(plans_of(spark, [f for f, _ in CASES])).collect():
        found.setdefault(r["plan"], []).append(r["rule"])
    assert {str(i): sorted(found.get(str(i), [])) for i in range(len(CASES))} == {str(i): w for i, (_, w) in enumerate(CASES)}


def test_severities_and_overrides(spark):
    facts = {
        "scheme": "monopolar", "contact_baseline": False, "ratio_per_channel": False, "threshold_within": False, "reports_db": True,
        "baseline_smoothed": True, "paths": ["x"], "bands": [("b", 1.0, 9.0)], "bandwidth_hz": 5.0,
    }
    overrides = {r: "on purpose" for r in ("g01", "g03", "g06", "g12", "g13")}
    got = {r["rule"]: (r["severity"], r["resolved"], r["blocks"]) for r in G.run_checks(plans_of(spark, [facts]), overrides).collect()}
    assert got == {
        "g01": ("block", True, False), "g02": ("block", False, True), "g03": ("block", False, True), "g04": ("warn", False, False),
        "g06": ("block", False, True), "g08": ("note", False, False), "g12": ("block", False, True), "g13": ("block", False, True),
    }
    with pytest.raises(ValueError, match="reason"):
        G.run_checks(plans_of(spark, [facts]), {"g01": "  "})


def test_configuration_changes_severity_and_thresholds_but_opens_nothing(spark):
    facts = {"scheme": "monopolar", "window_s": 2.0, "event_s": 0.1, "ratio_per_channel": False, "conditions": ["imagery"], "reports_db": True}
    config = {
        "g01": {"severity": "off"}, "g05": {"max_ratio": 30.0}, "g03": {"severity": "warn", "allow_override": True}, "g08": {"required": False},
        "g11": {"applies_to": ("imagery",), "satisfied_by": ("eyes",), "severity": "block", "allow_override": False},
    }
    got = {r["rule"]: (r["severity"], r["resolved"], r["blocks"]) for r in G.run_checks(plans_of(spark, [facts]), {"g03": "x", "g11": "y"}, config).collect()}
    assert got == {"g03": ("warn", False, False), "g11": ("block", False, True)}
    with pytest.raises(ValueError, match="severity"):
        G.configured({"g01": {"severity": "loud"}})


def test_plans_may_lack_facts_and_rules_may_be_added(spark):
    only = spark.createDataFrame([("p", "monopolar")], "plan string, scheme string")
    assert [r["rule"] for r in G.run_checks(only).collect()] == ["g01"]
    with pytest.raises(ValueError, match="already"):
        G.register("g01")(lambda fact, settings: None)


def test_summaries_count_what_the_rows_say(spark):
    facts = [f for f, _ in CASES]
    overrides = {"g01": "compared", "g06": "closed all the same"}
    rows = {}
    for r in G.run_checks(plans_of(spark, facts), overrides).collect():
        rows.setdefault(r["plan"], []).append(r)
    for r in G.summarize(plans_of(spark, facts), overrides).collect():
        own = rows.get(r["plan"], [])
        assert sorted(r["rules"]) == sorted(x["rule"] for x in own)
        assert (r["n_blocking"], r["n_warnings"], r["n_notes"]) == (sum(x["blocks"] for x in own), *(sum(x["severity"] == s for x in own) for s in ("warn", "note")))
    with pytest.raises(ValueError):
        G.summarize(plans_of(spark, facts), {"g01": " "})
