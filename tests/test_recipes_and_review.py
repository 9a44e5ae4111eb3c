"""Recipes are validated, gated, checked and recorded; reviews keep judgement and lose stale signatures."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_oracle import SF
from tidewave import recipes
from tidewave.operators import review as R

DETECTED = "study string, flag_id string, target_type string, target string, flag_type string, evidence_summary string, proposed_action string, severity string"


def flags(spark, *ids, study="s1", note="a"):
    return spark.createDataFrame([(study, i, "channel", f"c{i}", "flat", note, "exclude", "high") for i in ids], DETECTED)


def fresh(spark, *ids, study="s1"):
    none = R.merge_decisions(spark.createDataFrame([], f"{DETECTED}, status string, {', '.join(f'{c} string' for c in R.REVIEWER)}"), flags(spark, *ids, study=study))
    return none


def answers(spark, *rows):
    return spark.createDataFrame(list(rows), "study string, flag_id string, approved boolean, action_taken string, reviewer string, reviewed_at string, reason string")


def test_detection_keeps_judgement(spark):
    first, refused = R.decide(fresh(spark, "1", "2"), answers(spark, ("s1", "1", True, None, "me", "t", "")))
    assert refused.count() == 0
    again = {r["flag_id"]: r for r in R.merge_decisions(first, flags(spark, "1", "3", note="b")).collect()}
    assert (again["1"]["evidence_summary"], again["1"]["approved"], again["1"]["action_taken"], again["1"]["status"]) == ("b", "true", "exclude", "active")
    assert (again["2"]["status"], again["2"]["evidence_summary"]) == ("stale", "a")
    assert again["3"]["approved"] == "" and len(again) == 3


def test_answers_need_reasons(spark):
    rows = fresh(spark, "1", "2", "3", "4")
    done, refused = R.decide(
        rows,
        answers(
            spark, ("s1", "1", False, None, "me", "t", " "), ("s1", "2", True, "notch", "me", "t", None), ("s1", "3", False, None, "me", "t", "fine"),
            ("s1", "9", True, None, "me", "t", ""), ("s1", "4", True, "exclude", "me", "t", ""),
        ),
    )
    assert {r["flag_id"]: r["why"] for r in refused.collect()} == {"1": "a reason is needed", "2": "a reason is needed", "9": "no such flag"}
    got = {r["flag_id"]: (r["approved"], r["action_taken"]) for r in done.collect()}
    assert got == {"1": ("", ""), "2": ("", ""), "3": ("false", "none"), "4": ("true", "exclude")}
    assert {r["flag_id"] for r in R.undecided(done).collect()} == {"1", "2"}
    assert R.select(done, severity="high", target="c1").count() == 1 and R.select(done, only_undecided=False).count() == 4
    assert [r["action"] for r in R.applied_actions(done).collect()] == ["exclude"]


def test_signatures_cover_what_was_signed(spark):
    studies = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s4",)], "study string")
    ran = studies.where("study <> 's4'")
    rows, _ = R.decide(fresh(spark, "1").union(fresh(spark, "1", study="s2")), answers(spark, ("s1", "1", True, None, "me", "t", "")))
    rows = rows.cache()
    signed, refused = R.sign(studies, ran, rows, "me")
    assert {r["study"] for r in signed.collect()} == {"s1", "s3"} and sorted(map(tuple, refused.collect())) == [("s2", 1, "in_review"), ("s4", 0, "unreviewed")]
    history = spark.createDataFrame([("s1", "sign", "1"), ("s3", "sign", "1")], "study string, event string, at string")
    states = lambda d, h: {r["study"]: r["state"] for r in R.status(studies, ran, d, signed, h).collect()}
    assert states(rows, history) == {"s1": "approved", "s2": "in_review", "s3": "approved", "s4": "unreviewed"}
    edited = rows.withColumn("reason", F.when(F.col("study") == "s1", "changed my mind").otherwise(F.col("reason")))
    assert states(edited, history)["s1"] == "reopened"
    event = R.reopen(studies.where("study = 's3'"), "me", "new data", F.lit("2")).select("study", "event", "at")
    assert states(rows, history.union(event))["s3"] == "reopened"
    with pytest.raises(ValueError):
        R.reopen(studies, "me", " ", F.lit("2"))
    with pytest.raises(ValueError):
        R.sign(studies, ran, rows, " ")
    table = R.status(studies, ran, rows, signed, history)
    R.require_approved(table, "s1")
    for study in ("s2", "s4", "s9"):
        with pytest.raises(R.NotApproved, match=study):
            R.require_approved(table, study)


def test_flag_ids_tell_detectors_apart(spark):
    one = lambda d: R.flag_id(F.lit("channel"), F.lit("g"), F.lit("insufficient_channels"), F.lit(d))
    row = spark.range(1).select(one("variance").alias("a"), one("hf").alias("b"), one("variance").alias("c")).first()
    assert row["a"] == row["c"] != row["b"] and len(row["a"]) == 16


def test_a_run_obeys_its_parameters_and_is_recorded(spark, tmp_path):
    store = tmp_path.as_uri()
    assert recipes.list_runs(spark, store).count() == 0
    record, out = recipes.run(spark, SF, "psd_by_condition", "alpha differs", {"samples": 32, "fmin": 8.0, "fmax": 12.0}, store=store)
    assert {r["freq"] for r in out.select("freq").distinct().collect()} == {8.0, 12.0} and record.status == "ok"
    other, wide = recipes.run(spark, SF, "psd_by_condition", "alpha differs", store=store)
    assert wide.select("freq").distinct().count() == 25 and other.run_id != record.run_id and other.config_sha256 != record.config_sha256
    kept = recipes.get_run(spark, store, record.run_id)
    assert kept["params"]["fmax"] == 12.0 and kept["outputs"] == [f"results/{record.run_id}"] and kept["inputs"][0]["rows"] == 500 and kept["finished_at"]
    assert [r["run_id"] for r in recipes.list_runs(spark, store).collect()] == [other.run_id, record.run_id]
    with pytest.raises(KeyError):
        recipes.get_run(spark, store, "none")


def test_refusals_leave_nothing_and_failures_leave_a_record(spark, tmp_path):
    store = tmp_path.as_uri()
    asked = {"spark": spark, "sf_dir": SF, "name": "psd_by_condition", "claim": "c", "store": store}
    with pytest.raises(recipes.Blocked, match="g06"):
        recipes.run(**asked, params={"fmax": 90.0}, overrides={"g06": "please"})
    with pytest.raises(recipes.Blocked, match="g01"):
        recipes.run(**asked, facts={"scheme": "monopolar"})
    for params in ({"samples": 4}, {"nothing": 1}, {"samples": "64"}, {"samples": True}):
        with pytest.raises(ValueError):
            recipes.run(**asked, params=params)
    with pytest.raises(ValueError, match="claim"):
        recipes.run(spark, SF, "psd_by_condition", " ")
    with pytest.raises(KeyError):
        recipes.run(spark, SF, "nothing", "c")
    states = spark.createDataFrame([("s1", "in_review")], "study string, state string")
    with pytest.raises(R.NotApproved):
        recipes.run(**asked, study="s1", states=states)
    assert recipes.list_runs(spark, store).count() == 0
    record, _ = recipes.run(**asked, facts={"scheme": "monopolar"}, overrides={"g01": "montages compared"}, study="s2", states=states.union(spark.createDataFrame([("s2", "approved")], states.schema)))
    assert record.overrides == {"g01": "montages compared"} and [f["rule"] for f in record.findings] == ["g01"]

    def broken(spark, sf_dir, p):
        raise RuntimeError("cannot read /data/subject one/file.edf and '/home/x/y.txt'")

    recipes.recipe("broken_for_a_test", "?")(broken)
    with pytest.raises(RuntimeError):
        recipes.run(spark, SF, "broken_for_a_test", "c", store=store)
    failed = [json.loads(r["record"]) for r in recipes.list_runs(spark, store).where("status = 'failed'").collect()]
    assert len(failed) == 1 and "RuntimeError" in failed[0]["error"] and "/home/x" not in failed[0]["error"] and "/root" not in failed[0]["error"]
    del recipes.RECIPES["broken_for_a_test"]
    with pytest.raises(ValueError):
        recipes.recipe("psd_by_condition", "again")(None)


def test_what_only_the_result_can_tell_is_checked_after(spark):
    params = {"draws": 100, "boots": 100, "top": 3}
    record, out = recipes.run(spark, SF, "bandpower_contrast", "bands change", params, facts={"excursion_db": 1000.0})
    rows = out.collect()
    assert len(rows) == 3 and all(r["lo"] <= r["effect"] <= r["hi"] and 0 < r["p"] <= 1 for r in rows)
    assert [(f["rule"], f.get("after")) for f in record.findings] == [("g09", True)]


def test_forms_describe_every_recipe():
    told = {d["name"]: d for d in recipes.describe_all()}
    assert set(told) == set(recipes.RECIPES) and all(d["question"] and d["produces"] for d in told.values())
    samples = told["psd_by_condition"]["params_schema"]["properties"]["samples"]
    assert samples == {"type": "integer", "default": 64, "title": "Samples per segment", "x-group": "essential", "minimum": 8}
