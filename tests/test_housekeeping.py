"""Proposals saved and merged, histories, indices, inspections, snippets, spans and drifts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_grid import cut_up
from tests.test_sources_and_streams import write_edf, write_tank
from tidewave import recipes, sinks
from tidewave.operators import detection as D
from tidewave.operators import normalize
from tidewave.operators import relations as R
from tidewave.sources import seeking as S

FLAG = "study string, flag_id string, target_type string, target string, flag_type string, evidence_summary string, proposed_action string, severity string"


def test_detections_fold_into_saved_decisions(spark, tmp_path):
    folder = tmp_path.as_uri()
    one = spark.createDataFrame([("s", "a", "channel", "c1", "flat", "x=1", "exclude", "high"), ("s", "b", "channel", "c2", "loud", "x=2", "exclude", "med")], FLAG)
    first = sinks.propose(one, folder, "1").collect()
    assert {(r["flag_id"], r["status"], r["approved"]) for r in first} == {("a", "active", ""), ("b", "active", "")}
    assert sorted(map(tuple, sinks.propose(one, folder, "2").collect())) == sorted(map(tuple, first))
    later = spark.createDataFrame([("s", "b", "channel", "c2", "loud", "x=3", "exclude", "med"), ("s", "c", "channel", "c3", "flat", "x=4", "exclude", "low")], FLAG)
    got = {r["flag_id"]: (r["status"], r["evidence_summary"]) for r in sinks.propose(later, folder, "3").collect()}
    assert got == {"a": ("stale", "x=1"), "b": ("active", "x=3"), "c": ("active", "x=4")}
    flags = spark.read.json(f"{folder}/flags").collect()
    assert len(flags) == 2 and {r["n_flags"] for r in flags} == {2} and all(r["detected_at"] for r in flags)
    assert sinks.saved_proposals(spark, folder + "/none").count() == 0


def test_histories_are_read_back_in_order(spark, tmp_path):
    path = (tmp_path / "h").as_uri()
    assert sinks.read_history(spark, path).count() == 0
    for at, event in (("2", "reopen"), ("1", "sign")):
        sinks.append_history(spark.createDataFrame([("s", event, "me", at, "")], "study string, event string, reviewer string, at string, reason string"), path)
    assert [r["event"] for r in sinks.read_history(spark, path).collect()] == ["sign", "reopen"]


def test_an_index_is_derived_anew_from_records(spark, tmp_path):
    store, other = (tmp_path / "a").as_uri(), (tmp_path / "b").as_uri()
    for i, (name, status) in enumerate((("psd", "ok"), ("psd", "failed"), ("tfr", "ok"))):
        recipes._write_record(spark, store, recipes.Run(f"r{i}", name, "1", "c", {}, status=status, started_at=str(i), finished_at=str(i)))
    bad = spark.createDataFrame([("x", "psd", "ok", "", "", "9", "9", "", "not json")], recipes._INDEX)
    bad.write.mode("append").json(f"{store}/records")
    assert recipes.reindex(spark, store, other) == 3
    assert [r["run_id"] for r in recipes.list_runs(spark, other).collect()] == ["r2", "r1", "r0"]
    assert [r["run_id"] for r in recipes.list_runs(spark, other, name="psd", status="ok").collect()] == ["r0"] and recipes.list_runs(spark, other, limit=1).count() == 1


def test_errors_are_told_without_paths():
    try:
        try:
            raise OSError("no file '/data/x/y.edf'")
        except OSError as inner:
            raise ValueError("can't read /home/lab/rec one") from inner
    except ValueError as error:
        name, text = recipes.redact_exception(error)
    assert name == "ValueError" and "caused by OSError" in text and "/data" not in text and "/home" not in text
    assert "KeyError" in recipes.redact_exception(ExceptionGroup("several", [KeyError("k"), ValueError("v")]))[1]


def test_choices_are_explained():
    told = normalize.options_for_schema({"centers": {"grand_mean": {"label": "Grand mean", "caveat": " mind it "}}})
    assert [c["value"] for c in told["centers"]] == list(normalize.CENTERS) and told["scales"][0]["label"] == normalize.SCALES[0]
    assert told["centers"][0] == {"value": "grand_mean", "label": "Grand mean", "description": "", "when_to_use": "", "caveat": "mind it"}


def test_trees_of_recordings_are_inspected(spark, tmp_path):
    for study, block in (("S1", "b1"), ("S1", "deep/b2"), ("_tmp", "b"), ("S2", "bad")):
        (tmp_path / study / block).mkdir(parents=True)
    t = np.arange(1000) / 250
    write_tank(tmp_path / "S1" / "b1" / "rec.edf", [t, t], 250)
    write_edf(tmp_path / "S1" / "deep" / "b2" / "rec.edf", [t], 250)
    write_edf(tmp_path / "_tmp" / "b" / "rec.edf", [t], 250)
    (tmp_path / "S2" / "bad" / "rec.edf").write_bytes(b"0       " + b"x" * 300)
    assert [(s, b.removeprefix(str(tmp_path))) for s, b in S.find_blocks(str(tmp_path))] == [("S1", "/S1/b1"), ("S1", "/S1/deep/b2"), ("S2", "/S2/bad")]
    streams, unreadable = S.inspect(spark, str(tmp_path))
    got = {r["block"]: (r["study"], r["format"], r["n_channels"], r["duration_s"], r["usable_hz"], r["events"]) for r in streams.collect()}
    assert got == {"b1": ("S1", "tank", 2, 4.0, 125.0, {"Cam1": 1}), "b2": ("S1", "edf", 1, 4.0, 125.0, {})}
    assert [r["block"].endswith("/S2/bad") for r in unreadable.collect()] == [True]
    assert [tuple(r)[1:] for r in S.available_events(spark, str(tmp_path / "S1" / "b1")).collect()] == [("Cam1", 1)]
    for name, text in (("z.csv", "FREQUENCY,R1 (kOhm)\n"), ("a.csv", "R1 (kOhm),R2 (kOhm)\n1,2\n"), ("other.csv", "a,b\n"), ("R1 (kOhm).txt", "R1 (kOhm)")):
        (tmp_path / "S1" / "b1" / name).write_text(text)
    assert [p.rsplit("/", 1)[1] for p in S.find_sweeps(str(tmp_path / "S1" / "b1"))] == ["a.csv", "z.csv"] and S.find_sweeps(str(tmp_path / "nowhere")) == []


def test_snippets_show_the_signal_around_a_flag(spark):
    x = np.arange(20_000.0)
    chunks = cut_up(spark, {"c1": x}, [999]).withColumnRenamed("series", "channel").withColumn("session", F.lit("s"))
    flags = spark.createDataFrame([("s", "window", "f1", {"channel": "c1", "t_start_s": "5.0", "t_end_s": "6.0"}), ("s", "window", "f2", {"channel": "c1", "t_start_s": "0.5", "t_end_s": "19.9"}), ("s", "channel", "f3", {"channel": "c1"})], "session string, target_type string, flag_id string, evidence map<string,string>")
    got = {r["flag_id"]: r for r in D.window_snippets(chunks, ["session"], flags, 1000.0).collect()}
    assert set(got) == {"f1", "f2"} and (got["f1"]["first"], got["f1"]["step"]) == (3500, 1) and got["f1"]["x"] == x[3500:7500].tolist()
    assert (got["f2"]["first"], got["f2"]["step"]) == (0, 5) and got["f2"]["x"] == x[0:20_000:5].tolist()


@pytest.mark.parametrize("width", [None, 4])
def test_excursions_against_frames(spark, width):
    draw = np.random.default_rng(0)
    groups = {"a": draw.normal(size=53), "b": draw.normal(size=6), "c": draw.normal(size=4), "d": np.zeros(0)}
    rows = [(g, i, float(v)) for g, x in groups.items() for i, v in enumerate(x)] + [("a", 99, None)]
    got = {r["g"]: r["excursion"] for r in R.moving_excursion(spark.createDataFrame(rows, "g string, i long, v double"), ["g"], "i", "v", width).collect()}
    for g, x in groups.items():
        w = width or max(3, len(x) // 5)
        frames = [x[i : i + w].mean() for i in range(len(x) - w + 1)]
        assert got.get(g) == (pytest.approx(max(frames) - min(frames)) if len(x) >= 5 else None)


def test_drift_is_of_the_band_with_the_largest_effect(spark):
    rows = [("beta", "rest", i, 10.0 * (i >= 10)) for i in range(20)] + [("beta", "task", i, 20.0) for i in range(5)] + [("alpha", c, i, 1.0) for c in ("rest", "task") for i in range(9)]
    got = R.contrast_drift(spark.createDataFrame(rows, "band string, condition string, ord long, value double"), "band", "rest").first()
    assert (got["band"], got["effect"], got["excursion"]) == ("beta", 15.0, 10.0) and got["ratio"] == pytest.approx(10 / 15)
    one = spark.createDataFrame(rows[:3], "band string, condition string, ord long, value double")
    assert R.contrast_drift(one, "band", "rest").count() == 0
    spans = spark.createDataFrame([("a", 1.0, 2.0), ("a", 5.0, 9.0), ("b", 1.0, None), ("c", 1.0, 1.0)], "s string, t_start_s double, t_end_s double")
    assert {r["s"]: r["span_s"] for r in R.window_span(spans, ["s"]).collect()} == {"a": 8.0, "b": None, "c": None}
