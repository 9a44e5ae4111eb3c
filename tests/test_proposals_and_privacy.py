"""Lead models from impedances, selections, and the privacy walk through nested values."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewave.operators import privacy as P
from tidewave.operators import proposals as R

MODELS = [("acme_d", [1, 3, 3, 1], 8), ("bolt_d", [1, 3, 3, 1], 8), ("unknown_directional", [1, 3, 3, 1], 8), ("ring_four", [1, 1, 1, 1], 4), ("ring_eight", [1] * 8, 8), ("unknown_eight", [1] * 8, 8)]


def proposed(spark, leads):
    """leads: name to impedances in order, None where a contact wasn't measured."""
    sweep = [(n, 10 + i, v) for n, kohm in leads.items() for i, v in enumerate(kohm)]
    frame = spark.createDataFrame(sweep, "lead string, contact int, kohm double").where("kohm is not null")
    ranges = spark.createDataFrame([(n, 10, 9 + len(k)) for n, k in leads.items()], "lead string, channel_first int, channel_last int")
    models = spark.createDataFrame(MODELS, "model string, geometry array<int>, n_contacts int")
    return R.propose_lead_models(frame, ranges, models, ["lead"]), frame, ranges


def test_lead_models(spark):
    leads = {
        "directional": [1.0, 2.1, 2.2, 2.0, 1.9, 2.3, 2.1, 1.1], "four": [1.0, 1.1, 0.9, 1.2], "eight": [1.0, 1.2, 1.1, 1.0, 1.3, 1.0, 1.1, 1.2],
        "odd": [1.0, 2.0, 2.0, 1.0], "gap": [1.0, None, 1.1, 1.2], "nothing": [None, None],
    }
    found, sweep, ranges = proposed(spark, leads)
    got = {r["lead"]: r for r in found.collect()}
    pick = lambda n: (got[n]["value"], got[n]["confidence"], got[n]["band"], got[n]["prefill"], got[n]["alternatives"])
    assert pick("directional") == ("unknown_directional", 0.6, "medium", False, ["acme_d", "bolt_d"])
    assert pick("four") == ("ring_four", 0.9, "high", True, [])
    assert pick("eight") == ("unknown_eight", 0.6, "medium", False, ["ring_eight"])
    assert pick("odd") == (None, 0.0, "low", False, []) and "1-2-1" in got["odd"]["reason"]
    assert got["gap"]["evidence"]["labels"] == "ring,unknown,ring,ring" and got["nothing"]["value"] is None
    assert got["directional"]["evidence"]["segment_to_ring"] == "2.0"
    assert sorted(r["lead"] for r in R.needs_selection(found).collect()) == ["directional", "eight", "gap", "nothing", "odd"] or got["gap"]["prefill"]
    assert R.by_field(found, "lead_model").count() == 6 and R.by_field(found, "other").count() == 0
    assert sorted(map(tuple, R.missing_contacts(sweep, ranges, ["lead"]).collect())) == [("gap", 11), ("nothing", 10), ("nothing", 11)]


def test_contact_quality(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 25.0), ("a", 3, 140.0), ("a", 4, None)], "lead string, contact int, kohm double")
    got = {r["evidence"]["target"]: (r["value"], r["band"]) for r in R.propose_contact_quality(rows, ["lead"], F.concat(F.lit("contact "), "contact"), F.col("kohm")).collect()}
    assert got == {"contact 2": ("high_impedance", "medium"), "contact 3": ("open_circuit", "high")}


def found(rows):
    return [sorted((v["where"], v["rule"]) for v in r["violations"]) for r in rows.collect()]


def test_the_walk_reaches_nested_values(spark):
    schema = "a struct<note:string,inner:struct<when:timestamp,file:string>,start_time:double,t0_s:double>, m map<string,string>, l array<array<string>>, n map<string,double>, b binary"
    clean = (("fine", (None, "rec"), 3.0, 9e9), {"k": "decimate 12"}, [["x"], ["may be 7"], None], {"freq": 1e9}, b"ok")
    bad = (
        ("seen 2021-03-04", (datetime.datetime(2020, 1, 1), "/home/lab/x.mat"), 1.6e9, 0.0), {"k": "see C:\\lab\\x", "19990101": "y"}, [["fine"], ["12 March", "on march 3"]], {"file_stamp": 2e6},
        b"http://x.org",
    )
    empty = (None, None, None, None, None)
    got = found(P.walk(spark.createDataFrame([clean, bad, empty], schema), ["a", "m", "l", "n", "b"]))
    assert got[0] == [] and got[2] == []
    assert got[1] == [
        ("a.inner.file", "absolute path"), ("a.inner.when", "date or time"), ("a.note", "dashed date"), ("a.start_time", "timestamp"), ("b", "uri"), ("l", "month-name date"),
        ("m key", "compact date"), ("m.k", "absolute path"), ("n.file_stamp", "timestamp"),
    ]


@pytest.mark.parametrize(
    ("text", "rule"),
    [("a/b", None), ("~/data/x", "absolute path"), ("see /srv/x/y", "absolute path"), ("\\\\host\\share", "absolute path"), ("smb://h", "uri"), ("v20210304a", None), ("20211304", None), ("1/2", None), ("2021.3.4", "dashed date"), ("Dec 3", "month-name date"), ("decimate 3", None), ("3rd June", "month-name date")],
)
def test_the_floor(spark, text, rule):
    frame = spark.createDataFrame([(text,)], "t string")
    assert found(P.walk(frame, ["t"])) == [[("t", rule)] if rule else []]


def test_configured_patterns_allow_lists_and_refusals(spark):
    frame = spark.createDataFrame([({"units": "V", "who": "MRN 12345"},), ({"units": "V"},)], "attrs map<string,string>")
    assert found(P.walk(frame, ["attrs"], {"record number": r"MRN \d+"}, ["units"])) == [[("attrs key", "not allowed"), ("attrs.who", "record number")], []]
    with pytest.raises(P.PrivacyRefusal) as refusal:
        P.refuse(frame, ["attrs"], {"record number": r"MRN \d+"})
    assert "attrs.who: record number (1 rows)" in str(refusal.value) and "12345" not in str(refusal.value)
    assert P.refuse(frame, ["attrs"]).count() == 2


def test_policies(spark):
    assert not P.filenames_deidentified({}, "edf") and P.filenames_deidentified({"filenames_deidentified": True}, "edf")
    per = {"filenames_deidentified": {"tank": True}, "restricted_metadata_fields": {"edf": ["patient", "born"]}}
    assert P.filenames_deidentified(per, "tank") and not P.filenames_deidentified(per, "edf")
    rows = spark.createDataFrame([("/x/y/rec.edf", {"patient": "N", "rate": "250"})], "path string, metadata map<string,string>")
    shown = P.shown_metadata(rows, P.Policy.of(per, "edf")).first()
    assert (shown["metadata"], shown["restricted_fields_present"], shown["path_name"]) == ({"rate": "250"}, ["patient"], None)
    assert P.shown_metadata(rows, P.Policy.of(per, "tank")).first()["path_name"] == "rec.edf" and P.Policy() == P.Policy(False, frozenset())
