"""Block builds: outcomes per block, products as one pass over the signal, commits and hashes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_grid import cut_up
from tidewave import blocks as B
from tidewave.functions import filters as K
from tidewave.operators import grid as G

POLICY = B.BuildPolicy(
    roles=[("^neur", "lfp"), ("^mic", "mic"), ("^skip", "ignore"), ("x$", "lfp"), ("^neurmic", "mic")], products={"lfp": ("lfp_1k", 250.0), "mic": ("mic", None)}, native=["^stim"], dropped=["junk"], window_s=2.0, segment_s=0.25,
)


def case(spark):
    draw = np.random.default_rng(0)
    signal = lambda n: draw.normal(size=n)
    recordings = {
        # block: {stream: (rate, {channel: samples})}
        "good": {"neur": (1000.0, {"a": signal(5000), "b": signal(5000)}), "mic_": (500.0, {"m": signal(2500)}), "skip": (10.0, {"s": signal(50)})},
        "stim1": {"neur": (1000.0, {"a": signal(3000)})},
        "slow": {"neur": (200.0, {"a": signal(800)})},
        "strange": {"what": (100.0, {"a": signal(300)})},
        "both": {"neurmic": (100.0, {"a": signal(300)})},
        "only_skip": {"skip": (10.0, {"s": signal(30)})},
        "clock": {"neur": (1000.0, {"a": signal(2000)})},
        "nan": {"neur": (1000.0, {"a": np.concatenate([signal(900), [np.nan], signal(99)])})},
        "odd_rate": {"neur": (44100.7, {"a": signal(500)})},
        "private": {"/home/x/neur x": (250.0, {"a": signal(500)})},
    }
    blocks = spark.createDataFrame([(b, "S01", "ses1", b) for b in [*recordings, "empty"]], "block_id string, study_id string, session string, block string")
    rows = [(b, s, rate, len(next(iter(c.values())))) for b, ss in recordings.items() for s, (rate, c) in ss.items()] + [("gap", "neur", 250.0, 1000)]
    streams = spark.createDataFrame(rows, "block_id string, stream string, sfreq double, n_samples long")
    flat = {f"{b}|{s}|{c}": x for b, ss in recordings.items() for s, (_, cs) in ss.items() for c, x in cs.items()}
    parts = F.split("series", r"\|")
    chunks = cut_up(spark, flat, [300, 701]).select(parts[0].alias("block_id"), parts[1].alias("stream"), parts[2].alias("channel"), "t0_idx", "x")
    chunks = chunks.union(spark.createDataFrame([("gap", "neur", "a", 0, [1.0] * 500), ("gap", "neur", "a", 600, [1.0] * 400)], chunks.schema))
    blocks = blocks.union(spark.createDataFrame([("gap", "S01", "ses1", "gap")], blocks.schema))
    marks = [("good", "Cam1", 0, 0.5, None, 1.0), ("good", "junk", 0, 1.7e9, None, 1.0), ("good", "Cam1", 1, 4.9, 5.0, 2.0), ("clock", "Cam1", 0, 1.7e9, None, 1.0), ("nan", "Cam1", 0, 0.1, None, 0.0)]
    events = spark.createDataFrame(marks, "block_id string, label string, i int, onset double, offset double, value double")
    return recordings, blocks, streams, chunks, events


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    recordings, *tables = case(spark)
    path = str(tmp_path_factory.mktemp("store"))
    result = B.build_blocks(spark, *tables, POLICY, path).collect()
    return recordings, tables, path, {r["block_id"]: r for r in result}


def test_every_block_has_its_outcome(built):
    got = {b: (r["status"], r["why"]) for b, r in built[3].items()}
    assert got == {
        "good": ("done", None), "stim1": ("done", None), "slow": ("done", None), "strange": ("quarantined", "unmapped_stream"), "both": ("quarantined", "ambiguous_stream"),
        "only_skip": ("quarantined", "nothing_to_write"), "clock": ("quarantined", "epoch_clock_origin"), "nan": ("failed", "samples"), "odd_rate": ("quarantined", "rate_not_rational"),
        "private": ("quarantined", "private_name"), "empty": ("quarantined", "no_streams"), "gap": ("failed", "samples"),
    }
    assert "not finite" in built[3]["nan"]["detail"] and "/home" not in built[3]["private"]["detail"] and built[3]["good"]["n_products"] == 2


def test_products_are_those_of_one_pass(spark, built):
    recordings, _, path, _ = built
    parts = {}
    for r in sorted(B.read_built(spark, path, "products").collect(), key=lambda r: r["t0_idx"]):
        parts.setdefault((r["block_id"], r["stream"], r["channel"], r["product"], r["sfreq_out"]), []).append(r["x"])
    assert set(parts) == {
        ("good", "neur", "a", "lfp_1k", 250.0), ("good", "neur", "b", "lfp_1k", 250.0), ("good", "mic_", "m", "mic", 500.0), ("stim1", "neur", "a", "lfp_1k", 1000.0), ("slow", "neur", "a", "lfp_1k", 200.0),
    }
    taps = K.antialias(1, 4, 1000.0)[0]
    for (b, s, c, _, out), got in parts.items():
        rate, channels = recordings[b][s]
        x = channels[c]
        want = x if out == rate else K.resample_part(x, 0, 0, len(x), len(x), (x[0], x[-1]), 1, 4, taps)
        assert np.abs(np.concatenate(got) - want).max() < 1e-6


def test_summaries_and_events_of_done_blocks(spark, built):
    recordings, _, path, _ = built
    rows = {(r["block_id"], r["stream"], r["channel"]): r for r in B.read_built(spark, path, "summaries").collect()}
    assert len(rows) == 5
    x = recordings["good"]["neur"][1]["a"]
    own = rows["good", "neur", "a"]
    assert (own["n"], own["lo"], own["sfreq"]) == (5000, x.min(), 1000.0) and own["rms"] == pytest.approx(np.sqrt((x * x).mean())) and len(own["psd_db"]) == 126
    assert sorted((r["block_id"], r["label"], r["i"]) for r in B.read_built(spark, path, "events").collect()) == [("good", "Cam1", 0), ("good", "Cam1", 1)]


def test_plans_say_why(spark, built):
    _, (blocks, streams, _, events), _, _ = built
    got = {(r["block_id"], r["stream"]): (r["product"], r["native"], r["reason"]) for r in B.plan_products(blocks, streams, events, POLICY).collect()}
    assert got["stim1", "neur"] == ("lfp_1k", True, "stimulation block: native rate") and got["slow", "neur"][2].startswith("target at or above")
    assert got["good", "mic_"] == ("mic", True, "policy: native") and got["good", "neur"] == ("lfp_1k", False, "policy") and got["good", "skip"] == (None, None, None)


def test_a_broken_run_is_not_seen_and_reruns_replace(spark, built, monkeypatch):
    _, tables, path, first = built
    blocks, streams, chunks, events = tables
    before = B.read_built(spark, path, "products").count()
    assert B.changed_products(spark, path).count() == 0
    assert {r["block_id"] for r in B.needs_build(spark, blocks, POLICY, path).collect()} == set(first) - {"good", "stim1", "slow"}
    assert B.needs_build(spark, blocks, POLICY, path + "/none").count() == blocks.count()
    one = [t.where("block_id = 'slow'") for t in tables]

    def broken(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(B, "chunk_hashes", broken)
        with pytest.raises(RuntimeError):
            B.build_blocks(spark, *one, POLICY, path)
    assert B.read_built(spark, path, "products").count() == before
    louder = [blocks.where("block_id = 'slow'"), streams.where("block_id = 'slow'"), chunks.where("block_id = 'slow'").withColumn("x", F.transform("x", lambda v: v * 2)), events.where("block_id = 'slow'")]
    again = B.build_blocks(spark, *louder, POLICY, path).first()
    assert again["status"] == "done" and again["sha256"] != first["slow"]["sha256"]
    assert B.read_built(spark, path, "products").count() == before and B.outcomes(spark, path).count() == len(first)
    assert B.changed_products(spark, path).count() == 0


def test_hashes_do_not_depend_on_chunking(spark):
    x = {"a": np.arange(900.0), "b": np.ones(7)}
    hashes = [sorted(map(tuple, B.chunk_hashes(cut_up(spark, x, sizes), ["series"]).collect())) for sizes in ([100], [7, 333])]
    assert hashes[0] == hashes[1] and [h[:2] for h in hashes[0]] == [("a", 900), ("b", 7)]
    assert G.extents(cut_up(spark, x, [50]), ["series"]).count() == 2
