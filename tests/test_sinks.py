import hashlib

import numpy as np
import pytest

from tidewave import sinks


def test_products_refuse_what_is_not_finite(spark, tmp_path):
    chunks = "stream string, channel string, t0_idx long, x array<double>"
    good = spark.createDataFrame([("s", "a", 0, [1.0, 2.0]), ("s", "b", 0, [3.0])], chunks)
    sinks.write_products(good, str(tmp_path / "p"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).select("stream", "channel", "x").collect())) == [("s", "a", [1.0, 2.0]), ("s", "b", [3.0])]
    with pytest.raises(ValueError):
        sinks.write_products(spark.createDataFrame([("s", "a", 0, [float("nan")])], chunks), str(tmp_path / "q"))
    assert not (tmp_path / "q").exists()


def test_hashes_follow_the_order_of_samples(spark):
    rows = [(s, c, i, float(i * s)) for s in (1, 2) for c in "ab" for i in range(50)]
    frame = spark.createDataFrame(rows[::-1], "session long, channel string, i long, value double").repartition(7)
    got = {(r["session"], r["channel"]): r["sha256"] for r in sinks.channel_hashes(frame).collect()}
    assert got == {(s, c): hashlib.sha256(np.array([float(i * s) for i in range(50)], "<f8").tobytes()).hexdigest() for s in (1, 2) for c in "ab"}
    assert sinks.channel_hashes(frame.limit(0)).count() == 0


def test_decisions_and_history_round_trip(spark, tmp_path):
    assert sinks.load_decisions(spark, str(tmp_path / "none")).count() == 0
    rows = spark.createDataFrame([("f1", None, "a, b"), ("f2", "approve", "x")], "flag_id string, verdict string, target string")
    sinks.save_decisions(rows, str(tmp_path / "d"))
    got = {r["flag_id"]: (r["verdict"], r["target"], r["reason"]) for r in sinks.load_decisions(spark, str(tmp_path / "d")).collect()}
    assert got == {"f1": ("", "a, b", ""), "f2": ("approve", "x", "")}
    for _ in range(2):
        sinks.append_history(rows, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 4
