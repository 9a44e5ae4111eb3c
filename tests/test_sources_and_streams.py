"""Readers recover what was written; the streaming fold equals the batch."""

import numpy as np
import pandas as pd
import pytest

from tidewave.sources import recordings as R
from tidewave.streaming import summary as U



def write_edf(path, signals, rate):
    n, records = len(signals), len(signals[0]) // rate
    pad = lambda v, w: str(v).ljust(w)[:w].encode()
    head = pad("0", 8) + pad("X", 80) + pad("X", 80) + pad("01.01.00", 8) + pad("00.00.00", 8) + pad(256 * (n + 1), 8) + pad("", 44)
    head += pad(records, 8) + pad(1, 8) + pad(n, 4)
    for values, width in (([f"ch{i}" for i in range(n)], 16), ([""] * n, 80), (["uV"] * n, 8), ([-100] * n, 8), ([100] * n, 8),
                          ([-32768] * n, 8), ([32767] * n, 8), ([""] * n, 80), ([rate] * n, 8), ([""] * n, 32)):
        head += b"".join(pad(v, width) for v in values)
    raw = [np.round((s + 100) / 200 * 65535 - 32768).astype("<i2").reshape(records, rate) for s in signals]
    path.write_bytes(head + np.concatenate(raw, axis=1).tobytes())


def write_vision(path, signals, rate):
    names = "\n".join(f"Ch{i + 1}=c{i},,0.5,uV" for i in range(len(signals)))
    path.with_suffix(".vhdr").write_text(
        "Brain Vision Data Exchange Header File Version 1.0\n[Common Infos]\nDataFile=x.eeg\nDataFormat=BINARY\nDataOrientation=MULTIPLEXED\n"
        f"NumberOfChannels={len(signals)}\nSamplingInterval={1e6 / rate:g}\n[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\n{names}\n"
    )
    path.with_suffix(".eeg").write_bytes(np.round(np.array(signals) / 0.5).astype("<i2").T.tobytes())
    path.with_suffix(".vmrk").write_text("[Marker Infos]\nMk1=New Segment,,1,1,0\nMk2=Stimulus,S1,101,1,0\nMk3=Stimulus,S1,201,1,0\n")


def write_tank(path, signals, rate):
    rows, data = [], b""
    for c, s in enumerate(signals, 1):
        for at in range(0, len(s), 100):
            part = s[at : at + 100].astype("<f4").tobytes()
            rows.append((len(part) // 4 + 10, R.TANK_STREAM, b"neur", c, 0, 1000 + at / rate, len(data), 0, rate))
            data += part
    rows = rows[::-1] + [(10, R.TANK_STROBE_ON, b"Cam1", 0, 0, 1000.5, np.float64(7.0).view(np.int64), 4, 0)]
    path.with_suffix(".tsq").write_bytes(np.array(rows, R.TANK_RECORD).tobytes())
    path.with_suffix(".tev").write_bytes(data)


@pytest.fixture()
def folder(tmp_path):
    t = np.arange(1000) / 250
    signals = [50 * np.sin(2 * np.pi * 20 * t), 10 * t]
    for name, write in (("edf", write_edf), ("vision", write_vision), ("tank", write_tank)):
        (tmp_path / name).mkdir()
        write(tmp_path / name / "rec.edf", signals, 250)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "rec.edf").write_bytes(b"nothing")
    return tmp_path, signals


@pytest.mark.parametrize("name,step", [("edf", 0.004), ("vision", 0.26), ("tank", 1e-4)])
def test_readers_give_back_the_samples(spark, folder, name, step):
    path, signals = folder
    chunks = R.read_chunks(spark, str(path / name))
    got = R.long_samples(chunks).toPandas().sort_values(["channel", "i"])
    for s, (_, part) in zip(signals, got.groupby("channel"), strict=True):
        assert np.abs(part["value"].to_numpy() - s).max() <= step
    assert {r["sfreq"] for r in chunks.collect()} == {250.0}
    cut = R.long_samples(R.read_chunks(spark, str(path / name), [sorted(got["channel"].unique())[1]], 1.0, 1.5))
    assert cut.count() == 125 and cut.agg({"i": "min"}).first()[0] == 250


def test_events_of_markers_and_strobes(spark, folder):
    path, _ = folder
    vision = {(r["label"], r["i"]): r["onset"] for r in R.read_events(spark, str(path / "vision")).collect()}
    assert vision[("S1", 0)] == 0.4 and vision[("S1", 1)] == 0.8
    (strobe,) = R.read_events(spark, str(path / "tank")).collect()
    assert (strobe["label"], strobe["onset"], strobe["value"]) == ("Cam1", 0.5, 7.0)


def test_unreadable_files_are_rows(spark, folder):
    rows = R.read_chunks(spark, str(folder[0] / "bad")).collect()
    assert len(rows) == 1 and rows[0]["error"]
    with pytest.raises(ValueError):
        R.register_reader("edf", lambda p, h: True, None)


def test_impedance_sweep(spark, tmp_path):
    (tmp_path / "s.csv").write_text("R1 (kOhm),R2 (kOhm),other\n5,-1,x\n6,7,x\n-1,bad,x\n")
    got = {r["contact"]: r["kohm"] for r in R.read_impedance(spark, str(tmp_path / "s.csv")).collect()}
    assert got == {1: 6.0, 2: 7.0}


def test_streaming_fold_equals_batch(spark, tmp_path):
    draw = np.random.default_rng(0)
    rows = pd.DataFrame({"session": draw.integers(0, 3, 600), "channel": draw.choice(list("ab"), 600), "value": np.round(draw.normal(size=600), 1)})
    rows.loc[7, "value"] = np.inf
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        rows.iloc[k * 200 : (k + 1) * 200].to_parquet(tmp_path / "in" / f"{k}.parquet")
    stream = spark.readStream.schema("session long, channel string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = U.fold_stream(stream).writeStream.format("memory").queryName("folded").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("folded").toPandas().sort_values("n").groupby(["session", "channel"]).last()
    for key, part in rows.groupby(["session", "channel"]):
        v = part["value"][np.isfinite(part["value"])]
        r = got.loc[key]
        assert (r["n"], r["lo"], r["hi"], r["n_lo"], r["n_hi"], r["n_bad"]) == (len(v), v.min(), v.max(), (v == v.min()).sum(), (v == v.max()).sum(), len(part) - len(v))
        assert r["rms"] == pytest.approx(np.sqrt((v * v).mean()))
