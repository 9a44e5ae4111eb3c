"""Seeking reads: the windows' samples, what is read for them, structure from indices, refusals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sources_and_streams import write_edf, write_tank, write_vision
from tidewave.sources import recordings as R
from tidewave.sources import seeking as S

RATE = 250


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("rec")
    t = np.arange(40 * RATE) / RATE
    signals = [50 * np.sin(2 * np.pi * 20 * t), 2 * t, np.cos(t)]
    for name, write in (("edf", write_edf), ("vision", write_vision), ("tank", write_tank)):
        (root / name).mkdir()
        write(root / name / "rec.edf", signals, RATE)
    return root, np.array(signals)


def joined(rows):
    """k -> first sample and samples."""
    out = {}
    for r in sorted(rows, key=lambda r: (r["k"], r["t0_idx"])):
        first, parts = out.setdefault(r["k"], (r["t0_idx"], []))
        assert r["t0_idx"] == first + sum(map(len, parts))
        parts.append(r["x"])
    return {k: (first, np.concatenate(parts)) for k, (first, parts) in out.items()}


@pytest.mark.parametrize(("name", "stream", "step"), [("edf", "eeg", 0.004), ("vision", "eeg", 0.26), ("tank", "neur", 1e-4)])
def test_windows_in_the_order_of_channels_asked_for(spark, folder, name, stream, step):
    root, signals = folder
    for picked, tmin, tmax in (([2, 0], 16.2, 33.4), ([1], None, 0.1), (None, 39.9, None), ([0, 0], 1.0, 1.0), ([1], 38.0, 99.0)):
        got = joined(S.read_window(spark, str(root / name), stream, picked, tmin, tmax).collect())
        lo, hi = 0 if tmin is None else round(tmin * RATE), min(signals.shape[1], signals.shape[1] if tmax is None else round(tmax * RATE))
        order = range(len(signals)) if picked is None else picked
        if lo == hi:
            assert got == {}
            continue
        assert sorted(got) == list(range(len(order)))
        for k, c in enumerate(order):
            assert got[k][0] == lo and len(got[k][1]) == hi - lo
            assert np.abs(got[k][1] - signals[c, lo:hi]).max() <= step


def test_seeking_equals_reading_whole_files(spark, folder):
    root, _ = folder
    for name in ("edf", "vision", "tank"):
        whole = R.long_samples(R.read_chunks(spark, str(root / name))).select("channel", "i", F.round("value", 9).alias("v"))
        sought = S.chunks(spark, str(root / name)).select("channel", "t0_idx", F.posexplode("x").alias("p", "v")).select("channel", (F.col("t0_idx") + F.col("p")).alias("i"), F.round("v", 9).alias("v"))
        assert whole.exceptAll(sought).count() == 0 == sought.exceptAll(whole).count()


def test_vectorised_brainvision(spark, tmp_path):
    x = np.arange(3 * 9000).reshape(3, 9000).astype("<i2")
    write_vision(tmp_path / "v.vhdr", x * 0.5, RATE)
    head = (tmp_path / "v.vhdr").read_text().replace("MULTIPLEXED", "VECTORIZED")
    (tmp_path / "v.vhdr").write_text(head)
    (tmp_path / "v.eeg").write_bytes(x.tobytes())
    got = joined(S.read_window(spark, str(tmp_path), "eeg", ["c2", "c1"], 10.0, 30.0).collect())
    assert (got[0][1] == x[2, 2500:7500] * 0.5).all() and (got[1][1] == x[1, 2500:7500] * 0.5).all()


def test_a_short_window_of_a_large_file_reads_only_its_chunks(spark, tmp_path):
    """Three gigabytes, sparse; the window's records hold their numbers."""
    rate, channels, per, records = 24_414.0625, 28, 256, 105_000
    index = np.zeros(records * channels, R.TANK_RECORD)
    r, c = np.divmod(np.arange(records * channels), channels)
    index["size"], index["type"], index["code"], index["channel"] = per + 10, R.TANK_STREAM, b"neur", c + 1
    index["time"], index["offset"], index["rate"] = 1000 + r * per / rate, (r * channels + c) * per * 4, rate
    index.tofile(tmp_path / "big.tsq")
    size = records * channels * per * 4
    first, last = int(600 * rate) // per - 20, int(602 * rate) // per + 20
    with open(tmp_path / "big.tev", "wb") as f:
        for k in range(first, last):
            f.seek(k * channels * per * 4)
            f.write(np.repeat(np.arange(channels), per).astype("<f4").tobytes())
        f.truncate(size)
    assert size > 3e9
    got = joined(S.read_window(spark, str(tmp_path), "neur", ["3", "17"], 600.0, 602.0).collect())
    assert all(len(x) == round(602 * rate) - round(600 * rate) and (x == k).all() for (_, x), k in zip((got[0], got[1]), (2, 16), strict=True))
    # What the plan reads: the two channels' chunks, and gaps of at most GAP between records.
    pieces = S.plan(S.open_recording(str(tmp_path)), {"neur"}, {"3", "17"}, 600.0, 602.0)
    needed = 2 * 4 * (round(602 * rate) - round(600 * rate))
    assert needed <= sum(n for p in pieces for _, n in p.reads()) <= needed + 2 * 2 * 4 * S.CHUNK + 4 * per * 2
    # A plan of everything is dealt into pieces of bounded size.
    every = S.plan(S.open_recording(str(tmp_path)))
    assert len(every) > 150 and max(sum(n for _, n in p.reads()) for p in every) < 2 * S.PART_BYTES


def test_filters_reach_the_plan(spark, folder):
    root, _ = folder
    reader = S.RecordingReader(str(root / "tank"), None)
    whole = sum(n for p in reader.partitions() for _, n in p.reads())
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    kept = list(reader.pushFilters([EqualTo(("channel",), "2"), GreaterThan(("t_end",), 20.0), LessThan(("t_start",), 21.0)]))
    assert len(kept) == 3
    assert sum(n for p in reader.partitions() for _, n in p.reads()) < whole / 4
    frame = S.chunks(spark, str(root / "tank")).where("channel = '2' and t_end > 20.0 and t_start < 21.0")
    assert frame.rdd.getNumPartitions() == 1 and {r["channel"] for r in frame.collect()} == {"2"}


def test_structure_and_events_come_from_indices(spark, folder, tmp_path):
    root, signals = folder
    rows = {r["format"]: r for r in S.stream_table(spark, str(root)).collect()}
    assert {k: (r["n_channels"], r["sfreq"], r["n_samples"]) for k, r in rows.items()} == dict.fromkeys(("edf", "brainvision", "tank"), (3, 250.0, signals.shape[1]))
    # A tank without its data still tells its structure.
    (tmp_path / "only.tsq").write_bytes((root / "tank" / "rec.tsq").read_bytes())
    assert S.stream_table(spark, str(tmp_path)).first()["n_samples"] == signals.shape[1]
    (strobe,) = [r for r in S.event_table(spark, str(root / "tank")).collect()]
    assert (strobe["label"], strobe["onset"], strobe["offset"], strobe["value"]) == ("Cam1", 0.5, None, 7.0)
    off = np.array([(10, S.TANK_STROBE_OFF, b"Cam1", 0, 0, 1000.75, 0, 4, 0)], R.TANK_RECORD)
    (tmp_path / "only.tsq").write_bytes((root / "tank" / "rec.tsq").read_bytes() + off.tobytes())
    assert S.event_table(spark, str(tmp_path)).first()["offset"] == 0.75
    marks = {(r["label"], r["i"]): r["onset"] for r in S.event_table(spark, str(root / "vision")).collect()}
    assert marks[("S1", 1)] == 0.8


def test_kinds_of_channels_are_streams(spark, tmp_path):
    write_edf(tmp_path / "k.edf", [np.zeros(500), np.ones(500), np.ones(500)], RATE)
    raw = bytearray((tmp_path / "k.edf").read_bytes())
    for i, label in enumerate((b"EEG Fz", b"EMG chin", b"EEG Cz")):
        raw[256 + 16 * i : 272 + 16 * i] = label.ljust(16)
    (tmp_path / "k.edf").write_bytes(bytes(raw))
    assert {r["stream"]: r["channels"] for r in S.stream_table(spark, str(tmp_path)).collect()} == {"eeg": ["EEG Fz", "EEG Cz"], "emg": ["EMG chin"]}


def test_refusals(spark, folder, tmp_path):
    root, _ = folder
    tank = str(root / "tank")
    for error, call in (
        (KeyError, lambda: S.read_window(spark, tank, "none")), (IndexError, lambda: S.read_window(spark, tank, "neur", [3])), (IndexError, lambda: S.read_window(spark, tank, "neur", ["9"])),
        (ValueError, lambda: S.read_window(spark, tank, "neur", None, 2.0, 1.0)), (ValueError, lambda: S.open_recording(str(root))), (ValueError, lambda: S.open_recording(tank, "mat")),
        (FileNotFoundError, lambda: S.open_recording(str(root / "nowhere"))), (ValueError, lambda: S.open_recording(str(tmp_path))),
    ):
        with pytest.raises(error):
            call()
    (tmp_path / "x.bin").write_bytes(b"?")
    with pytest.raises(ValueError):
        S.open_recording(str(tmp_path / "x.bin"))
    assert S.open_recording(f"file://{tank}/rec.tsq", "tank").format == "tank"


def test_many_windows_over_many_recordings(spark, folder):
    root, signals = folder
    rows = [(1, f"{root}/tank", "neur", ["2", "1"], 1.0, 20.0), (2, f"{root}/edf", "eeg", None, 39.0, None), (3, f"{root}/edf", "none", None, None, None), (4, f"{root}/gone", "x", None, 0.0, 1.0), (5, f"{root}/vision", "eeg", ["c9"], 0.0, 1.0)]
    windows = spark.createDataFrame(rows, "window_id long, path string, stream string, channels array<string>, tmin double, tmax double")
    found = S.read_windows(windows.repartition(2)).collect()
    assert sorted(r["window_id"] for r in found if r["error"]) == [3, 4, 5]
    got = joined([r for r in found if r["window_id"] == 1])
    assert np.abs(got[0][1] - signals[1, 250:5000]).max() < 1e-4 and np.abs(got[1][1] - signals[0, 250:5000]).max() < 1e-4
    assert len(joined([r for r in found if r["window_id"] == 2])[2][1]) == RATE
