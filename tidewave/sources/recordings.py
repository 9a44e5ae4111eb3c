"""Recordings in EDF, BrainVision and tank files as DataFrames of chunks and events.

Files are read by Spark (``binaryFile``), so any store that Spark reaches will do, and
parsed in the tasks; a file is one row up to Spark's 2 GB limit for a binary value, and
leaves as chunks of ``CHUNK`` samples per channel. Files that can't be parsed give
one row with an error instead of failing the job.
"""

from __future__ import annotations

import configparser
import re
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 4096
CHUNKS = "path string, format string, stream string, channel string, sfreq double, t0_idx long, x array<double>, error string"
EVENTS = "path string, label string, i long, onset double, value double, error string"

#: Fixed values of the tank index: 40-byte records, and the types of its rows.
TANK_RECORD = np.dtype(
    [
        ("size", "<i4"), ("type", "<i4"), ("code", "S4"), ("channel", "<u2"), ("sort", "<u2"),
        ("time", "<f8"), ("offset", "<i8"), ("format", "<i4"), ("rate", "<f4"),
    ]
)
TANK_STROBE_ON, TANK_STREAM = 0x101, 0x8101
TANK_FORMATS = {0: "<f4", 1: "<i4", 2: "<i2", 3: "<i1", 4: "<f8"}
VISION_FORMATS = {"INT_16": "<i2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4"}

Stream = tuple[str, str, float, np.ndarray]  # stream, channel, rate, samples
READERS: dict[str, tuple[Callable[[str, bytes], bool], Callable]] = {}


def register_reader(name: str, sniff: Callable[[str, bytes], bool], read: Callable) -> None:
    """A reader by name: sniff(path, head) and read(files) -> streams, events. Twice the same name is an error."""
    if name in READERS:
        raise ValueError(f"reader {name} is there already")
    READERS[name] = (sniff, read)


def sniff(path: str, head: bytes) -> str:
    """The one format that a file looks like; none or several raise."""
    found = [name for name, (looks, _) in READERS.items() if looks(path, head)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} formats fit {PurePosixPath(path).name}")
    return found[0]


def read_edf(files: dict[str, bytes]) -> tuple[list[Stream], list[tuple]]:
    (data,) = files.values()
    n_header, n_records, seconds, n = (int(data[184:192]), int(data[236:244]), float(data[244:252]), int(data[252:256]))
    at = 256

    def fields(width: int) -> list[str]:
        nonlocal at
        out = [data[at + i * width : at + (i + 1) * width].decode("latin-1").strip() for i in range(n)]
        at += n * width
        return out

    names, _, _ = fields(16), fields(80), fields(8)
    lo, hi, dlo, dhi = ([float(v) for v in fields(8)] for _ in range(4))
    _, counts = fields(80), [int(v) for v in fields(8)]
    raw = np.frombuffer(data, "<i2", offset=n_header)
    records = len(raw) // sum(counts) if n_records < 0 else n_records
    raw = raw[: records * sum(counts)].reshape(records, -1)
    edges = np.concatenate([[0], np.cumsum(counts)])
    streams = []
    for i, name in enumerate(names):
        if not name.startswith("EDF Annotations"):
            gain = (hi[i] - lo[i]) / (dhi[i] - dlo[i])
            x = (raw[:, edges[i] : edges[i + 1]].reshape(-1) - dlo[i]) * gain + lo[i]
            streams.append((f"{counts[i] / seconds:g}Hz", name, counts[i] / seconds, x))
    return streams, []


def parse_vision_header(text: str) -> dict:
    parser = configparser.ConfigParser(interpolation=None, strict=False)
    parser.optionxform = str
    parser.read_string(text[text.index("[") :].split("[Comment]")[0])
    common = parser["Common Infos"]
    channels = [v.split(",") for _, v in sorted(parser["Channel Infos"].items(), key=lambda kv: int(kv[0][2:]))]
    return {
        "sfreq": 1e6 / float(common["SamplingInterval"]),
        "multiplexed": common.get("DataOrientation", "MULTIPLEXED") == "MULTIPLEXED",
        "dtype": VISION_FORMATS[parser["Binary Infos"]["BinaryFormat"]] if "Binary Infos" in parser else "<i2",
        "channels": [(c[0].replace(r"\1", ","), float(c[2]) if len(c) > 2 and c[2].strip() else 1.0) for c in channels],
    }


def read_vision(files: dict[str, bytes]) -> tuple[list[Stream], list[tuple]]:
    by = {PurePosixPath(p).suffix: d for p, d in files.items()}
    head = parse_vision_header(by[".vhdr"].decode("utf-8", "replace"))
    n = len(head["channels"])
    raw = np.frombuffer(by[".eeg"], head["dtype"])
    x = raw[: len(raw) // n * n].reshape(-1, n).T if head["multiplexed"] else raw.reshape(n, -1)
    streams = [("eeg", name, head["sfreq"], x[i] * gain) for i, (name, gain) in enumerate(head["channels"])]
    events = []
    for line in by.get(".vmrk", b"").decode("utf-8", "replace").splitlines():
        if found := re.match(r"Mk\d+=([^,]*),([^,]*),(\d+)", line):
            events.append((found[2] or found[1], (int(found[3]) - 1) / head["sfreq"], None))
    return streams, events


def read_tank(files: dict[str, bytes]) -> tuple[list[Stream], list[tuple]]:
    by = {PurePosixPath(p).suffix: d for p, d in files.items()}
    rows = np.frombuffer(by[".tsq"], TANK_RECORD)
    t0 = rows["time"][rows["time"] > 0].min() if (rows["time"] > 0).any() else 0.0
    streams = []
    stored = rows[rows["type"] == TANK_STREAM]
    for code in np.unique(stored["code"]):
        for channel in np.unique(stored["channel"][stored["code"] == code]):
            own = np.sort(stored[(stored["code"] == code) & (stored["channel"] == channel)], order="time")
            kind = np.dtype(TANK_FORMATS[int(own["format"][0])])
            parts = [np.frombuffer(by[".tev"], kind, (int(r["size"]) - 10) * 4 // kind.itemsize, int(r["offset"])) for r in own]
            streams.append((code.decode(), f"{channel}", float(own["rate"][0]), np.concatenate(parts).astype(float)))
    marks = rows[rows["type"] == TANK_STROBE_ON]
    # The value of a strobe stands in the bits of the offset.
    events = [(r["code"].decode(), float(r["time"] - t0), float(np.int64(r["offset"]).view(np.float64))) for r in marks]
    return streams, events


register_reader("edf", lambda path, head: head[:8] == b"0       ", read_edf)
register_reader("brainvision", lambda path, head: path.endswith(".vhdr") and b"Vision" in head[:80], read_vision)
register_reader("tank", lambda path, head: path.endswith(".tsq"), read_tank)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The files of each recording together: same folder and name, whatever the suffix."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return found.withColumn("recording", F.regexp_replace("path", r"\.[^./]+$", ""))


def _parse(rows: pd.DataFrame):
    files = dict(zip(rows["path"], rows["content"], strict=True))
    heads = [p for p in files if p.endswith((".edf", ".vhdr", ".tsq"))]
    name = sniff(heads[0], files[heads[0]][:256]) if heads else sniff(rows["path"].iloc[0], b"")
    return name, *READERS[name][1](files)


def read_chunks(spark: SparkSession, path: str, channels: list[str] | None = None, tmin: float = 0.0, tmax: float | None = None) -> DataFrame:
    """Chunks of the channels asked for, of samples in [tmin, tmax): both bounds rounded half to even."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        where, out = rows["recording"].iloc[0], []
        try:
            name, streams, _ = _parse(rows)
        except Exception as error:  # one unreadable file is a row, not a failed job
            return pd.DataFrame([(where, None, None, None, None, None, None, f"{type(error).__name__}: {error}")], columns=_names(CHUNKS))
        for stream, channel, rate, x in streams:
            if channels is None or channel in channels:
                lo = min(max(round(tmin * rate), 0), len(x))
                hi = len(x) if tmax is None else min(max(round(tmax * rate), 0), len(x))
                out += [(where, name, stream, channel, rate, at, x[at : min(at + CHUNK, hi)].astype(float), None) for at in range(lo, hi, CHUNK)]
        return pd.DataFrame(out, columns=_names(CHUNKS))

    return _files(spark, path).groupBy("recording").applyInPandas(run, CHUNKS)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of the recordings: label, number within the label, onset in seconds, value; error for those that can't be read."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            _, _, events = _parse(rows)
        except Exception as error:  # one unreadable recording is a row, not a failed job
            return pd.DataFrame([{"path": rows["recording"].iloc[0], "error": f"{type(error).__name__}: {error}"}], columns=_names(EVENTS), dtype=object)
        found = pd.DataFrame(events, columns=["label", "onset", "value"]).sort_values(["label", "onset"])
        found["i"] = found.groupby("label").cumcount()
        found["path"], found["error"] = rows["recording"].iloc[0], None
        return found[_names(EVENTS)]

    return _files(spark, path).groupBy("recording").applyInPandas(run, EVENTS)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def long_samples(chunks: DataFrame) -> DataFrame:
    """path, stream, channel, i, value: a row per sample."""
    each = chunks.where("error is null").select("path", "stream", "channel", "t0_idx", F.posexplode("x").alias("p", "value"))
    return each.select("path", "stream", "channel", (F.col("t0_idx") + F.col("p")).alias("i"), "value")


def read_impedance(spark: SparkSession, path: str) -> DataFrame:
    """contact, kohm of wide sweeps with columns like ``R1 (kOhm)``: -1 is missing, later rows win."""
    wide = spark.read.option("header", "true").csv(path)
    columns = {c: int(m[1]) for c in wide.columns if (m := re.match(r"\s*R(\d+) \(kOhm\)", c))}
    rows = wide.withColumn("row_no", F.monotonically_increasing_id())
    each = rows.select("row_no", F.explode(F.array(*[F.struct(F.lit(k).alias("contact"), F.col(f"`{c}`").try_cast("double").alias("v")) for c, k in columns.items()])).alias("e"))
    kept = each.select("row_no", "e.contact", F.nullif("e.v", F.lit(-1.0)).alias("v")).where("v is not null")
    return kept.groupBy("contact").agg(F.max_by("v", "row_no").alias("kohm"))
