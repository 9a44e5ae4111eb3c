"""Recordings read by seeking: a data source that plans byte ranges from a recording's index.

``spark.read.format("recording").load(path)`` gives one row per channel and grid chunk of
``CHUNK`` samples. Filters on stream, channel, t_start and t_end reach the plan, so a window
of two seconds reads the chunks it touches and nothing else; a partition is a range of
chunks of one stream, of about ``PART_BYTES``. Structure comes from the index (a tank's
.tsq, a BrainVision header, an EDF header) alone. ``read_window`` cuts the chunks to the
half-open sample window and gives channels in the order asked for; ``read_windows`` does so
for a table of windows over many recordings, planned in the tasks.

Stores are opened through pyarrow's filesystems, which seek locally, on HDFS and in object
stores. The planner reads each index on the driver, one recording at a time: it is for one or
some recordings. For many, ``read_windows`` reads the indices where the windows are dealt.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidewave.sources.recordings import TANK_FORMATS, TANK_RECORD, TANK_STREAM, TANK_STROBE_ON, parse_vision_header

CHUNK = 4096
PART_BYTES = 16 << 20
#: Two byte ranges closer than this are one read.
GAP = 4096
TANK_STROBE_OFF, TANK_HEADER_WORDS = 0x102, 10
#: Kinds of channels that EDF labels and electrode names begin with.
KINDS = ("EEG", "EMG", "ECG", "EKG", "EOG", "MEG", "SEEG", "ECOG", "DBS", "RESP", "TEMP", "STIM", "MISC")
ROWS = "path string, format string, stream string, channel string, k int, sfreq double, t0_idx long, t_start double, t_end double, x array<double>"


@dataclass(frozen=True)
class Stream:
    """Where the samples of one stream lie.

    ``offsets`` (one array per channel) says where each record of ``per_record`` samples
    begins. Without it the file is frames of ``frame_bytes`` from ``base`` on; channel k has
    ``counts[k]`` samples in each, from element ``firsts[k]`` on.
    """

    name: str
    rate: float
    n: int
    channels: tuple[str, ...]
    data: str
    dtype: str
    start: float = 0.0
    per_record: int = 0
    offsets: tuple[np.ndarray, ...] = ()
    base: int = 0
    frame_bytes: int = 0
    firsts: tuple[int, ...] = ()
    counts: tuple[int, ...] = ()
    gains: tuple[tuple[float, float], ...] = ()  # (factor, addend) per channel


@dataclass(frozen=True)
class Recording:
    path: str
    format: str
    streams: dict[str, Stream]
    events: list[tuple] = field(default_factory=list)  # label, i, onset, offset, value


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _bytes(path: str) -> bytes:
    store, at = open_store(path)
    with store.open_input_file(at) as f:
        return f.read()


def time_to_sample(rate: float, t: float) -> int:
    """Half to even, as everywhere here."""
    return round(t * rate)


# --- indices ------------------------------------------------------------------------------


def _sibling(path: str, suffix: str) -> str:
    return path[: path.rindex(".")] + suffix


def _text(code: bytes) -> str:
    return code.decode("latin-1").rstrip("\0").strip()


def index_tank(path: str) -> Recording:
    """Stores and strobes of a tank index; the data file need not be there."""
    raw = _bytes(path)
    rows = np.frombuffer(raw[: len(raw) // TANK_RECORD.itemsize * TANK_RECORD.itemsize], TANK_RECORD)
    zero = float(rows["time"][rows["time"] > 0].min()) if (rows["time"] > 0).any() else 0.0
    streams = {}
    for code in np.unique(rows["code"][rows["type"] == TANK_STREAM]):
        own = rows[(rows["type"] == TANK_STREAM) & (rows["code"] == code)]
        if not (name := _text(code)):
            continue
        kind = np.dtype(TANK_FORMATS.get(int(own["format"][0]), TANK_FORMATS[0]))
        per = (int(own["size"][0]) - TANK_HEADER_WORDS) * 4 // kind.itemsize
        ids = np.unique(own["channel"])
        order = np.lexsort((own["time"], own["channel"]))  # stable within equal times
        parts = np.split(own["offset"][order].astype(np.int64), np.flatnonzero(np.diff(own["channel"][order])) + 1)
        streams[name] = Stream(
            name, float(own["rate"][0]), len(parts[0]) * per, tuple(str(int(c)) for c in ids), _sibling(path, ".tev"), kind.str,
            start=float(own["time"].min()), per_record=per, offsets=tuple(parts), gains=((1.0, 0.0),) * len(ids),
        )
    events = []
    on, off = rows[rows["type"] == TANK_STROBE_ON], rows[rows["type"] == TANK_STROBE_OFF]
    for code in np.unique(on["code"]):
        begins, ends = on[on["code"] == code], off[off["code"] == code]
        if not (name := _text(code)):
            continue
        for i, r in enumerate(begins):
            end = float(ends["time"][i]) - zero if i < len(ends) else None
            events.append((name, i, float(r["time"]) - zero, end, float(np.int64(r["offset"]).view(np.float64))))
    return Recording(path, "tank", streams, events)


def _kind(label: str) -> str:
    return next((k.lower() for k in KINDS if label.upper().startswith(k)), "eeg")


def _by_kind(labels: Sequence[str], rates: Sequence[float]) -> dict[str, list[int]]:
    """Channels of one kind are a stream; kinds recorded at several rates are one stream per rate."""
    groups: dict[tuple[str, float], list[int]] = {}
    for i, (label, rate) in enumerate(zip(labels, rates, strict=True)):
        groups.setdefault((_kind(label), rate), []).append(i)
    kinds = [k for k, _ in groups]
    return {k if kinds.count(k) == 1 else f"{k}@{rate:g}": own for (k, rate), own in groups.items()}


def index_vision(path: str) -> Recording:
    head = parse_vision_header(_bytes(path).decode("utf-8", "replace"))
    data = _sibling(path, ".eeg")
    store, at = open_store(data)
    item, n = np.dtype(head["dtype"]).itemsize, len(head["channels"])
    samples = store.get_file_info(at).size // item // n
    streams = {}
    for name, own in _by_kind([c for c, _ in head["channels"]], [head["sfreq"]] * n).items():
        names, gains = tuple(head["channels"][i][0] for i in own), tuple((head["channels"][i][1], 0.0) for i in own)
        if head["multiplexed"]:
            streams[name] = Stream(name, head["sfreq"], samples, names, data, head["dtype"], frame_bytes=n * item, firsts=tuple(own), counts=(1,) * len(own), gains=gains)
        else:
            # A channel is one run of samples; it is cut into records of a chunk.
            cuts = np.arange(0, samples, CHUNK, dtype=np.int64)
            streams[name] = Stream(name, head["sfreq"], samples, names, data, head["dtype"], per_record=CHUNK, offsets=tuple((i * samples + cuts) * item for i in own), gains=gains)
    events = []
    marks = _sibling(path, ".vmrk")
    store, at = open_store(marks)
    if store.get_file_info(at).type == pafs.FileType.File:
        seen: dict[str, int] = {}
        for line in _bytes(marks).decode("utf-8", "replace").splitlines():
            if found := re.match(r"Mk\d+=([^,]*),([^,]*),(\d+)(?:,(\d+))?", line):
                label, onset = found[2] or found[1], (int(found[3]) - 1) / head["sfreq"]
                i = seen[label] = seen.get(label, -1) + 1
                events.append((label, i, onset, onset + int(found[4] or 0) / head["sfreq"], None))
    return Recording(path, "brainvision", streams, events)


def index_edf(path: str) -> Recording:
    store, where = open_store(path)
    with store.open_input_file(where) as f:
        head = f.read(256)
        n_header, n_records, seconds, n = int(head[184:192]), int(head[236:244]), float(head[244:252]), int(head[252:256])
        fields, at, size = f.read(n_header - 256), 0, f.size()
    columns = []
    for width in (16, 80, 8, 8, 8, 8, 8, 80, 8, 32):
        columns.append([fields[at + i * width : at + (i + 1) * width].decode("latin-1").strip() for i in range(n)])
        at += n * width
    labels, (lo, hi, dlo, dhi), counts = columns[0], ([float(v) for v in columns[c]] for c in (3, 4, 5, 6)), [int(v) for v in columns[8]]
    frame = 2 * sum(counts)
    records = (size - n_header) // frame if n_records < 0 else min(n_records, (size - n_header) // frame)
    firsts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    signals = [i for i in range(n) if not labels[i].startswith("EDF Annotations")]
    streams = {}
    for name, own in _by_kind([labels[i] for i in signals], [counts[i] / seconds for i in signals]).items():
        own = [signals[i] for i in own]
        gains = tuple(((hi[i] - lo[i]) / (dhi[i] - dlo[i]), lo[i] - dlo[i] * (hi[i] - lo[i]) / (dhi[i] - dlo[i])) for i in own)
        count = counts[own[0]]
        streams[name] = Stream(
            name, count / seconds, records * count, tuple(labels[i] for i in own), path, "<i2",
            base=n_header, frame_bytes=frame, firsts=tuple(int(firsts[i]) for i in own), counts=(count,) * len(own), gains=gains,
        )
    return Recording(path, "edf", streams)


#: Formats by name: the suffix of a recording's entry file, a look at its first bytes, and its index.
FORMATS: dict[str, tuple[str, Callable[[bytes], bool], Callable[[str], Recording]]] = {
    "tank": (".tsq", lambda head: True, index_tank),
    "brainvision": (".vhdr", lambda head: b"Vision" in head[:80], index_vision),
    "edf": (".edf", lambda head: head[:8].strip() == b"0", index_edf),
}


def entries(path: str, format: str | None = None) -> list[tuple[str, str]]:
    """Entry files below a path with their formats: the declared one, else the only one that fits. A file that none fits raises."""
    if format is not None and format not in FORMATS:
        raise ValueError(f"unknown format {format}; known are {', '.join(sorted(FORMATS))}")
    store, at = open_store(path)
    info = store.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    if info.type == pafs.FileType.File:
        files, single = [at], True
    else:
        files, single = sorted(f.path for f in store.get_file_info(pafs.FileSelector(at, recursive=True)) if f.type == pafs.FileType.File), False
    found = []
    for f in files:
        with store.open_input_file(f) as handle:
            head = handle.read(256) if PurePosixPath(f).suffix.lower() in {s for s, _, _ in FORMATS.values()} or single else b""
        fits = [k for k, (suffix, looks, _) in FORMATS.items() if (format is None or k == format) and PurePosixPath(f).suffix.lower() == suffix and looks(head)]
        if single and len(fits) != 1 and format is None:
            raise ValueError(f"{len(fits)} formats fit {PurePosixPath(f).name}")
        if single and format is not None:
            fits = [format]
        found += [(prefix + f, fits[0])] if len(fits) == 1 else []
    if not found:
        raise ValueError(f"no recording below {path}")
    return found


def open_recording(path: str, format: str | None = None) -> Recording:
    """The one recording at a path; none or several raise."""
    found = entries(path, format)
    if len(found) != 1:
        raise ValueError(f"{len(found)} recordings below {path}")
    return FORMATS[found[0][1]][2](found[0][0])


# --- reading ------------------------------------------------------------------------------


@dataclass
class Piece(InputPartition):
    """Chunks [c0, c1) of some channels of a stream, and the reads that bring them."""

    path: str
    format: str
    stream: Stream
    picked: tuple[int, ...]
    c0: int
    c1: int

    def span(self) -> tuple[int, int]:
        return self.c0 * CHUNK, min(self.c1 * CHUNK, self.stream.n)

    def records(self) -> list[tuple[int, int, int, int]]:
        """(channel, first sample, offset, bytes) of every record, or of every run of frames, in the span."""
        s, (lo, hi) = self.stream, self.span()
        item = np.dtype(s.dtype).itemsize
        if hi <= lo:
            return []
        if s.offsets:
            out = []
            for k in self.picked:
                a, b = lo // s.per_record, min(-(-hi // s.per_record), len(s.offsets[k]))
                out += [(k, r * s.per_record, int(s.offsets[k][r]), min(s.per_record, s.n - r * s.per_record) * item) for r in range(a, b)]
            return out
        count = s.counts[self.picked[0]]
        a, b = lo // count, -(-hi // count)
        return [(-1, a * count, s.base + a * s.frame_bytes, (b - a) * s.frame_bytes)]

    def reads(self) -> list[tuple[int, int]]:
        """(offset, bytes): the records' ranges, near ones joined."""
        out: list[list[int]] = []
        for _, _, at, size in sorted(self.records(), key=lambda r: r[2]):
            if out and at <= out[-1][0] + out[-1][1] + GAP:
                out[-1][1] = max(out[-1][1], at + size - out[-1][0])
            else:
                out.append([at, size])
        return [(at, size) for at, size in out]

    def slim(self) -> Piece:
        """The same without the offsets of records elsewhere, so that a task gets only its own."""
        s = self.stream
        if not s.offsets:
            return self
        lo, hi = self.span()
        a, b = lo // s.per_record, -(-hi // s.per_record)
        own = tuple(s.offsets[k][a:b] if k in self.picked else s.offsets[k][:0] for k in range(len(s.offsets)))
        return _Shifted(self.path, self.format, Stream(**{**s.__dict__, "offsets": own}), self.picked, self.c0, self.c1, a)

    def samples(self) -> dict[int, np.ndarray]:
        """Every picked channel's samples in the span."""
        s, (lo, hi) = self.stream, self.span()
        records, kind = self.records(), np.dtype(s.dtype)
        if not records:
            return {k: np.zeros(0) for k in self.picked}
        store, at = open_store(s.data)
        got: list[tuple[int, bytes]] = []
        with store.open_input_file(at) as f:
            for offset, size in self.reads():
                f.seek(offset)
                got.append((offset, f.read(size)))
        begins = [o for o, _ in got]
        out = {}
        parts: dict[int, list[np.ndarray]] = {k: [] for k in self.picked}
        for k, _, offset, size in records:
            i = int(np.searchsorted(begins, offset, side="right")) - 1
            data = got[i][1][offset - begins[i] : offset - begins[i] + size]
            values = np.frombuffer(data[: len(data) // kind.itemsize * kind.itemsize], kind)
            if k >= 0:
                parts[k].append(values)
                continue
            frames = values.reshape(-1, s.frame_bytes // kind.itemsize)
            for c in self.picked:
                parts[c].append(frames[:, s.firsts[c] : s.firsts[c] + s.counts[c]].reshape(-1))
        skip = lo - records[0][1]
        for k in self.picked:
            factor, addend = s.gains[k]
            out[k] = np.concatenate(parts[k])[skip : skip + hi - lo].astype(float) * factor + addend
        return out


@dataclass
class _Shifted(Piece):
    """A piece whose offsets begin at record ``first``."""

    first: int = 0

    def records(self) -> list[tuple[int, int, int, int]]:
        s, (lo, hi) = self.stream, self.span()
        item = np.dtype(s.dtype).itemsize
        out = []
        for k in self.picked:
            for j, at in enumerate(s.offsets[k].tolist()):
                i = (self.first + j) * s.per_record
                if i < hi and i + s.per_record > lo:
                    out.append((k, i, at, min(s.per_record, s.n - i) * item))
        return out


def plan(recording: Recording, streams: set[str] | None = None, channels: set[str] | None = None, tmin: float | None = None, tmax: float | None = None) -> list[Piece]:
    """The pieces that hold what is asked for: chunks that reach past tmin and begin before tmax."""
    out = []
    for s in recording.streams.values():
        picked = tuple(k for k, c in enumerate(s.channels) if channels is None or c in channels)
        if streams is not None and s.name not in streams or not picked or not s.n:
            continue
        last = -(-s.n // CHUNK)
        # One chunk to spare on either side: the exact test is Spark's, on the rows.
        c0 = 0 if tmin is None else min(max(int(np.floor(tmin * s.rate / CHUNK + 1e-9)), 0), last)
        c1 = last if tmax is None else min(max(int(np.ceil(tmax * s.rate / CHUNK - 1e-9)), 0), last)
        width = len(s.counts) and s.frame_bytes / s.counts[picked[0]] or len(picked) * np.dtype(s.dtype).itemsize
        step = max(1, int(PART_BYTES // (CHUNK * width)))
        out += [Piece(recording.path, recording.format, s, picked, c, min(c + step, c1)).slim() for c in range(c0, c1, step)]
    return out


def rows_of(piece: Piece) -> Iterator[pa.RecordBatch]:
    s, (lo, hi) = piece.stream, piece.span()
    got = piece.samples()
    names = [f.split()[0] for f in ROWS.split(", ")]
    kinds = [pa.string()] * 4 + [pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
    for k in piece.picked:
        rows = [
            (piece.path, piece.format, s.name, s.channels[k], k, s.rate, i, i / s.rate, min(i + CHUNK, hi) / s.rate, got[k][i - lo : i - lo + CHUNK])
            for i in range(lo, hi, CHUNK)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class RecordingReader(DataSourceReader):
    def __init__(self, path: str, format: str | None):
        self.path, self.format = path, format
        self.streams: set[str] | None = None
        self.channels: set[str] | None = None
        self.tmin: float | None = None
        self.tmax: float | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if names is not None and f.attribute == ("stream",):
                self.streams = names if self.streams is None else self.streams & names
            elif names is not None and f.attribute == ("channel",):
                self.channels = names if self.channels is None else self.channels & names
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute in (("t_end",), ("t_start",)):
                self.tmin = f.value if self.tmin is None else max(self.tmin, f.value)
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute in (("t_start",), ("t_end",)):
                self.tmax = f.value + (1e-9 if isinstance(f, LessThanOrEqual) else 0.0) if self.tmax is None else min(self.tmax, f.value)
            yield f  # Spark applies all of them again: the plan only leaves out what can't fit

    def partitions(self) -> list[Piece]:
        return [p for path, kind in entries(self.path, self.format) for p in plan(FORMATS[kind][2](path), self.streams, self.channels, self.tmin, self.tmax)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from rows_of(partition)


class RecordingSource(DataSource):
    """``format("recording")`` with options path and, if it is declared, format."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options["path"], self.options.get("recordingformat"))


def chunks(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """The grid chunks of all recordings below a path, lazily: filters on stream, channel, t_start and t_end prune."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)
    reader = spark.read.format("recording")
    return (reader.option("recordingformat", format) if format else reader).load(path)


def stream_table(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """path, format, stream, n_channels, sfreq, n_samples, dtype, start, channels of every stream below a path, from indices alone."""
    rows = [
        (p, kind, s.name, len(s.channels), s.rate, s.n, s.dtype, s.start, list(s.channels))
        for p, kind in entries(path, format)
        for s in FORMATS[kind][2](p).streams.values()
    ]
    return spark.createDataFrame(rows, "path string, format string, stream string, n_channels int, sfreq double, n_samples long, dtype string, start double, channels array<string>")


def event_table(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """path, label, i, onset, offset, value; an event that never ends has no offset."""
    rows = [(p, *e) for p, kind in entries(path, format) for e in FORMATS[kind][2](p).events]
    return spark.createDataFrame(rows, "path string, label string, i int, onset double, offset double, value double")


def available_events(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """path, label, n: the event labels that recordings carry."""
    return event_table(spark, path, format).groupBy("path", "label").agg(F.count(F.lit(1)).alias("n"))


def find_blocks(root: str) -> list[tuple[str, str]]:
    """(study, block folder) of every folder below a study's that holds a recording, at any depth; hidden and underscored studies are passed over."""
    store, at = open_store(root)
    suffixes = {s for s, _, _ in FORMATS.values()}
    found = set()
    for f in store.get_file_info(pafs.FileSelector(at, recursive=True)):
        parts = PurePosixPath(f.path).relative_to(at).parts
        if f.type == pafs.FileType.File and len(parts) > 1 and not parts[0].startswith(("_", ".")) and PurePosixPath(f.path).suffix.lower() in suffixes:
            found.add((parts[0], str(PurePosixPath(f.path).parent)))
    return sorted(found)


def find_sweeps(folder: str) -> list[str]:
    """Impedance tables beside a recording: CSV files of the folder itself whose first line names a contact."""
    store, at = open_store(folder)
    if store.get_file_info(at).type != pafs.FileType.Directory:
        return []
    found = []
    for f in store.get_file_info(pafs.FileSelector(at)):
        if f.type == pafs.FileType.File and f.path.endswith(".csv"):
            with store.open_input_file(f.path) as handle:
                first = handle.read(65_536).split(b"\n")[0].decode("utf-8", "replace")
            if any(re.match(r"\s*R\d+ \(kOhm\)", c) for c in first.split(",")):
                found.append(f.path)
    return sorted(found)


def inspect(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """What a tree of recordings states about itself: its streams (study, block, stream, ..., duration_s, usable_hz, events), and what can't be read (block, error)."""
    streams, unreadable = [], []
    for study, block in find_blocks(root):
        try:
            recording = open_recording(block)
        except Exception as error:  # one unreadable block is a row
            unreadable.append((block, f"{type(error).__name__}: {error}"))
            continue
        labels: dict[str, int] = {}
        for event in recording.events:
            labels[event[0]] = labels.get(event[0], 0) + 1
        streams += [(study, PurePosixPath(block).name, recording.format, s.name, len(s.channels), s.rate, s.n, s.n / s.rate, s.rate / 2, list(s.channels), labels) for s in recording.streams.values()]
    told = "study string, block string, format string, stream string, n_channels int, sfreq double, n_samples long, duration_s double, usable_hz double, channels array<string>, events map<string,int>"
    return spark.createDataFrame(streams, told), spark.createDataFrame(unreadable, "block string, error string")


def _window(s: Stream, channels: Sequence[str | int] | None, tmin: float | None, tmax: float | None) -> tuple[list[int], int, int]:
    """Places of the channels in the order asked for, and the half-open sample window."""
    picked = []
    for c in range(len(s.channels)) if channels is None else channels:
        if isinstance(c, str) and c in s.channels:
            picked.append(s.channels.index(c))
        elif isinstance(c, int) and 0 <= c < len(s.channels):
            picked.append(c)
        else:
            raise IndexError(f"channel {c!r} is not one of the {len(s.channels)} of stream {s.name}")
    lo = 0 if tmin is None else time_to_sample(s.rate, tmin)
    hi = s.n if tmax is None else time_to_sample(s.rate, tmax)
    if hi < lo:
        raise ValueError(f"tmax {tmax} is before tmin {tmin} in stream {s.name}")
    return picked, min(max(lo, 0), s.n), min(max(hi, 0), s.n)


def read_window(spark: SparkSession, path: str, stream: str, channels: Sequence[str | int] | None = None, tmin: float | None = None, tmax: float | None = None, format: str | None = None) -> DataFrame:
    """k, channel, t0_idx, x of one recording: samples in [tmin, tmax), k counts the channels as they were asked for."""
    recording = open_recording(path, format)
    if stream not in recording.streams:
        raise KeyError(f"no stream {stream}; there are {', '.join(sorted(recording.streams))}")
    s = recording.streams[stream]
    picked, lo, hi = _window(s, channels, tmin, tmax)
    rows = chunks(spark, path, format).where(
        (F.col("stream") == stream) & F.col("channel").isin([s.channels[k] for k in picked]) & (F.col("t_end") > lo / s.rate) & (F.col("t_start") < hi / s.rate)
    )
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(s.channels[k]).alias("name")) for i, k in enumerate(picked)]))
    begin = F.greatest(F.lit(lo) - F.col("t0_idx"), F.lit(0))
    end = F.least(F.lit(hi) - F.col("t0_idx"), F.size("x"))
    cut = rows.select("channel", (F.col("t0_idx") + begin).alias("t0_idx"), F.slice("x", (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int")).alias("x"), asked.alias("a"))
    return cut.where((F.col("channel") == F.col("a.name")) & (F.size("x") > 0)).select("a.k", "channel", "t0_idx", "x")


def read_windows(windows: DataFrame) -> DataFrame:
    """The samples of many windows over many recordings, planned and read where the windows are dealt.

    windows: window_id, path, stream, channels (array of names, null for all), tmin, tmax.
    Gives window_id, k, channel, sfreq, t0_idx, x in chunks; a window that can't be read is a
    row with an error. Sort windows by path to read an index once per task.
    """
    out_kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.string()]
    names = ["window_id", "k", "channel", "sfreq", "t0_idx", "x", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Recording] = {}
        for batch in batches:
            for w in batch.to_pylist():
                try:
                    if w["path"] not in known:
                        known.clear()
                        known[w["path"]] = open_recording(w["path"])
                    recording = known[w["path"]]
                    s = recording.streams[w["stream"]]
                    picked, lo, hi = _window(s, w["channels"], w["tmin"], w["tmax"])
                    rows = []
                    step = max(1, int(PART_BYTES // (8 * CHUNK * max(1, len(picked)))))
                    for c in range(lo // CHUNK, -(-hi // CHUNK), step):
                        piece = Piece(recording.path, recording.format, s, tuple(sorted(set(picked))), c, min(c + step, -(-hi // CHUNK)))
                        a, b = piece.span()
                        got = piece.samples()
                        for i in range(a, b, CHUNK):
                            u, v = max(i, lo), min(i + CHUNK, hi, b)
                            rows += [(w["window_id"], n, s.channels[k], s.rate, u, got[k][u - a : v - a], None) for n, k in enumerate(picked)]
                        yield _table(rows, out_kinds, names)
                        rows = []
                except Exception as error:  # one window that can't be read is a row, not a failed job
                    yield _table([(w["window_id"], None, None, None, None, None, f"{type(error).__name__}: {error}")], out_kinds, names)

    found = windows.select("window_id", "path", "stream", "channels", "tmin", "tmax")
    return found.mapInArrow(run, "window_id long, k int, channel string, sfreq double, t0_idx long, x array<double>, error string")


def _table(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
