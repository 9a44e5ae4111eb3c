"""Suffix-array dedup: bytes covered by a long string that an earlier document holds.

Every byte covered by a ``LENGTH``-byte string (a window) that also starts in a document
with a smaller doc_id is removed.

Documents are packed into batches of ``BATCH_BYTES`` as they are read; a batch is the
unit the index grows by. Two scans over buckets, each a task of its own, give the result:

1. Which windows can occur elsewhere. The ``GRAM``-byte string of a window with the least
   fingerprint is its anchor, so equal windows have equal anchors, and neighbouring
   windows mostly share theirs (about one anchor in 14 bytes). Batches send their distinct
   anchors, by five bytes of fingerprint; a bucket answers which of them other batches
   hold, and which very many hold.
2. Which windows do. A batch sends the windows of shared anchors to the anchor's bucket, as
   runs of text, each distinct run once. A bucket runs a logarithmic family: every batch's
   windows become a suffix array (positions in lexicographic order of the ``LENGTH`` bytes
   that follow), which joins as the newest level; levels of like size merge, and equal
   neighbours in a merge are the long matches. In the end all levels are one, and every
   window knows the smallest doc_id that holds it. The answer is that doc_id, run-length
   coded. Fingerprints only nominate: what is removed follows from bytes.

Windows of an anchor that more than ``HOT_BATCHES`` batches hold are sent one by one, to
buckets by a hash of the window, so that a passage which a third of all documents share
doesn't bring all its surroundings to one task. Documents whose text an earlier document
holds as a whole go whole, and send nothing in scan 2; they are told by a 128-bit
cryptographic digest (BLAKE2b).

Defined results for odd input: null text is empty; documents shorter than ``LENGTH``
lose nothing; rows without a doc_id lose nothing and cause nothing; rows that share a
doc_id are one document for each other (none is earlier); an empty table gives an
empty result; a very long text is a batch of its own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm.common import cut, require, table

LENGTH, GRAM = 50, 24
#: Bytes of text in a batch, and bytes of text per bucket.
BATCH_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
#: Bytes of an anchor's fingerprint that travel, besides those its bucket stands for.
KEY_BYTES = 5
#: Anchors that more batches hold have their windows dealt one by one.
HOT_BATCHES = 512
#: Bytes of text that are fingerprinted at a time.
CHUNK = 1 << 19

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93)
_ROW = f"V{LENGTH}"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _C
    x ^= x >> _U(29)
    x *= _A
    x ^= x >> _U(32)
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Fingerprints of all GRAM-byte strings, from the 8-byte words they consist of."""
    n = len(data) - GRAM + 1
    b = data.astype(np.uint64)
    w = b[:-1] | (b[1:] << _U(8))
    w = w[:-2] | (w[2:] << _U(16))
    w = _mix(w[:-4] | (w[4:] << _U(32)))
    x = w[:n] * _A
    for at in range(8, GRAM, 8):
        x = x * _B + w[at : at + n]
    return _mix(x)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of width values."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def press(*parts: np.ndarray) -> bytes:
    """Arrays of bytes or numbers, one after the other, compressed."""
    return zstandard.ZstdCompressor(level=3, write_content_size=True).compress(b"".join(p.tobytes() for p in parts))


def unpress(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


class Batch:
    """Some documents: ids (0 where there is none), whether they have one, and their UTF-8 bytes."""

    def __init__(self, ids: np.ndarray, named: np.ndarray, lengths: np.ndarray, data: bytes):
        self.ids, self.named, self.lengths, self.data = ids, named, lengths, data
        self.ends = np.cumsum(lengths)

    @staticmethod
    def of(row: dict) -> Batch:
        columns = zip(("ids", "named", "lengths"), (np.int64, bool, np.int64), strict=True)
        return Batch(*[np.frombuffer(row[c], kind) for c, kind in columns], unpress(row["data"]))

    def runs(self) -> tuple[np.ndarray, ...]:
        """Runs of windows with one anchor: its key, the first window's place, their number, the document."""
        parts = []
        heads = self.ends - self.lengths
        first = 0
        while first < len(self.ids):
            last = max(first + 1, int(np.searchsorted(self.ends, heads[first] + CHUNK, "right")))
            parts.append(self._runs(first, last, heads))
            first = last
        if not parts:
            return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def _runs(self, first: int, last: int, heads: np.ndarray) -> tuple[np.ndarray, ...]:
        base, end = int(heads[first]), int(self.ends[last - 1])
        if end - base < LENGTH or not self.named[first:last].any():
            return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
        data = np.frombuffer(self.data, np.uint8, end - base, base)
        least = _least(gram_hashes(data), LENGTH - GRAM + 1)
        document = np.repeat(np.arange(first, last), self.lengths[first:last])[: len(least)]
        # A window ends within its document; so two documents' windows are never neighbours.
        inside = (np.arange(base + LENGTH, base + LENGTH + len(least)) <= self.ends[document]) & self.named[document]
        same = inside[1:] & inside[:-1] & (least[1:] == least[:-1])
        begins = np.flatnonzero(inside & ~np.concatenate([[False], same]))
        stops = np.flatnonzero(inside & ~np.concatenate([same, [False]]))
        # Anchors are least values, so they crowd near 0: mixed again they fill all buckets alike.
        return _mix(least[begins] ^ _B), begins + base, stops - begins + 1, document[begins]

    def anchors(self, keys: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, which of them two documents here hold, and the place of each key among them."""
        order = np.argsort(keys, kind="stable")
        ordered, ids = keys[order], self.ids[documents[order]]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(keys)]
        heads, place = np.flatnonzero(new), np.empty(len(keys), np.int64)
        place[order] = np.cumsum(new) - 1
        if not len(heads):
            return ordered, np.zeros(0, bool), place
        return ordered[heads], np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads), place


def pack_batches(documents: DataFrame, batch_bytes: int) -> DataFrame:
    """batch, n_bytes, ids, named, lengths, digests, data: documents in rows of about batch_bytes of text."""
    names = ["n_bytes", "ids", "named", "lengths", "digests", "data"]

    def row(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        digests = b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in texts)
        values = [
            sum(map(len, texts)), np.array([i or 0 for i in ids], np.int64).tobytes(),
            np.array([i is not None for i in ids], bool).tobytes(), np.array(list(map(len, texts)), np.int64).tobytes(),
            digests, zstandard.ZstdCompressor(level=3).compress(b"".join(texts)),
        ]
        kinds = [pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if ids and size + len(data) > batch_bytes:
                    yield row(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i.as_py())
                texts.append(data)
                size += len(data)
        if ids:
            yield row(ids, texts)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = docs.mapInArrow(pack, "n_bytes long, " + ", ".join(f"{n} binary" for n in names[1:]))
    return packed.withColumn("batch", F.monotonically_increasing_id())


def copied_documents(packed: DataFrame) -> DataFrame:
    """batch, at (its place in the batch): documents whose whole text a document with a smaller id holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, ids, named, lengths, digests in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                known = np.flatnonzero(np.frombuffer(named, bool) & (np.frombuffer(lengths, np.int64) >= LENGTH))
                own = [digests[16 * i : 16 * i + 16] for i in known]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(known), b)), pa.array(known), pa.array(np.frombuffer(ids, np.int64)[known]), pa.array(own, pa.binary())],
                    names=["batch", "at", "id", "digest"],
                )

    columns = ("batch", "ids", "named", "lengths", "digests")
    texts = packed.select(*columns).mapInArrow(run, "batch long, at long, id long, digest binary")
    first = texts.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    return texts.join(first.select("digest", "least"), "digest").where("id > least").select("batch", "at")


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _by_bucket(where: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Sorted bucket numbers as (bucket, slice)."""
    ends = [*np.flatnonzero(where[1:] != where[:-1]) + 1, len(where)] if len(where) else []
    for a, b in zip([0, *ends], ends):
        yield int(where[a]), slice(int(a), int(b))


def _narrow(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def _wide(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, KEY_BYTES)
    return out.reshape(-1).view("<u8")


def scan_anchors(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's answer to every batch: which of its anchors other batches hold, and which are hot."""
    keys = [_wide(x) for x in rows["keys"]]
    distinct, batches = np.unique(np.concatenate([np.unique(k) for k in keys]), return_counts=True)
    found = [batches[np.searchsorted(distinct, k)] for k in keys]
    bits = [np.packbits(np.concatenate([n > 1, n > HOT_BATCHES])).tobytes() for n in found]
    return pd.DataFrame({"batch": rows["batch"], "bucket": rows["bucket"], "n": list(map(len, keys)), "z": bits})


class LogarithmicFamily:
    """Suffix arrays over one text, of which each level is more than twice as long as the next.

    A level lists distinct windows in lexicographic order. Windows that are found equal when
    levels merge are joined: the later one points to the earlier, which keeps the smaller doc_id.
    """

    def __init__(self, text: np.ndarray):
        self.rows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
        self.levels: list[np.ndarray] = []
        self.place, self.least, self.twin = [np.zeros(0, np.int64)] * 3

    def windows(self, places: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.rows[places]).view(_ROW).reshape(-1)

    def add(self, places: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Make a batch's windows the newest level; returns the number of each among all windows."""
        bytes_ = self.windows(places)
        order = np.argsort(bytes_, kind="stable")
        bytes_ = bytes_[order]
        new = np.concatenate([[True], bytes_[1:] != bytes_[:-1]])
        heads = np.flatnonzero(new)
        numbers = len(self.place) + np.arange(len(heads))
        out = np.empty(len(places), np.int64)
        out[order] = numbers[np.cumsum(new) - 1]
        self.place = np.concatenate([self.place, places[order][heads]])
        self.least = np.concatenate([self.least, np.minimum.reduceat(ids[order], heads)])
        self.twin = np.concatenate([self.twin, numbers])
        self.levels.append(numbers)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            self._merge()
        return out

    def _merge(self) -> None:
        """The last two levels as one; equal neighbours are matches."""
        both = np.concatenate([self.levels[-2], self.levels[-1]])
        bytes_ = self.windows(self.place[both])
        order = np.argsort(bytes_, kind="stable")
        bytes_, both = bytes_[order], both[order]
        match = np.flatnonzero(bytes_[1:] == bytes_[:-1])
        older, newer = both[match], both[match + 1]
        self.twin[newer] = older
        self.least[older] = np.minimum(self.least[older], self.least[newer])
        self.levels[-2:] = [np.delete(both, match + 1)]

    def smallest(self) -> np.ndarray:
        """For every window added, the smallest doc_id of all that equal it."""
        while len(self.levels) > 1:
            self._merge()
        root = self.twin
        while True:
            further = self.twin[root]
            if (further == root).all():
                return self.least[root]
            root = further


def scan_windows(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's answer to every batch: the smallest doc_id that holds each of its windows."""
    rows = rows.sort_values("batch", kind="stable").reset_index(drop=True)
    shapes, texts = [], []
    for n, z in zip(rows["n"], rows["z"], strict=True):
        blob = unpress(z)
        shapes.append((np.frombuffer(blob, np.int64, n), np.frombuffer(blob, np.int64, n, 8 * n)))
        texts.append(np.frombuffer(blob, np.uint8, -1, 16 * n))
    family = LogarithmicFamily(np.concatenate(texts))
    base, numbers = 0, []
    for (counts, ids), text in zip(shapes, texts, strict=True):
        heads = base + np.cumsum(counts + LENGTH - 1) - (counts + LENGTH - 1)
        numbers.append(family.add(_ranges(heads, counts), np.repeat(ids, counts)))
        base += len(text)
    smallest = family.smallest()
    blobs = []
    for own in numbers:
        values = smallest[own]
        heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        blobs.append(press(np.array([len(heads)]), values[heads], np.diff(np.append(heads, len(values)))))
    return pd.DataFrame({"batch": rows["batch"], "bucket": rows["bucket"], "n": rows["n"].astype("int64"), "z": blobs})


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every start, one after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(starts - before, counts)


class Asked:
    """What a batch asks in scan 2: the distinct runs of windows of its shared anchors, by bucket."""

    def __init__(self, batch: Batch, answers: list[tuple[int, int, bytes]], copies: np.ndarray, buckets: int):
        keys, places, counts, documents = batch.runs()
        distinct, shared, place = batch.anchors(keys, documents)
        hot = np.zeros(len(distinct), bool)
        cuts = dict(_by_bucket(bucket_of(distinct, buckets)))
        for bucket, n, z in answers:
            bits = np.unpackbits(np.frombuffer(z, np.uint8), count=2 * n)
            shared[cuts[bucket]] |= bits[:n] == 1
            hot[cuts[bucket]] = bits[n:]
        stay = ~np.isin(documents, copies)
        at = place[stay]
        ask = shared[at]
        keys, places, counts, documents = (x[stay][ask] for x in (keys, places, counts, documents))
        single = hot[at[ask]]
        if single.any():
            pieces = np.where(single, counts, 1)
            keys, documents = np.repeat(keys, pieces), np.repeat(documents, pieces)
            places = _ranges(places, pieces)
            counts, single = np.repeat(np.where(single, 1, counts), pieces), np.repeat(single, pieces)
        data, wide = batch.data, LENGTH - 1
        texts = [data[a : a + n + wide] for a, n in zip(places.tolist(), counts.tolist(), strict=True)]
        if single.any():
            for i in np.flatnonzero(single):
                keys[i] = xxhash.xxh3_64_intdigest(texts[i])
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(x, len(seen)) for x in texts], np.int64)
        # Of every occurrence: its place, its windows, its document; and which distinct run it is.
        self.places, self.counts, self.documents = places, counts, documents
        first = np.zeros(len(seen), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        ids = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(ids, which, batch.ids[documents])
        where = bucket_of(keys[first], buckets) if len(seen) else first
        order = np.argsort(where, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.which = rank[which] if len(which) else which
        self.where, self.ids, self.lengths = where[order], ids[order], counts[first][order] if len(seen) else first
        runs = list(seen)
        self.texts = [runs[i] for i in order.tolist()]

    def rows(self, batch: int) -> pa.RecordBatch:
        found = [
            (bucket, batch, s.stop - s.start, press(self.lengths[s], self.ids[s], np.frombuffer(b"".join(self.texts[s]), np.uint8)))
            for bucket, s in _by_bucket(self.where)
        ]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = zip(*found, strict=True) if found else [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "batch", "n", "z"]
        )

    def covered(self, batch: Batch, answers: list[tuple[int, int, bytes]]) -> np.ndarray:
        """Which bytes of the batch a window covers that a smaller doc_id holds."""
        smallest = [np.zeros(0, np.int64)]
        for _, _, z in answers:
            blob = unpress(z)
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            smallest.append(np.repeat(np.frombuffer(blob, np.int64, n, 8), np.frombuffer(blob, np.int64, n, 8 + 8 * n)))
        least = np.concatenate(smallest)
        heads = np.cumsum(self.lengths) - self.lengths
        found = least[_ranges(heads[self.which], self.counts)] < np.repeat(batch.ids[self.documents], self.counts)
        starts = _ranges(self.places, self.counts)[found]
        # A byte is covered if a window found starts there or less than a window's length before.
        hits = np.zeros(len(batch.data) + LENGTH, np.int32)
        hits[starts + LENGTH] = 1
        upto = np.cumsum(hits)
        return upto[LENGTH:] > upto[:-LENGTH]


def _documents(batch: Batch, gone: np.ndarray) -> pa.Table:
    """doc_id, n_bytes, n_removed, spans and kept of every document; gone: which bytes of the batch go."""
    heads = batch.ends - batch.lengths
    kept, spans, removed = [], [], []
    for a, b in zip(heads.tolist(), batch.ends.tolist(), strict=True):
        own = gone[a:b]
        if not own.any():
            kept.append(batch.data[a:b])
            spans.append([])
            removed.append(0)
            continue
        turns = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).reshape(-1, 2)
        spans.append([{"start": s, "end": e} for s, e in turns.tolist()])
        kept.append(np.frombuffer(batch.data, np.uint8, b - a, a)[~own].tobytes())
        removed.append(int(own.sum()))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table(
        {
            "doc_id": pa.array(batch.ids, mask=~batch.named), "n_bytes": pa.array(batch.lengths),
            "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary()),
        }
    )


_ANSWER = "batch long, bucket long, n long, z binary"


def dedup_spans(documents: DataFrame, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end of the removed runs), kept (the bytes that stay)."""
    require(documents, ["doc_id", "text"])
    packed = cut(pack_batches(documents, batch_bytes))
    buckets = int(max(8, (packed.agg(F.sum("n_bytes")).first()[0] or 0) // bucket_bytes))

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(len(rows)):
                row = rows.slice(i, 1).to_pylist()[0]
                batch = Batch.of(row)
                keys, _, _, documents_ = batch.runs()
                keys, _, _ = batch.anchors(keys, documents_)
                found = [(bucket, _narrow(keys[s])) for bucket, s in _by_bucket(bucket_of(keys, buckets))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _ in found], pa.int64()), pa.array([row["batch"]] * len(found), pa.int64()),
                        pa.array([k for _, k in found], pa.binary()),
                    ],
                    names=["bucket", "batch", "keys"],
                )

    asked = packed.mapInArrow(anchor_rows, "bucket long, batch long, keys binary")
    anchors = asked.groupBy("bucket").applyInPandas(scan_anchors, _ANSWER)
    # The places of copied documents travel with the answers, under a bucket of no number.
    copies = copied_documents(packed).select("batch", F.lit(None).cast("long").alias("bucket"), F.col("at").alias("n"), F.lit(None).cast("binary").alias("z"))
    first = cut(anchors.union(copies).withColumn("scan", F.lit(1)))

    def ask(row: dict, answers: pa.Table) -> tuple[Batch, Asked, np.ndarray, list]:
        batch = Batch.of(row)
        told = answers.to_pylist()
        copied = np.array([r["n"] for r in told if r["bucket"] is None], np.int64)
        scans = {k: sorted((r["bucket"], r["n"], r["z"]) for r in told if r["bucket"] is not None and r["scan"] == k) for k in (1, 2)}
        return batch, Asked(batch, scans[1], copied, buckets), copied, scans[2]

    def window_rows(own: pa.Table, answers: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        return pa.Table.from_batches([ask(row, answers)[1].rows(row["batch"])])

    batches = packed.groupBy("batch")
    windows = batches.cogroup(first.groupBy("batch")).applyInArrow(window_rows, "bucket long, batch long, n long, z binary")
    second = windows.groupBy("bucket").applyInPandas(scan_windows, _ANSWER).withColumn("scan", F.lit(2))

    def finish(own: pa.Table, answers: pa.Table) -> pa.Table:
        batch, asked_, copied, found = ask(own.to_pylist()[0], answers)
        gone = asked_.covered(batch, found)
        for i in copied:
            gone[batch.ends[i] - batch.lengths[i] : batch.ends[i]] = True
        return _documents(batch, gone)

    kind = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    return batches.cogroup(first.union(second).groupBy("batch")).applyInArrow(finish, kind)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLES: dict = {}
