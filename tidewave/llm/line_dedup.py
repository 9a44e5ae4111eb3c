"""Line dedup: repeated lines stay in one document; the result is a keep bitmap each.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased.
Keys of at least ``min_chars`` code points that stand in at least ``min_docs``
documents lose all their lines except in the largest doc_id that holds them.

Each such line becomes 128 hash bits with its document and position. These rows
are range-partitioned by (hash, document, position) and sorted so within each
partition, largest document first: the first document of a key is the one that
keeps it, the rest is streamed past. Since the document is part of the range key, a
line in a third of all documents spreads over many partitions; a group that runs
over a partition's edge is completed from a summary of two rows per partition (the
first and the last group: its document count and first and last document). The
stream holds back a group only until ``min_docs`` documents of it are seen, and no more than
``HELD_ROWS`` of its rows: more (a document that repeats a line without end) pass with a mark
and meet the verdict in a join. What
comes out is one zlib-compressed bitmap per document that loses lines.

Defined results for odd input: null or empty text is one empty line; rows without a
doc_id keep all lines and count for nothing; rows that share a doc_id are one
document when documents are counted, and each loses its own lines; a line repeated
within the largest document stays as often as it stands there; an empty table gives
an empty result; extra columns are passed on by keep_lines and don't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.llm.common import BLANKS, cut, cut_in_order, lower_ascii, require, table

MIN_CHARS, MIN_DOCS = 40, 5
#: Rows of an undecided key that a task holds.
HELD_ROWS = 65_536

_COLUMNS = ("h1", "h2", "doc_id", "text_hash", "pos", "n_lines")


def line_rows(documents: DataFrame, min_chars: int) -> DataFrame:
    """One row per line that is long enough: its hash, document, position, and the document's lines."""
    split = documents.where("doc_id is not null").select(
        F.col("doc_id").cast("long"),
        F.xxhash64("text").alias("text_hash"),
        F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"),
    )
    each = split.select("doc_id", "text_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    key = F.btrim("line", F.lit(BLANKS))
    keyed = each.select("doc_id", "text_hash", "n_lines", "pos", key.alias("key"))
    kept = keyed.where(F.char_length("key") >= min_chars).withColumn("key", lower_ascii(F.col("key")))
    return kept.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "pos", "n_lines"
    )


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch[c].to_numpy(zero_copy_only=False) for c in _COLUMNS}


def _group_starts(x: dict[str, np.ndarray]) -> np.ndarray:
    """Where a new key begins, 0 first."""
    new = (x["h1"][1:] != x["h1"][:-1]) | (x["h2"][1:] != x["h2"][:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last key of a sorted partition: its documents, and the first and last of them."""
    first = last = None
    pid = -1
    for batch in batches:
        if not batch.num_rows:
            continue
        pid, x = batch["pid"][0].as_py(), _arrays(batch)
        starts = _group_starts(x)
        new_doc = np.ones(len(x["h1"]), bool)
        new_doc[1:] = x["doc_id"][1:] != x["doc_id"][:-1]
        new_doc[starts] = True
        counts, ends = np.add.reduceat(new_doc, starts), [*starts[1:], len(new_doc)]
        for i in sorted({0, len(starts) - 1}):
            key = (int(x["h1"][starts[i]]), int(x["h2"][starts[i]]))
            n, top, low = int(counts[i]), int(x["doc_id"][starts[i]]), int(x["doc_id"][ends[i] - 1])
            if last and last[0] == key:
                again = last[3] == top
                last[1:] = [last[1] + n - again, last[2], low]
            else:
                last = [key, n, top, low]
                first = first or last
    if last:
        both = [first] if first is last else [first, last]
        rows = [(pid, k, g[0][0], g[0][1], *g[1:]) for k, g in enumerate(both)]
        names = ["pid", "k", "h1", "h2", "n_docs", "top", "low"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def edge_totals(edges: list) -> dict[tuple[int, int], tuple[int, int]]:
    """Documents and largest document of every key that runs over an edge of partitions."""
    out: dict = {}
    low: dict = {}
    for e in sorted(edges, key=lambda e: (e["pid"], e["k"])):
        key = (e["h1"], e["h2"])
        if key in out:
            out[key] = (out[key][0] + e["n_docs"] - (low[key] == e["top"]), out[key][1])
        else:
            out[key] = (e["n_docs"], e["top"])
        low[key] = e["low"]
    return out


_GONE = "doc_id long, text_hash long, pos int, n_lines int, pending long, verdict boolean"


def _stream(totals: dict, min_docs: int, hold: int):
    """From sorted rows, those of the lines to drop.

    Rows of a key that may yet have too few documents are held, but no more than ``hold`` of
    them: beyond, they pass marked as pending, and a verdict follows if they are to be dropped.
    The largest document's rows are never dropped, so never held.
    """
    names = [c.split()[0] for c in _GONE.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]

    def put(x: dict[str, np.ndarray], pending: int | None = None) -> pa.RecordBatch:
        n = len(x["doc_id"])
        columns = [*(x[c] for c in names[:4]), [pending] * n, [False] * n]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = pending = None
        count = top = last = n_held = serial = 0
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            x, pid = _arrays(batch), batch["pid"][0].as_py()
            starts = _group_starts(x)
            keys = [(int(x["h1"][starts[i]]), int(x["h2"][starts[i]])) for i in (0, -1)]
            new_doc = np.ones(len(x["h1"]), bool)
            new_doc[1:] = x["doc_id"][1:] != x["doc_id"][:-1]
            new_doc[starts] = True
            goes_on = key == keys[0]
            if goes_on:
                new_doc[0] = x["doc_id"][0] != last
            counts, tops = np.add.reduceat(new_doc, starts), x["doc_id"][starts].copy()
            if goes_on:
                counts[0], tops[0] = counts[0] + count, top
            for i, k in zip((0, -1), keys, strict=True):
                if k in totals:
                    counts[i], tops[i] = totals[k]
            if goes_on and counts[0] >= min_docs:
                for rows in held:
                    yield put(rows)
                if pending is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([None] * 4 + [pending, True], kinds, strict=True)], names=names)
            if not goes_on or len(starts) > 1 or counts[0] >= min_docs:
                held, n_held, pending = [], 0, None
            sizes = np.diff([*starts, len(x["h1"])])
            drop = np.repeat(counts >= min_docs, sizes) & (x["doc_id"] != np.repeat(tops, sizes))
            yield put({c: x[c][drop] for c in names[:4]})
            key, count, top, last = keys[1], int(counts[-1]), tops[-1], x["doc_id"][-1]
            if count < min_docs and key not in totals:
                wait = np.flatnonzero(x["doc_id"][starts[-1] :] != top) + starts[-1]
                rows = {c: x[c][wait] for c in names[:4]}
                n_held += len(wait)
                if n_held > hold and pending is None:
                    pending, serial = (pid << 32) + serial, serial + 1
                    for own in held:
                        yield put(own, pending)
                    held = []
                if pending is not None:
                    yield put(rows, pending)
                elif len(wait):
                    held.append(rows)

    return run


def pack_bitmap(n_lines: int, dropped) -> bytes:
    keep = np.ones(n_lines, bool)
    keep[np.asarray(dropped)] = False
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def line_keep_bitmaps(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hold: int = HELD_ROWS) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, keep: one row per document that loses lines."""
    require(documents, ["doc_id", "text"])
    rows = line_rows(documents, min_chars)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("text_hash"), F.col("pos")]
    ordered = cut_in_order(rows.repartitionByRange(n, *order).sortWithinPartitions(*order))
    pids = ordered.withColumn("pid", F.spark_partition_id())
    # Two rows per partition at most, however many lines there are.
    edges = pids.mapInArrow(_edges, "pid long, k long, h1 long, h2 long, n_docs long, top long, low long").collect()
    totals = edge_totals(edges)
    gone = cut(pids.mapInArrow(_stream(totals, min_docs, hold), _GONE))
    waiting = gone.where("pending is not null and not verdict").join(gone.where("verdict").select("pending"), "pending", "left_semi")
    columns = ["doc_id", "text_hash", "pos", "n_lines"]
    dropped = gone.where("pending is null").select(*columns).unionAll(waiting.select(*columns))
    grouped = dropped.groupBy("doc_id", "text_hash", "n_lines").agg(F.collect_set("pos").alias("dropped"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, gone = batch["n_lines"].to_pylist(), batch["dropped"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["text_hash"], batch["n_lines"], pa.array(map(len, gone), pa.int32()),
                    pa.array([pack_bitmap(n, d) for n, d in zip(lines, gone, strict=True)], pa.binary()),
                ],
                names=["doc_id", "text_hash", "n_lines", "n_dropped", "keep"],
            )

    return grouped.mapInArrow(pack, "doc_id long, text_hash long, n_lines int, n_dropped int, keep binary")


def keep_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hold: int = HELD_ROWS) -> DataFrame:
    """The documents as a struct ``doc``, with kept_text, n_lines and n_dropped."""
    maps = line_keep_bitmaps(documents, min_chars, min_docs, hold)
    docs = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"))
    maps = maps.select("doc_id", "text_hash", "n_dropped", "keep")
    joined = docs.join(
        maps,
        (F.col("doc.doc_id").cast("long") == F.col("doc_id")) & (F.xxhash64(F.col("doc.text")) == F.col("text_hash")),
        "left",
    )
    text = F.coalesce("doc.text", F.lit(""))
    ready = joined.select(
        F.col("doc").dropFields("text").alias("rest") if len(documents.columns) > 1 else F.col("doc").alias("rest"),
        F.col("doc.text").isNull().alias("was_null"),
        text.alias("text"), "keep",
        (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.flatnonzero(batch["keep"].is_valid().to_numpy(zero_copy_only=False))
            kept: list = [None] * batch.num_rows
            for i in at:
                lines = batch["text"][i].as_py().split("\n")
                keep = unpack_bitmap(batch["keep"][i].as_py(), len(lines))
                kept[i] = "\n".join(x for x, k in zip(lines, keep, strict=True) if k)
            i = batch.schema.get_field_index("keep")
            yield batch.set_column(i, "shorter", pa.array(kept, pa.string()))

    schema = T.StructType([T.StructField("shorter", T.StringType()) if f.name == "keep" else f for f in ready.schema])
    done = ready.mapInArrow(apply, schema)
    return done.select("rest", "was_null", "text", F.coalesce("shorter", "text").alias("kept_text"), "n_lines", "n_dropped")


def drop_repeated_lines(documents: DataFrame) -> DataFrame:
    """The documents with their kept lines as text and n_chars to match; null texts stay null."""
    done = keep_lines(documents)
    text = F.when(~F.col("was_null"), F.col("kept_text"))
    columns = []
    for c in documents.columns:
        column = {"text": text, "n_chars": F.char_length(text).cast("long")}.get(c, F.col("rest").getField(c))
        columns.append(column.alias(c))
    return done.select(*columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = keep_lines(docs)
    return done.select("rest.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), often as (
  select key, max(doc_id) as top from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), judged as (
  select k.doc_id, k.pos, k.line, o.key is not null and k.doc_id <> o.top as dropped
  from keyed k left join often o on k.key = o.key
)
select doc_id, count(*) as n_lines, (count(*) filter (where dropped))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id
"""

QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLES = {"op8_line_dedup": ORACLE}
