"""Ranked lexical search: MaxScore over blocks of documents, with bounds of term pairs.

1. ``build_index`` cuts the documents, where they lie, into blocks of about
   ``BLOCK_BYTES`` of text. A block is one row: its documents with their lengths and an
   inverted list per term (documents ascending, occurrences), packed into one binary value.
   Nothing is shuffled. Tasks take one block after the other out of its packing, and the table
   is written in row groups of about ``GROUP_BYTES``, so what a task holds depends neither on
   the collection's size nor on how much of it the task reads.
2. The collection's statistics (documents, their terms, documents per term) are sums
   over the blocks; of the terms only those that the queries hold are added up.
3. ``search`` sends the queries, in lots of about ``LOT_TERMS`` terms, over all blocks. A
   task first computes for its block every list's impacts and largest impact, and for
   every pair of its common terms the largest joint impact over the intersection of
   their lists; all queries of the lot share these. A pair's bound is the larger of that and both single
   maxima, so it never exceeds their sum, and is far less where the terms peak in different
   documents.
4. For a query, disjoint pairs are chosen greedily by what they save. The terms whose
   combined bound can't reach the query's last result so far are not essential: a
   document that holds only such terms is never looked at, and a block whose whole bound
   can't reach it is skipped. Candidates from the essential lists are completed term by term,
   and dropped as soon as what is left can't lift them to the last result.
5. Each task returns its best for each query, ranked in one window per query.

Scores are 64-bit integers throughout; a term's weight is floor(1000 ln((2N+2)/(2df+1))).

Defined results for odd input: a text without terms (null, empty, punctuation) is no
document of the collection; documents without doc_id count in the statistics and are
never returned; rows that share a doc_id are documents of their own; a query without
terms gives no rows; rows that share an item_id are one query with the terms of all; a
query without item_id is one too; with no documents nothing is found; equal scores rank by
doc_id; extra columns are ignored. A block holds at least one document, so one very long
text is a block of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.llm.common import cut, require, table

BLOCK_BYTES = 4 << 20
LOT_TERMS = 200_000
TOP = 10
#: A term is common in a block if one in so many of its documents holds it: only then its pairs are worth a bound.
COMMON_ONE_IN = 16
#: The longest lists whose pairs get one. It bounds the work per block; results don't depend on it.
PAIRED_LISTS = 96
#: Spark reads a row group of such rows at once, whatever the size of a partition.
GROUP_BYTES = 8 << 20

_INDEX_SQL = "n_docs long, n_terms long, block binary"
_PACKED = ("terms", "df", "doc_ids", "lengths", "docs", "tf")


def _letters() -> np.ndarray:
    """For every byte of UTF-8: 0 if it separates terms, else the byte, with A-Z lower-cased."""
    out = np.arange(256, dtype=np.uint8)
    for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        out[low : high + 1] = 0
    out[0x41:0x5B] += 0x20
    return out


LETTERS = _letters()


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and the text that each is from."""
    texts = pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string())
    texts = pa.concat_arrays([pc.fill_null(texts, "")])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    raw = LETTERS[raw]
    inside = raw > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = inside[edges]
    at = np.flatnonzero(begins)
    places = np.concatenate([(np.cumsum(inside) - 1)[at], [inside.sum()]]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(raw[inside].tobytes())])
    return terms, np.searchsorted(offsets, at, side="right") - 1


def index_block(doc_ids: pa.Array, texts: pa.Array) -> dict | None:
    """One block: its documents that hold a term, and the inverted lists of their terms."""
    terms, owner = split_terms(texts)
    if not len(terms):
        return None
    coded = terms.dictionary_encode()
    lengths = np.bincount(owner, minlength=len(doc_ids))
    some = lengths > 0
    owner = (np.cumsum(some) - 1)[owner]
    n = int(some.sum())
    keys, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + owner, return_counts=True)
    return {
        "n_docs": n, "n_terms": len(terms), "doc_ids": doc_ids.filter(pa.array(some)).cast(pa.int64()), "lengths": lengths[some].astype(np.int32),
        "terms": coded.dictionary, "df": np.bincount(keys // n, minlength=len(coded.dictionary)).astype(np.int32),
        "docs": _narrow(keys % n), "tf": _narrow(tf),
    }


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(values.max(initial=0)))


def pack(block: dict) -> bytes:
    """The block's lists as one compressed Arrow stream of one row."""
    row = pa.RecordBatch.from_pydict({k: _listed(block[k]) for k in _PACKED})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(row)
    return sink.getvalue().to_pybytes()


def unpack(block: pa.Scalar, *names: str) -> dict[str, pa.Array]:
    """The named lists of a packed block."""
    options = pa.ipc.IpcReadOptions(included_fields=[_PACKED.index(k) for k in names])
    with pa.ipc.open_stream(block.as_buffer(), options=options) as stream:
        row = stream.read_next_batch()
    return {k: row[k][0].values for k in names}


def build_index(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of inverted lists over every document."""
    require(documents, ["doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
            low = 0
            while low < batch.num_rows:
                full = np.searchsorted(sizes, (sizes[low - 1] if low else 0) + block_bytes, side="right")
                high = max(low + 1, int(full))
                block = index_block(batch["doc_id"].slice(low, high - low), batch["text"].slice(low, high - low))
                low = high
                if block:
                    yield pa.RecordBatch.from_pydict({"n_docs": pa.array([block["n_docs"]]), "n_terms": pa.array([block["n_terms"]]), "block": pa.array([pack(block)], pa.binary())})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _INDEX_SQL)


def _listed(values) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def terms_held(index: DataFrame) -> DataFrame:
    """term (binary) and df: a row for each term of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch["block"]:
                yield pa.RecordBatch.from_pydict(unpack(block, "terms", "df")).rename_columns(["term", "df"])

    return index.select("block").mapInArrow(run, "term binary, df int")


class Block:
    """One block under the weights of a lot: impacts, their maxima, and joint maxima of common pairs."""

    def __init__(self, batch: pa.RecordBatch, i: int, lot: Lot):
        own = unpack(batch["block"][i], *_PACKED)
        ids = own["doc_ids"]
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.doc_ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        self.n = len(self.doc_ids)
        found = pc.index_in(lot.terms, value_set=own["terms"])
        self.held = found.is_valid().to_numpy(zero_copy_only=False)
        at = pc.fill_null(found, 0).to_numpy(zero_copy_only=False)
        ends, docs, tf, lengths = (own[k].to_numpy(zero_copy_only=False) for k in ("df", "docs", "tf", "lengths"))
        ends = np.cumsum(ends, dtype=np.int64)
        m = 10 + (90 * lengths.astype(np.int64) * lot.n_docs) // lot.n_terms
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.most = np.zeros(len(self.held), np.int64)
        for t in np.flatnonzero(self.held).tolist():
            low, high = (ends[at[t] - 1] if at[t] else 0), ends[at[t]]
            who, often = docs[low:high].astype(np.int64), tf[low:high].astype(np.int64)
            impact = lot.weights[t] * ((1_000_000_000 * often) // (1000 * often + 8 * m[who]))
            if not self.known.all():
                impact = np.where(self.known[who], impact, 0)
            self.lists[t] = (who, impact)
            self.most[t] = impact.max()
        often = sorted((t for t in self.lists if COMMON_ONE_IN * len(self.lists[t][0]) >= self.n), key=lambda t: -len(self.lists[t][0]))
        self.common = {t: k for k, t in enumerate(often[:PAIRED_LISTS])} if self.n > 1 else {}
        self.joint = self._pairs()

    def _pairs(self) -> np.ndarray:
        """The largest joint impact of two common terms over the documents that hold both."""
        dense = np.zeros((len(self.common), self.n), np.int64)
        for t, k in self.common.items():
            dense[k, self.lists[t][0]] = self.lists[t][1]
        joint = np.zeros((len(self.common),) * 2, np.int64)
        for t, k in self.common.items():
            who, impact = self.lists[t]
            beside = dense[k + 1 :, who]
            joint[k, k + 1 :] = joint[k + 1 :, k] = np.where(beside > 0, beside + impact, 0).max(axis=1, initial=0)
        return joint

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """For the terms by ascending maximum: what a document can score on the first 1, 2, ... of them."""
        saved = np.zeros(len(terms), np.int64)
        at = [i for i, t in enumerate(terms.tolist()) if t in self.common]
        if len(at) > 1:
            rows = np.array([self.common[t] for t in terms[at].tolist()])
            most = self.most[terms[at]]
            i, j = np.triu_indices(len(at), 1)
            saving = most[i] + most[j] - np.maximum(self.joint[rows[i], rows[j]], np.maximum(most[i], most[j]))
            free = np.ones(len(at), bool)
            for p in np.argsort(-saving, kind="stable").tolist():
                if saving[p] <= 0:
                    break
                if free[i[p]] and free[j[p]]:
                    free[i[p]] = free[j[p]] = False
                    saved[at[j[p]]] = saving[p]  # due once the later one has come
        return np.cumsum(self.most[terms] - saved)

    def best(self, query: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that score at least ``least`` on the query, with their scores."""
        terms = query[self.held[query]]
        terms = terms[self.most[terms] > 0]
        terms = terms[np.argsort(self.most[terms], kind="stable")]
        bound = self.bounds(terms)
        # A sum with a late saving may dip: what counts is the most that any shorter prefix allows.
        bound = np.maximum.accumulate(bound)
        first = int(np.searchsorted(bound, least))
        if first == len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        score = np.zeros(self.n, np.int64)
        for t in terms[first:].tolist():
            who, impact = self.lists[t]
            score[who] += impact
        left = np.flatnonzero(score > 0)
        got = score[left]
        for i in range(first - 1, -1, -1):
            stay = got + bound[i] >= least
            left, got = left[stay], got[stay]
            if not len(left):
                break
            who, impact = self.lists[int(terms[i])]
            place = np.minimum(np.searchsorted(who, left), len(who) - 1)
            got = got + np.where(who[place] == left, impact[place], 0)
        stay = got >= least
        return self.doc_ids[left[stay]], got[stay]


class Lot:
    """Some queries with their terms' weights."""

    def __init__(self, rows: list[tuple[int | None, list[bytes]]], df: dict[bytes, int], n_docs: int, n_terms: int):
        names = sorted({t for _, terms in rows for t in terms})
        place = {t: i for i, t in enumerate(names)}
        self.terms, self.n_docs, self.n_terms = pa.array(names, pa.binary()), n_docs, n_terms
        self.weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in names]
        self.items = [i for i, _ in rows]
        self.queries = [np.array(sorted(place[t] for t in set(terms)), np.int64) for _, terms in rows]


def _search(lot: Lot, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in lot.queries]
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i, lot)
                for q, query in enumerate(lot.queries):
                    ids, scores = best[q]
                    who, got = block.best(query, int(scores[-1]) if len(scores) == top else 1)
                    if len(who):
                        ids, scores = np.concatenate([ids, who]), np.concatenate([scores, got])
                        order = np.lexsort((ids, -scores))[:top]
                        best[q] = (ids[order], scores[order])
        items = [lot.items[q] for q, (ids, _) in enumerate(best) for _ in ids]
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int64()), pa.array(np.concatenate([b[0] for b in best] or [[]]), pa.int64()), pa.array(np.concatenate([b[1] for b in best] or [[]]), pa.int64())],
            names=["item_id", "doc_id", "score"],
        )

    return run


def query_terms(items: DataFrame) -> DataFrame:
    """item_id and term (binary), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, owner = split_terms(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(owner)), terms], names=["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term binary").distinct()


def search(index: DataFrame, items: DataFrame, top: int = TOP, lot_terms: int = LOT_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of the index for each item."""
    require(items, ["item_id", "text"])
    spark = index.sparkSession
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    asked = cut(query_terms(items))
    held = terms_held(index).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    n_lots = max(1, -(-asked.count() // lot_terms))
    lotted = cut(asked.join(held, "term", "left").withColumn("lot", F.pmod(F.xxhash64("item_id"), F.lit(n_lots))))
    found = []
    for k in range(n_lots):
        rows: dict = {}
        df: dict[bytes, int] = {}
        for r in lotted.where(F.col("lot") == k).collect():  # about lot_terms rows
            rows.setdefault(r["item_id"], []).append(bytes(r["term"]))
            df[bytes(r["term"])] = r["df"] or 0
        if rows and totals[0]:
            lot = Lot(sorted(rows.items(), key=lambda x: (x[0] is not None, x[0])), df, totals[0], totals[1])
            found.append(index.select("block").mapInArrow(_search(lot, top), "item_id long, doc_id long, score long"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id"))))
    return ranked.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of the whole table for every benchmark item."""
    index = cut(build_index(table(spark, sf_dir, "documents")), GROUP_BYTES)
    return search(index, table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), sized as (
  select doc_id, terms, len(terms)::bigint as n from d where len(terms) > 0
), whole as (
  select count(*)::bigint as big_n, sum(n)::bigint as big_l from sized
), asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
), held as (
  select doc_id, n, term, count(*)::bigint as tf from (select doc_id, n, unnest(terms) as term from sized) group by doc_id, n, term
), weighed as (
  select term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::bigint as w
  from held, whole where term in (select term from asked) group by term
), scored as (
  select a.item_id, h.doc_id, sum(w.w * ((1000000000 * h.tf) // (1000 * h.tf + 8 * (10 + (90 * h.n * big_n) // big_l))))::bigint as score
  from asked a join weighed w using (term) join held h using (term), whole group by a.item_id, h.doc_id
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0
qualify rank <= 10
"""

QUERIES = {"op11_lexical_search": op11_lexical_search}
ORACLES = {"op11_lexical_search": ORACLE}
