"""Exact top-k by inner product over norm buckets.

Candidates are range-sorted by vector length, longest first, and cut into groups of
``GROUP_ROWS``; within a group, buckets of ``BUCKET_ROWS`` follow each other by length.
Against a bucket whose longest vector has length m, a query of length q with k-th best
score s so far needs a local cosine of at least c = s / (q * m):

* c > 1: the bucket, and all later ones, can't hold a better score;
* c above ``COORDINATE_FROM``: coordinate pruning. Take the query's largest
  coordinate f; a unit vector at a cosine of c or more has an angle to axis f within
  acos(c) of the query's. Only vectors in that range of coordinate f stay;
* otherwise length pruning: only vectors of length at least s / q stay, a slice of the
  bucket, as it is sorted by length.

Survivors' products are verified in exact integer arithmetic (float64 products of
integers below 2^53; vectors of length 2^26 or more aren't pruned and are multiplied in
Python integers). Both bounds are widened by a relative 1e-9, so rounding never prunes
a vector that ties.

The search has two rounds. First all queries meet the longest group of their width, which
gives every query a score s that its k-th result reaches. Then queries, in blocks of
``BLOCK_QUERIES`` sorted by s / q, go on only to the groups that are long enough
(m >= s / q): a block to a first few groups, a group to a first few blocks. A cell of one
group and one block is a task of bounded size; it returns k rows a query at most, and a
query's cells meet in one ranking. Vectors travel as the smallest integers that hold them.
The driver holds one row of bounds and one count per group
and per block; which cells there are follows from the counts, in the tasks.

Defined results for odd input: vectors that are null or hold null or non-finite
components take no part; a query meets only vectors of its own number of components; rows
without an id take no part; a vector isn't compared with rows of its own id; rows that
repeat a query's id and vector are one query, rows that share its id only are queries of
their own with ranks of their own; repeated candidate rows are separate results; empty
vectors score 0; a score beyond a long is the nearest long, and those that so tie go by
id; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.llm.common import cut, require, table

GROUP_ROWS, BLOCK_QUERIES, BUCKET_ROWS = 16_384, 4_096, 1_024
COORDINATE_FROM = 0.9
#: Two vectors shorter than this have a product below 2^53.
LOUD = float(1 << 26)
LONG = np.iinfo(np.int64)
SLACK = 1e-9


def usable(column: str) -> Column:
    x = F.col(column)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & ~odd


def pack(x: np.ndarray) -> tuple[str, bytes]:
    """Integer-valued rows in the smallest type that holds them, and its name."""
    most = np.abs(x).max() if x.size else 0.0
    kind = next((k for k in ("int8", "int16", "int32") if most <= np.iinfo(k).max), "float64")
    return kind, x.astype(kind).tobytes()


def unpack(kind: str, blob: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(blob, kind).astype(np.float64).reshape(rows, -1) if blob else np.zeros((rows, 0))


_PACKED = "width int, top double, low double, rows int, ids binary, keys binary, floors binary, kind string, data binary"


def packed(vectors: DataFrame, size: int, order: Column) -> DataFrame:
    """Vectors (id, key, v, norm, floor) range-sorted by width and order, in numbered rows of at most ``size``.

    low is the least length at which a vector can reach the floor of one of them.
    """

    def row(part: list[tuple]) -> pa.RecordBatch:
        ids, keys, rows, norms, floors = (list(c) for c in zip(*part, strict=True))
        kind, data = pack(np.array(rows, np.float64).reshape(len(rows), len(rows[0])))
        far = [f / n if f > 0 and 0 < n < LOUD else 0.0 for f, n in zip(floors, norms, strict=True)]
        values = [
            len(rows[0]), max(norms), min(far), len(rows), np.array(ids, np.int64).tobytes(), np.array(keys, np.int64).tobytes(),
            np.array(floors, np.float64).tobytes(), kind, data,
        ]
        kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int32(), *[pa.binary()] * 3, pa.string(), pa.binary()]
        names = [c.split()[0] for c in _PACKED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        for batch in batches:
            for own in zip(*(batch[c].to_pylist() for c in ("id", "key", "v", "norm", "floor")), strict=True):
                if part and (len(part) >= size or len(own[2]) != len(part[0][2])):
                    yield row(part)
                    part = []
                part.append(own)
        if part:
            yield row(part)

    by = [F.size("v"), order, F.col("id")]
    ordered = vectors.repartitionByRange(max(1, -(-vectors.count() // size)), *by).sortWithinPartitions(*by)
    rows = ordered.select("id", "key", "v", "norm", "floor").mapInArrow(run, _PACKED)
    return cut(rows.withColumn("number", F.monotonically_increasing_id()))


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products of integer-valued rows with q in Python integers, held within a long."""
    own = [int(v) for v in q]
    found = [sum(int(a) * b for a, b in zip(row, own, strict=True)) for row in x]
    return np.array([max(LONG.min, min(LONG.max, s)) for s in found], np.int64)


class Best:
    """The k best (score, id) of a query so far, ties to the smaller id; floor: a score that the k-th reaches anyway."""

    def __init__(self, k: int, floor: float):
        self.k, self.kth = k, floor
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores.astype(np.int64)]), np.concatenate([self.ids, ids])
        # ~s is -s - 1, which is a long for every long.
        order = np.lexsort((ids, ~scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.kth = max(self.kth, float(self.scores[-1]))


def coordinate_range(cosine: float, own: float) -> tuple[float, float]:
    """Where a unit vector's coordinate can lie that has that cosine, at least, to a unit vector with ``own``."""
    turn, at = np.arccos(min(1.0, cosine)), np.arccos(np.clip(own, -1, 1))
    return np.cos(min(np.pi, at + turn)) - SLACK, np.cos(max(0.0, at - turn)) + SLACK


def search(q: np.ndarray, q_ids: np.ndarray, floors: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[Best]:
    """The k best rows for each query; rows are sorted by length, longest first."""
    q_norms, norms = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    best = [Best(k, f) for f in floors]
    loud = norms >= LOUD
    plain = np.flatnonzero(~loud)
    x_, norms_, ids_ = x[plain], norms[plain], ids[plain]
    live = np.flatnonzero(q_norms < LOUD)
    for at in range(0, len(x_), BUCKET_ROWS):
        b, lengths, names = x_[at : at + BUCKET_ROWS], norms_[at : at + BUCKET_ROWS], ids_[at : at + BUCKET_ROWS]
        kth = np.array([best[i].kth for i in live])
        reach = q_norms[live] * lengths[0]
        stay = kth <= reach * (1 + SLACK)
        live, kth, reach = live[stay], kth[stay], reach[stay]
        if not live.size:
            break
        cosine = np.where(kth > 0, kth / np.maximum(reach, 1e-300) * (1 - SLACK), -1.0)
        # A shorter vector needs an even higher cosine, so the bucket's bound holds for all.
        for i, c in zip(live[cosine > COORDINATE_FROM], cosine[cosine > COORDINATE_FROM], strict=True):
            f = int(np.abs(q[i]).argmax())
            low, high = coordinate_range(c, q[i, f] / q_norms[i])
            there = b[:, f] / np.maximum(lengths, 1e-300)
            _keep(best[i], q_ids[i], b, names, q[i], np.flatnonzero((there >= low) & (there <= high)))
        # How many of the bucket are long enough; queries with like slices are multiplied together.
        wide = np.flatnonzero(cosine <= COORDINATE_FROM)
        least = np.maximum(kth[wide], 0) / np.maximum(q_norms[live[wide]], 1e-300) * (1 - SLACK)
        counts = np.searchsorted(-lengths, -least, "right")
        for part in np.array_split(np.argsort(counts, kind="stable"), max(1, len(wide) // 256)):
            n = int(counts[part].max()) if len(part) else 0
            if not n:
                continue
            own = live[wide[part]]
            scores = q[own] @ b[:n].T
            good = scores >= np.array([best[i].kth for i in own])[:, None]
            for r in np.flatnonzero(good.any(axis=1)):
                hit = np.flatnonzero(good[r])
                other = names[hit] != q_ids[own[r]]
                best[own[r]].add(scores[r, hit[other]], names[hit[other]])
    for i in np.flatnonzero((q_norms >= LOUD) | loud.any()):
        rows = np.flatnonzero((loud | (q_norms[i] >= LOUD)) & (ids != q_ids[i]))
        best[i].add(_exact(x[rows], q[i]), ids[rows])
    return best


def _keep(best: Best, own: int, b: np.ndarray, names: np.ndarray, q: np.ndarray, stay: np.ndarray) -> None:
    scores = b[stay] @ q
    good = stay[(scores >= best.kth) & (names[stay] != own)]
    best.add(b[good] @ q, names[good])


#: number, width, top, low, rows of a row of packed(), or of several in a row.
Bounds = list[tuple[int, int, float, float, int]]
_FOUND = "query_id long, query_key long, vec_id long, score long"


def gathered(packed_rows: DataFrame, size: int) -> tuple[dict[int, int], Bounds]:
    """Consecutive packed rows of one width as lots of at most ``size`` vectors, whatever the number of partitions.

    Returns the lot of each packed row's number, and the bounds of the lots.
    """
    lots: dict[int, int] = {}
    bounds: Bounds = []
    for number, width, top, low, rows in sorted(map(tuple, packed_rows.select("number", "width", "top", "low", "rows").collect())):
        if bounds and bounds[-1][1] == width and bounds[-1][4] + rows <= size:
            lot, _, t, least, n = bounds[-1]
            bounds[-1] = (lot, width, max(t, top), min(least, low), n + rows)
        else:
            bounds.append((number, width, top, low, rows))
        lots[number] = bounds[-1][0]
    return lots, bounds


def _dealt(packed_rows: DataFrame, cells_of) -> DataFrame:
    """Every packed row once for each of its cells, with the name of the cell."""
    kinds = packed_rows.schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                for cell in cells_of(row["number"][0].as_py()):
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.array([cell], pa.string())], names=[*kinds, "cell"])

    return packed_rows.mapInArrow(run, f"{_PACKED}, number long, cell string")


def _stacked(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """The vectors of a cell's packed rows, with their ids, keys and floors."""
    parts = [(unpack(r.kind, r.data, r.rows), *(np.frombuffer(x, t) for x, t in ((r.ids, np.int64), (r.keys, np.int64), (r.floors, np.float64)))) for r in rows.itertuples()]
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


class Cells:
    """Which blocks meet which groups, as two prefixes: the longest groups for a block, the most easily reached blocks for a group.

    Holds a number per group and one per block, however many pairs there are.
    """

    def __init__(self, block_bounds: Bounds, group_bounds: Bounds, second: bool):
        self.groups: dict[int, list[int]] = {}
        self.blocks: dict[int, list[int]] = {}
        self.of_block: dict[int, tuple[int, int]] = {}
        self.of_group: dict[int, tuple[int, int]] = {}
        self.begin = 1 if second else 0
        for width in {w for _, w, _, _, _ in group_bounds}:
            groups = sorted((-top, g) for g, w, top, _, _ in group_bounds if w == width)
            blocks = sorted((low, b) for b, w, _, low, _ in block_bounds if w == width)
            self.groups[width], self.blocks[width] = [g for _, g in groups], [b for _, b in blocks]
            reach, lows = np.array([-t * (1 + SLACK) for t, _ in groups]), np.array([low for low, _ in blocks])
            # Both counts come from one comparison: reach >= low.
            counts = np.searchsorted(-reach, -lows, side="right") if second else np.ones(len(blocks), np.int64)
            self.of_block |= {b: (width, int(n)) for b, n in zip(self.blocks[width], counts, strict=True)}
            counts = np.searchsorted(lows, reach, side="right") if second else np.where(np.arange(len(groups)) == 0, len(blocks), 0)
            self.of_group |= {g: (width, int(n) if i >= self.begin else 0) for i, (g, n) in enumerate(zip(self.groups[width], counts, strict=True))}

    def from_block(self, b: int) -> Iterator[str]:
        width, n = self.of_block.get(b, (None, 0))
        return (f"{b}/{g}" for g in self.groups.get(width, [])[self.begin : n])

    def from_group(self, g: int) -> Iterator[str]:
        width, n = self.of_group[g]
        return (f"{b}/{g}" for b in self.blocks[width][:n])


def meet(blocks: tuple, groups: tuple, k: int, second: bool) -> DataFrame:
    """The k best of each group for every query of the blocks, at or above the query's floor.

    blocks, groups: packed rows, their lots and bounds (as of gathered). The first round is
    with the longest group of each width, the second with the others that a block can reach.
    """
    (asked, block_lots, block_bounds), (held, group_lots, group_bounds) = blocks, groups
    cells = Cells(block_bounds, group_bounds, second)

    def run(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(rows):
            q, q_ids, keys, floors = _stacked(own)
            x, ids, _, _ = _stacked(rows)
            order = np.argsort(-(x * x).sum(axis=1), kind="stable")
            found = search(q, q_ids, floors, x[order], ids[order], k)
            out = [(np.full(len(b.ids), i), np.full(len(b.ids), key), b.ids, b.scores) for i, key, b in zip(q_ids, keys, found, strict=True)]
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("query_id", "query_key", "vec_id", "score"), columns, strict=True)))

    left = _dealt(asked, lambda n: cells.from_block(block_lots[n])).groupBy("cell")
    return left.cogroup(_dealt(held, lambda n: cells.from_group(group_lots[n])).groupBy("cell")).applyInPandas(run, _FOUND)


def top_k(
    queries: DataFrame, rows: DataFrame, k: int, group_rows: int = GROUP_ROWS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every query.

    Both inputs have id and v, an array of integer-valued doubles.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    plain = {"norm": norm, "floor": F.lit(float("-inf"))}
    asked = queries.select("id", "v").distinct().withColumn("key", F.xxhash64("v"))
    def lot(vectors: DataFrame, size: int, order: Column) -> tuple:
        table_ = packed(vectors, size, order)
        return table_, *gathered(table_, size)

    groups = lot(rows.select("id", "v").withColumns({"key": F.lit(0).cast("long"), **plain}), group_rows, -F.col("norm"))
    n_groups, n_widths = len(groups[2]), len({width for _, width, _, _, _ in groups[2]})

    some = lot(asked.withColumns(plain), block_queries, -F.col("norm"))
    start = meet(some, groups, k, second=False)
    best = W.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    if n_groups == n_widths:  # no group is left for a second round
        whole = start.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return whole.select("query_id", "rank", "vec_id", "score")
    start = cut(start)
    ranked = start.withColumn("rank", F.row_number().over(best))
    floors = ranked.where(F.col("rank") == k).select(
        F.col("query_id").alias("id"), F.col("query_key").alias("key"), F.col("score").cast("double").alias("floor")
    )
    reach = F.col("floor") / F.nullif(F.col("norm"), F.lit(0.0))
    known = asked.withColumn("norm", norm).join(floors, ["id", "key"], "left").fillna({"floor": float("-inf")})
    sorted_ = lot(known, block_queries, F.coalesce(reach, F.lit(float("-inf"))))
    more = meet(sorted_, groups, k, second=True)
    whole = start.union(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return whole.select("query_id", "rank", "vec_id", "score")


def scaled(embeddings: DataFrame, factor: float = 64.0) -> DataFrame:
    """id, v: vectors that take part, every component x as floor(factor * x), x as double."""
    require(embeddings, ["vec_id", "embedding"])
    whole = embeddings.where(usable("embedding") & F.col("vec_id").isNotNull())
    # floor() gives a long; doubles from 2^53 on are whole already.
    v = F.transform(
        F.transform("embedding", lambda x: x.cast("double") * factor),
        lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x),
    )
    return whole.select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(table(spark, sf_dir, "embeddings"))
    return top_k(rows.where("id % 20 = 0"), rows, 20)


ORACLE = """
with vectors as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v, c.v)::bigint as score
  from vectors q join vectors c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), ranked as (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""

QUERIES = {"op4_topk": op4_topk}
ORACLES = {"op4_topk": ORACLE}
