"""Prefix trie of conversations: double arrays per prefix shard, upper nodes merged over all shards.

1. ``sequences`` gives one row per conversation: its turns in order, each as 128 bits
   of the SHA-256 digest of role and text, with the words of its text.
2. The sequences are range-partitioned by (sequence, conv_id) and sorted, so that a
   shard is a run of neighbours and a sequence that a third of all conversations say
   spreads over many shards. A task cuts its run into shards of ``SHARD_TURNS`` turns.
3. Per shard, the turns become dense ids and the trie is packed into two arrays: the
   child of node s by turn id c is slot BASE[s] + c, and CHECK of that slot is s. All
   conversations are then walked through the arrays, one depth at a time, which gives
   every node its members, words and children; sums over subtrees follow from the
   deepest nodes up.
4. Only nodes on the path of a shard's first or last sequence can reach into another
   shard. These upper nodes carry a chained digest of their path as key, and their
   sums are merged by it over all shards. What the upper nodes add to each other's
   subtrees is summed along the paths: each of them is counted on the first path that
   holds it, from the deepest node up, so that nothing grows with the square of the depth.

Tokens saved below a node are the words of all its members' turns from there on, less
the words of every distinct node once.

Defined results for odd input: null role or text is empty; null turns come first, equal
turns of a conversation stand in the order of their digests; repeated rows are turns of
their own; rows without conv_id belong to no conversation; an empty table has no node,
not even a root; extra columns are ignored. A conversation's digests are one row: 16
bytes a turn, whatever the texts' length. The list of a node's ending members is hashed
as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.llm.common import WORD_PATTERN, cut, require, table

SHARD_TURNS = 200_000
_DIGEST = 16
#: First-fit attempts before a family of children goes to the end of the arrays.
_TRIES = 256


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (digest, words) in order."""
    require(conversations, ["conv_id", "turn", "role", "text"])
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"),
            F.substring(F.sha2(said, 256), 1, 2 * _DIGEST).alias("digest"),
            F.regexp_count(text, F.lit(WORD_PATTERN)).alias("words"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def with_borrowed_heads(found: DataFrame, donor: Column, count: Column, most: int) -> DataFrame:
    """The sequences with the first ``count`` (at most ``most``) turns taken from conversation ``donor``."""
    heads = found.select(F.col("conv_id").alias("_from"), F.slice("turns", 1, most).alias("_head"))
    wants = found.select("conv_id", "turns", donor.alias("_donor"), count.cast("int").alias("_n"))
    both = wants.join(heads.join(wants.select("_donor").distinct(), F.col("_from") == F.col("_donor"), "left_semi"), F.col("_donor") == F.col("_from"), "left")
    head = F.when(F.col("_head").isNull(), F.slice("turns", 1, 0)).otherwise(F.expr("slice(_head, 1, _n)"))
    return both.select("conv_id", F.concat(head, F.expr("slice(turns, _n + 1, size(turns))")).alias("turns"))


class DoubleArray:
    """A trie over sorted sequences of dense ids from 1 on, as BASE and CHECK. Slot 0 is the root."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.base = np.zeros(1024, np.int64)
        self.check = np.full(1024, -1, np.int64)
        self.check[0] = 0
        self.free, self.top = 1, 1
        todo = [(0, 0, len(lengths), 0)]
        while todo:
            slot, low, high, depth = todo.pop()
            while low < high and lengths[low] == depth:  # those that end here sort first
                low += 1
            if low == high:
                continue
            if high - low == 1:
                at = starts[low]
                for code in codes[at + depth : at + lengths[low]].tolist():
                    self.base[slot] = self._next_free(code) - code
                    child = int(self.base[slot]) + code
                    self._take(child, slot)
                    slot = child
                continue
            column = codes[starts[low:high] + depth]
            edges = np.flatnonzero(np.diff(column)) + 1
            firsts = np.concatenate([[0], edges])
            family = column[firsts]
            base = self._place(family)
            self.base[slot] = base
            ends = [*(edges + low).tolist(), high]
            for code, begin, end in zip(family.tolist(), (firsts + low).tolist(), ends, strict=True):
                self._take(base + code, slot)
                todo.append((base + code, begin, end, depth + 1))
        self.base, self.check = self.base[: self.top], self.check[: self.top]

    def _room(self, slot: int) -> None:
        while slot >= len(self.check):
            self.base = np.concatenate([self.base, np.zeros_like(self.base)])
            self.check = np.concatenate([self.check, np.full_like(self.check, -1)])

    def _take(self, slot: int, parent: int) -> None:
        self._room(slot)
        self.check[slot] = parent
        self.top = max(self.top, slot + 1)

    def _next_free(self, code: int) -> int:
        while self.free < self.top and self.check[self.free] >= 0:
            self.free += 1
        return self.free

    def _place(self, family: np.ndarray) -> int:
        """The base under which every child's slot is free: first fit, else past the end."""
        slot, first = self._next_free(0), int(family[0])
        for _ in range(_TRIES):
            if slot >= self.top:
                break
            at = slot - first + family
            if (self.check[at[at < self.top]] < 0).all():
                return slot - first
            slot += 1
            while slot < self.top and self.check[slot] >= 0:
                slot += 1
        self._room(self.top + int(family[-1] - first))
        return self.top - first

    def walk(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of every turn, and of every conversation's end."""
        slots, at = np.empty(len(codes), np.int64), np.zeros(len(lengths), np.int64)
        alive, depth = np.flatnonzero(lengths > 0), 0
        while len(alive):
            here = starts[alive] + depth
            child = self.base[at[alive]] + codes[here]
            if not (self.check[child] == at[alive]).all():
                raise AssertionError("a sequence left the trie")
            slots[here] = at[alive] = child
            depth += 1
            alive = alive[lengths[alive] > depth]
        return slots, at


_NODE = pa.schema(
    [
        ("shared", pa.bool_()), ("shard", pa.int64()), ("path", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()),
        ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("all_words", pa.int64()), ("own_words", pa.int64()), ("words", pa.int64()), ("has_child", pa.bool_()), ("ends", pa.string()),
    ]
)
_NODE_SQL = (
    "shared boolean, shard long, path long, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, all_words long, own_words long, words long, has_child boolean, ends string"
)


def _chain(path: bytes) -> list[bytes]:
    """Keys of the nodes along a path, the root first."""
    keys = [b"\0" * _DIGEST]
    for i in range(0, len(path), _DIGEST):
        keys.append(hashlib.blake2b(keys[-1] + path[i : i + _DIGEST], digest_size=_DIGEST).digest())
    return keys


def shard_nodes(shard: int, ids: np.ndarray, paths: list[bytes], words: np.ndarray) -> pa.RecordBatch:
    """The nodes of one run of sorted sequences: those of this shard alone in full, the others' shares."""
    lengths = np.fromiter(map(len, paths), np.int64, len(paths)) // _DIGEST
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    turns = np.frombuffer(b"".join(paths), f"S{_DIGEST}")
    codes = np.unique(turns, return_inverse=True)[1].astype(np.int64) + 1
    trie = DoubleArray(codes, starts, lengths)
    slots, ends_at = trie.walk(codes, starts, lengths)
    n = len(trie.check)
    owner = np.repeat(np.arange(len(ids)), lengths)
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    members, least = np.bincount(slots, minlength=n), np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, slots, ids[owner])
    node_words, depth, all_words = (np.zeros(n, np.int64) for _ in range(3))
    node_words[slots], depth[slots] = words, place + 1
    running = np.concatenate([[0], np.cumsum(words)])
    rest = np.repeat(running[starts + lengths], lengths) - running[:-1]
    np.add.at(all_words, slots, rest)
    members[0], least[0], all_words[0] = len(ids), ids.min(), running[-1]

    nodes = np.flatnonzero(trie.check >= 0)
    inner = nodes[nodes > 0]
    parent = trie.check
    both = [np.concatenate([[0], slots[starts[i] : starts[i] + lengths[i]]]) for i in (0, len(ids) - 1)]
    shared = np.zeros(n, bool)
    shared[both[0]] = shared[both[1]] = True
    has_child = np.bincount(parent[inner], minlength=n) > 0
    alone = inner[~shared[inner]]
    children = np.bincount(parent[alone], minlength=n)
    leaves, own_words = np.zeros(n, np.int64), np.zeros(n, np.int64)
    leaves[alone], own_words[alone] = ~has_child[alone], node_words[alone]
    deep_first = inner[np.argsort(-depth[inner], kind="stable")]
    for level in np.split(deep_first, np.flatnonzero(np.diff(depth[deep_first])) + 1):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(own_words, parent[level], own_words[level])

    listed: dict[int, str] = {}
    begins = np.concatenate([[0], np.flatnonzero(np.diff(ends_at)) + 1])
    for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(ids)], strict=True):
        listed[int(ends_at[begin])] = ",".join(map(str, ids[begin:end].tolist()))
    columns: dict[str, list] = {f.name: [] for f in _NODE}

    def put(**values) -> None:
        for k, v in values.items():
            columns[k].append(v)

    keys = {0: _chain(paths[0]), 1: _chain(paths[-1])}
    key_of = {int(s): k for j in (0, 1) for s, k in zip(both[j].tolist(), keys[j], strict=True)}
    nothing = hashlib.sha256(b"").hexdigest()
    for s in alone.tolist():
        up = int(parent[s])
        above = shared[up]
        put(
            shared=False, shard=shard, path=None, key=None, parent_key=key_of[up] if above else None, conv_id=int(least[s]), depth=int(depth[s]),
            parent_conv_id=None if above else int(least[up]), n_convs=int(members[s]), n_children=int(children[s]), n_leaves=int(leaves[s]),
            all_words=int(all_words[s]), own_words=int(own_words[s]), words=int(node_words[s]), has_child=bool(has_child[s]),
            ends=hashlib.sha256(listed[s].encode()).hexdigest() if s in listed else nothing,
        )
    given: set[int] = set()
    for j in range(1 if np.array_equal(*both) else 2):
        for d, s in enumerate(both[j].tolist()):
            new = s not in given
            given.add(s)
            put(
                shared=True, shard=shard, path=2 * shard + j, key=keys[j][d], parent_key=keys[j][d - 1] if d else None, conv_id=int(least[s]), depth=d,
                parent_conv_id=None, n_convs=int(members[s]) * new, n_children=int(children[s]) * new, n_leaves=int(leaves[s]) * new,
                all_words=int(all_words[s]) * new, own_words=int(own_words[s]) * new, words=int(node_words[s]), has_child=bool(has_child[s]),
                ends=listed.get(s) if new else None,
            )
    return pa.RecordBatch.from_pydict(columns, schema=_NODE)


def _shards(shard_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        paths: list = []
        words: list = []
        held = count = 0
        pid = 0
        for batch in batches:
            for i in range(batch.num_rows):
                pid = batch["pid"][i].as_py()
                ids.append(batch["conv_id"][i].as_py())
                paths.append(batch["path"][i].as_py())
                words.append(batch["words"][i].values.to_numpy(zero_copy_only=False))
                held += len(words[-1]) + 1
                if held >= shard_turns:
                    yield shard_nodes((pid << 32) + count, np.array(ids, np.int64), paths, np.concatenate(words).astype(np.int64))
                    ids, paths, words, held, count = [], [], [], 0, count + 1
        if ids:
            yield shard_nodes((pid << 32) + count, np.array(ids, np.int64), paths, np.concatenate(words).astype(np.int64))

    return run


def _stream_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per key of its lists, which come sorted."""
    key = digest = None
    for batch in batches:
        keys, hashes = [], []
        for k, ends in zip(batch["key"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    keys.append(key)
                    hashes.append(digest.hexdigest())
                key, digest, some = k, hashlib.sha256(), False
            if ends:
                digest.update((b"," if some else b"") + ends.encode())
                some = True
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def trie_nodes(found: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie over sequences: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    flat = cut(
        found.select(
            "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")
        )
    )
    n = int(flat.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = flat.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    nodes = cut(ordered.withColumn("pid", F.spark_partition_id()).mapInArrow(_shards(shard_turns), _NODE_SQL))
    upper = nodes.where("shared")
    merged = upper.groupBy("key").agg(
        F.min("path").alias("owner"), F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "all_words", "own_words")],
        F.max("has_child").alias("has_child"),
    )
    merged = cut(merged)

    # Each upper node counts on its first path; from there, sums run from the deepest node up.
    own = merged.select("key", "owner", (~F.col("has_child")).cast("long").alias("leaf"))
    along = upper.select("key", "path", "depth", "words").join(own, "key")
    mine = F.col("path") == F.col("owner")
    below = Window.partitionBy("path").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = along.select(
        "key",
        F.sum(F.when(mine, F.col("leaf")).otherwise(0)).over(below).alias("s_leaves"),
        F.sum(F.when(mine, F.col("words")).otherwise(0)).over(below).alias("s_words"),
    )
    sums = sums.groupBy("key").agg(F.sum("s_leaves").alias("s_leaves"), F.sum("s_words").alias("s_words"))
    kin = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("s_children"))
    streamed = upper.select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    ends = streamed.mapInArrow(_stream_ends, "key binary, ends_sha256 string")
    parents = merged.select(F.col("key").alias("up"), F.col("conv_id").alias("up_conv_id"))
    top = merged.join(sums, "key").join(ends, "key").join(kin, "key", "left").join(parents, F.col("parent_key") == F.col("up"), "left")
    top = top.select(
        "conv_id", "depth", F.col("up_conv_id").alias("parent_conv_id"), "n_convs",
        (F.col("n_children") + F.coalesce("s_children", F.lit(0))).alias("n_children"), (F.col("n_leaves") + F.col("s_leaves")).alias("n_leaves"),
        (F.col("all_words") - F.col("own_words") - F.col("s_words")).alias("saved_tokens"), "ends_sha256",
    )
    rest = nodes.where("not shared").join(parents, F.col("parent_key") == F.col("up"), "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "up_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("all_words") - F.col("own_words")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
    return top.unionByName(rest)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie over conversations as they are."""
    return trie_nodes(sequences(conversations))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie over conversations that begin with the first turns of every twentieth."""
    found = cut(sequences(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    conv = F.col("conv_id")
    return trie_nodes(with_borrowed_heads(found, conv - conv % 20, F.crc32(conv.cast("string")) % 4, 3))


ORACLE = r"""
with crc_table as (
  select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), own as (
  select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first) as turns
  from conversations where conv_id is not null group by conv_id
), heads as (
  select conv_id, turns, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 as h
  from own, crc_table
), rebuilt as (
  select a.conv_id, coalesce(b.turns[1:a.h::int], []) || a.turns[a.h::int + 1:] as turns
  from heads a left join heads b on b.conv_id = a.conv_id - a.conv_id % 20
), prefixes as (
  select conv_id, d, turns[1:d::int] as node, len(turns) = d as at_end,
    case when d = 0 then 0 else len(regexp_extract_all(turns[d::int].text, '[^\x20\x09-\x0D]+')) end as words
  from (select conv_id, turns, unnest(range(len(turns) + 1)) as d from rebuilt)
), nodes as (
  select node, d as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where at_end), '')) as ends_sha256
  from prefixes group by node, d
), kids as (
  select node[1:depth - 1] as node, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by all
), counted as (
  select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join kids k on n.node = k.node and n.depth = k.depth
), sums as (
  select node[1:d] as node, d as depth, count(*) filter (where n_children = 0) as n_leaves, sum((n_convs - 1) * words) as saved
  from (select *, unnest(range(depth + 1)) as d from counted) group by all
)
select c.conv_id, c.depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, s.n_leaves::bigint as n_leaves,
  s.saved::bigint as saved_tokens, c.ends_sha256
from counted c join sums s on c.node = s.node and c.depth = s.depth
left join nodes p on p.depth = c.depth - 1 and p.node = c.node[1:c.depth - 1]
"""

QUERIES = {"op12_conversation_trie": op12_conversation_trie}
ORACLES = {"op12_conversation_trie": ORACLE}
