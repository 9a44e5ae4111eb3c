"""Lexical search and conversation tries against brute force, on odd and small inputs."""

import hashlib
import math
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import docs_frame, odd_documents, words
from tidewave.llm import conversation_trie, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, top=10):
    held = [(i, terms_of(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    big_n, big_l = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, t in held:
            m = 10 + (90 * len(t) * big_n) // big_l
            s = 0
            for x in terms:
                if tf := t.count(x):
                    s += math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[x] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "lot", "seed"), [(60, 8, 0), (2000, 200_000, 1), (1 << 22, 3, 2)])
def test_search_against_brute_force(spark, block, lot, seed):
    rng = random.Random(seed)
    docs = [(i, t) for i, t in odd_documents()] + [(100 + i, words(rng, rng.randint(0, 80), "abc")) for i in range(120)]
    docs += [(300, "Ünï code Ünï"), (301, "A\x00b;C~D"), (302, "ünï"), (303, "a " * 40_000)]
    items = [(i, words(rng, rng.randint(1, 30), "abcd")) for i in range(25)]
    items += [(50, None), (51, "..."), (52, "unknown"), (53, docs[5][1]), (53, "a b"), (54, "Ünï d a"), (None, "a aa b")]
    frame = docs_frame(spark, docs).withColumn("item_id", F.lit(3)).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("clash")).withColumn("lot", F.lit(9))
    got = lexical.search(lexical.build_index(frame, block_bytes=block), asked, lot_terms=lot)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(docs, items)


def test_pair_bounds_hold_and_tighten(spark):
    # "x" and "y" peak in different documents: together they are bounded by less than the sum of their maxima.
    rng = random.Random(4)
    docs = [(i, " ".join(["x"] * 30 + ["y"] + ["pad"] * 5 if i % 2 else ["y"] * 30 + ["x"] + ["pad"] * 5) + f" u{rng.randint(0, 9)}") for i in range(64)]
    row = lexical.build_index(docs_frame(spark, docs).coalesce(1)).toArrow().to_batches()[0]
    lot = lexical.Lot([(1, [b"x", b"y", b"pad"])], {b"x": 40, b"y": 40, b"pad": 30}, 64, 64 * 37)
    block = lexical.Block(row, 0, lot)
    query = lot.queries[0]
    bound = block.bounds(query)[-1]
    who, got = block.best(query, 1)
    assert len(who) == 64 and got.max() <= bound < block.most[query].sum()


def test_search_of_nothing(spark):
    index = lexical.build_index(docs_frame(spark, []))
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(index, items).count() == 0
    full = lexical.build_index(docs_frame(spark, [(1, "a b")]))
    assert lexical.search(full, items.limit(0)).count() == 0
    assert lexical.search(lexical.build_index(docs_frame(spark, [(1, None), (2, " . ")])), items).count() == 0


def test_an_index_is_read_in_groups_of_some_blocks(spark, tmp_path, monkeypatch):
    # Twelve texts that are a block each, in one partition: a reader takes them one by one, not all at once.
    monkeypatch.setattr(lexical, "GROUP_BYTES", 1_000, raising=False)
    written, cut = [], lexical.cut
    monkeypatch.setattr(lexical, "cut", lambda *a: written.append(cut(*a)) or written[-1])
    docs_frame(spark, [(i, f"w{i} " * 1_100_000) for i in range(12)]).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "w3 w4"), (2, "w11")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = lexical.op11_lexical_search(spark, str(tmp_path)).collect()
    assert sorted((r["item_id"], r["rank"], r["doc_id"]) for r in got) == [(1, 1, 3), (1, 2, 4), (2, 1, 11)]
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in written[0].inputFiles()]
    groups = [m.row_group(g).num_rows for m in files for g in range(m.num_row_groups)]
    assert sum(groups) == 12 and max(groups) <= 2
    assert not any(f.dataType.typeName() == "array" for f in written[0].schema)  # lists are unfolded in the tasks


# --- conversation tries -------------------------------------------------------------------


def brute_trie(convs):
    """convs: conv_id to its list of (role, text)."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append((c, d == len(turns)))
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    out = []
    for node, members in nodes.items():
        below = [x for x in nodes if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)  # noqa: E731, B023
        ends = ",".join(str(c) for c, last in sorted(members) if last)
        out.append(
            (
                min(c for c, _ in members), len(node), min(c for c, _ in nodes[node[:-1]]) if node else None, len(members), len(kids),
                sum(map(leaf, below)), sum((len(nodes[x]) - 1) * count(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def conv_frame(spark, convs, shuffle=True):
    rows = [(c, t, r, x) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    if shuffle:
        random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def some_conversations(seed):
    rng = random.Random(seed)
    said = [(rng.choice(["user", "assistant"]), words(rng, rng.randint(0, 4), "ab")) for _ in range(6)]
    convs = {c: [rng.choice(said) for _ in range(rng.randint(1, 5))] for c in range(80)}
    convs |= {200 + c: list(convs[0]) for c in range(60)}  # copies
    convs |= {300 + c: [("user", "hot start"), *convs[c]] for c in range(50)}  # a common first turn
    convs[500] = [("user", f"t{i}") for i in range(120)]  # a deep one
    convs[501] = convs[500][:90] + [("user", "else")]
    return convs


@pytest.mark.parametrize(("seed", "shard"), [(0, 5), (1, 40), (2, 200_000), (3, 1)])
def test_trie_against_brute_force(spark, seed, shard):
    convs = some_conversations(seed)
    frame = conv_frame(spark, convs).withColumn("path", F.lit(1)).withColumn("key", F.lit("x"))
    got = conversation_trie.trie_nodes(conversation_trie.sequences(frame), shard_turns=shard)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(convs)


def test_trie_of_odd_rows(spark):
    rows = [(1, 2, "user", "b"), (1, None, None, "a"), (2, 1, "", "a"), (2, 5, "user", "b"), (3, 1, "user", None), (3, 2, None, None), (None, 1, "user", "x"), (4, 7, "user", None), (4, 7, "user", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {1: [("", "a"), ("user", "b")], 2: [("", "a"), ("user", "b")], 3: [("user", ""), ("", "")], 4: [("user", ""), ("user", "")]}
    assert sorted((tuple(r) for r in conversation_trie.prefix_trie(frame).collect()), key=str) == brute_trie(want)
    assert conversation_trie.prefix_trie(frame.limit(0)).count() == 0
    # Role and text can't run into each other.
    two = spark.createDataFrame([(1, 1, "ab", "c"), (2, 1, "a", "bc")], "conv_id long, turn long, role string, text string")
    assert conversation_trie.prefix_trie(two).count() == 3


def test_borrowed_heads(spark):
    rng = random.Random(5)
    convs = {c: [("user", f"{c}-{i}-{rng.randint(0, 2)}") for i in range(rng.randint(1, 4))] for c in range(0, 60) if c not in (20, 41)}
    found = conversation_trie.sequences(conv_frame(spark, convs))
    conv = F.col("conv_id")
    heads = conversation_trie.with_borrowed_heads(found, conv - conv % 20, F.pmod(conv, F.lit(4)), 3)
    want = {c: convs.get(c - c % 20, [])[: c % 4] + turns[c % 4 :] for c, turns in convs.items()}
    assert sorted((tuple(r) for r in conversation_trie.trie_nodes(heads, shard_turns=30).collect()), key=str) == brute_trie(want)


def test_double_array_packs_wide_and_narrow_families():
    rng = random.Random(8)
    import numpy as np

    seqs = sorted({tuple(rng.randint(1, 300) for _ in range(rng.randint(0, 6))) for _ in range(800)} | {(c,) for c in range(1, 301)})
    lengths = np.array([len(s) for s in seqs])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    codes = np.array([c for s in seqs for c in s], np.int64)
    trie = conversation_trie.DoubleArray(codes, starts, lengths)
    slots, ends = trie.walk(codes, starts, lengths)
    prefixes = {s[:d] for s in seqs for d in range(1, len(s) + 1)}
    assert len(set(slots.tolist())) == len(prefixes) == (trie.check >= 0).sum() - 1
    assert len(set(ends.tolist())) == len(seqs)
