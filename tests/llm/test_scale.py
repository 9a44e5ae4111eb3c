"""What keeps memory and tasks bounded: held rows, cells, keys of rows without ids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_lines, docs_frame
from tidewave.llm import line_dedup, mixing, topk


@pytest.mark.parametrize("hold", [0, 3, 50])
def test_line_dedup_holds_few_rows(spark, hold):
    rng = random.Random(11)
    lines = [f"line {i} " + "x" * 40 for i in range(6)]
    rows = [(i, "\n".join(rng.choice([*lines, f"own {rng.random()}"]) for _ in range(rng.randint(1, 40)))) for i in range(12)]
    rows += [(50, "\n".join([lines[0]] * 400)), (51, "\n".join(["only here " + "y" * 40] * 300)), (52, "\n".join(["three " + "z" * 40] * 90)), (53, "three " + "z" * 40), (54, "three " + "z" * 40)]
    done = line_dedup.keep_lines(docs_frame(spark, rows), hold=hold).select("rest.doc_id", "n_lines", "n_dropped", "kept_text")
    assert sorted(map(tuple, done.collect())) == sorted(brute_lines(rows))


@pytest.mark.parametrize("second", [False, True])
def test_cells_are_prefixes(second):
    draw = np.random.default_rng(1)
    groups = [(g, w, float(t), 0.0, 5) for w in (2, 3) for g, t in zip(range(100 * w, 100 * w + 40), sorted(draw.integers(1, 9, 40), reverse=True), strict=True)]
    blocks = [(b, w, 1.0, float(low), 5) for w in (2, 3, 4) for b, low in zip(range(1000 * w, 1000 * w + 30), sorted(draw.integers(0, 10, 30)), strict=True)]
    cells = topk.Cells(blocks, groups, second)
    longest = {w: max((t, -g) for g, v, t, _, _ in groups if v == w)[1] for w in (2, 3)}
    wanted = {f"{b}/{g}" for b, w, _, low, _ in blocks for g, v, top, _, _ in groups if v == w and ((-g != longest[w] and top * (1 + topk.SLACK) >= low) if second else -g == longest[w])}
    assert {c for b, *_ in blocks for c in cells.from_block(b)} == wanted == {c for g, *_ in groups for c in cells.from_group(g)}


def test_cells_hold_no_pairs():
    many = [(i, 8, 5.0, 1.0, 16_384) for i in range(100_000)]
    cells = topk.Cells(many, many, True)
    # Ten thousand million pairs, some numbers each per group and block.
    assert sum(map(len, (cells.of_block, cells.of_group, cells.groups[8], cells.blocks[8]))) == 400_000
    assert next(cells.from_block(99_999)) == "99999/1" and cells.of_block[5] == (8, 100_000)


def test_rows_without_ids_spread_over_the_buckets(spark):
    rows = [(None, f"w{i} a b", None, "s", None) for i in range(1200)] + [(i, "a b c", None, "s", None) for i in range(2400)]
    keyed = docs_frame(spark, rows).select("doc_id", mixing.order_key(F.col("source"), F.col("doc_id"), F.col("text")).alias("o"))
    assert keyed.where("doc_id is null").select("o").distinct().count() == 1200
    mixed = mixing.mix_sources(docs_frame(spark, rows))
    assert mixed.count() == 3600 and mixed.agg(F.sum("taken")).first()[0] == pytest.approx(3600 * 3, abs=3)
