"""Medians of large groups against plain ones, and the robust z that uses them."""

import random
import statistics

import pytest

from tests.test_oracle import rows_of
from tidewave.operators import quality_control as Q
from tidewave.plans import registry


def drawn():
    rng = random.Random(5)
    groups = {("a", "x"): [rng.gauss(0, 1) for _ in range(4001)], ("a", None): [rng.gauss(0, 1) for _ in range(3000)]}
    groups[None, None] = [rng.choice([1.0, 2.0, 3.0]) for _ in range(2000)]  # ties
    groups["b", "x"] = [0.0] * 500 + [1.0] * 500  # between two values
    groups["b", "y"] = [1e18, -1.0, 7.0, float("inf"), None]
    return groups | {("c", "x"): [5.0], ("c", "y"): [None, None]}


@pytest.mark.parametrize(("bracket", "accuracy"), [(Q.BRACKET, Q.ACCURACY), (0.0001, 2), (None, Q.ACCURACY)])
def test_medians_are_exact(spark, monkeypatch, bracket, accuracy):
    # With an accuracy of 2 the brackets lie anywhere, and medians are found all the same.
    monkeypatch.setattr(Q, "ACCURACY", accuracy)
    rows = [(p, q, v) for (p, q), values in drawn().items() for v in values]
    random.Random(6).shuffle(rows)
    frame = spark.createDataFrame(rows, "p string, q string, v double").repartition(5)
    got = {(r["p"], r["q"]): r["median"] for r in Q.medians(frame, "v", ["p", "q"], bracket).collect()}
    assert got == {k: statistics.median([v for v in values if v is not None]) for k, values in drawn().items() if k != ("c", "y")}


def test_brackets_that_miss_are_noticed(spark, monkeypatch):
    # Both ends of the bracket lie beyond the median of one group, at either side.
    looked = []
    plain = Q.medians
    monkeypatch.setattr(Q, "medians", lambda *a: looked.append(a[3]) or plain(*a))
    for shares in ((0.1, 0.2), (0.8, 0.9)):
        monkeypatch.setattr(Q.F, "percentile_approx", lambda column, *_, s=shares: Q.F.percentile(column, Q.F.array(*map(Q.F.lit, s))))
        assert [tuple(r) for r in plain(spark.range(1001).selectExpr("1 as k", "id as v"), "v", ["k"]).collect()] == [(1, 500.0)]
    assert looked == [None, None]


def test_robust_z_of_rows_without_a_flag(spark, tmp_path):
    import duckdb

    rng = random.Random(7)
    rows = [(i, i % 7, rng.choice("AN") if i % 3 else None, rng.choice("OF") if i % 5 else None, round(rng.uniform(1, 9), 2) if i % 11 else None) for i in range(3000)]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_extendedprice double").write.parquet(path)
    connection = duckdb.connect()
    connection.execute(f"create view lineitem as select * from read_parquet('{path}/*.parquet')")
    want = rows_of(connection.sql(registry.ORACLES["qc_robust_z"]).df())
    assert rows_of(registry.QUERIES["qc_robust_z"](spark, str(tmp_path)).toPandas()) == want and len(want[1]) > 100
