"""Every query with an oracle gives the oracle's rows, on the smallest tables."""

import duckdb
import pytest

from tidewave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return connection


def plain(value):
    if value is None or str(value) == "<NA>" or value != value:
        return "-"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    try:
        return f"{float(value) + 0.0:.9g}" if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return str(value)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, row)) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_oracle(spark, duck, name):
    got = rows_of(registry.QUERIES[name](spark, SF).toPandas())
    want = rows_of(duck.sql(registry.ORACLES[name]).df())
    assert got == want
