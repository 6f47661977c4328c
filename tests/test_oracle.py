"""Every query with SQL gives what DuckDB gives on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from terrafold.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(value):
    if value is None or value != value:
        return "-"
    if isinstance(value, bool) or isinstance(value, str):
        return str(value)
    number = float(value)
    return repr(number) if math.isinf(number) else repr(round(number, 9) + 0.0)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    expected = duck.sql(SQL[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    want = sorted([plain(r[i]) for i in at] for r in expected.fetchall())
    assert sorted([plain(v) for v in r] for r in df.select(columns).collect()) == want


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["raster_vector_join_none", "raster_vector_join_first", "raster_vector_join_mean"])
def test_joins_of_all_points_miss_no_event(spark, duck, name):
    got = QUERIES[name](spark, str(DATA)).select("event_id").distinct().count()
    assert got == duck.sql("SELECT count(DISTINCT event_id) FROM events").fetchall()[0][0]


def test_logarithms_of_large_keys(spark, tmp_path):
    """As in copies of the tables with shifted keys: powers to beyond the largest double, digit by digit."""
    db = duckdb.connect()
    db.sql("CREATE TABLE events AS SELECT range AS event_id, TIMESTAMP '2024-01-01' AS ts, range * 3 AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{}' AS props FROM range(24000)")
    db.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    name = "vector_expression_logarithms"
    want = dict(db.sql(SQL[name]).fetchall())
    got = {r.event_id: r.result for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert want[23_999] == math.inf and got == want
