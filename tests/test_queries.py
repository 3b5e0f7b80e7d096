"""Every query of the evaluation-log engine with an oracle, against it, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidelog.plans import field_queries, projection_queries, record_queries, stream_queries, text_queries, window_queries

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = window_queries.QUERIES | text_queries.QUERIES | field_queries.QUERIES | stream_queries.QUERIES | record_queries.QUERIES | projection_queries.QUERIES
ORACLES = window_queries.ORACLES | text_queries.ORACLES | field_queries.ORACLES | stream_queries.ORACLES | record_queries.ORACLES | projection_queries.ORACLES


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda v: "" if v is None else repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(value(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not SF.exists(), reason="the test tables are absent")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, duck, name):
    got = QUERIES[name](spark, str(SF))
    expected = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(expected.fetchall(), expected.columns)
