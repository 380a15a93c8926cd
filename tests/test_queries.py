"""Every query with SQL, against DuckDB on the driver's tables."""

import math

import duckdb
import pytest

from symscape import code_queries, document_queries, member_queries, source_queries, trial_queries  # noqa: F401
from symscape.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as con:
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
        yield con


def same(x):
    return round(x, 5) if isinstance(x, float) and not math.isnan(x) else x


def rows(found):
    return sorted((tuple(same(x) for x in r) for r in found), key=repr)


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, db, name):
    want = db.sql(SQL[name])
    got = QUERIES[name](spark, D)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.select(*want.columns).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_others_run(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
