"""Every registered query runs; those with SQL give the rows that the SQL gives."""

import os

import duckdb
import pytest

from glossmark.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    rows = got.collect()
    assert len(set(got.columns)) == len(got.columns)
    if name not in SQL:
        assert rows
        return
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    norm = lambda r: tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else x for x in r)
    a, b = sorted((norm(tuple(r[c] for c in columns)) for r in rows), key=repr), sorted(map(norm, want.fetchall()), key=repr)
    assert len(a) == len(b)
    assert a == b
