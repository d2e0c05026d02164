import os

import duckdb
import pytest

from quillmill.plans import oracles
from quillmill.plans.queries import QUERIES


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_gives_what_sql_gives(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    a = QUERIES[name](spark, sf_dir)
    b = con.execute(oracles.SQL[name])
    columns = [c[0] for c in b.description]
    assert sorted(a.columns) == sorted(columns)
    key = lambda r: repr(r)
    assert sorted([tuple(map(plain, r)) for r in a.select(*columns).collect()], key=key) == sorted([tuple(map(plain, r)) for r in b.fetchall()], key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracles.SQL)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
