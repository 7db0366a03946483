"""Every geometric query with SQL gives the rows that DuckDB gives."""

import math
from pathlib import Path

import pytest

from prismark import queries

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not FOLDER.is_dir(), reason="no tables here")


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    want = db.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, str(FOLDER))
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(tuple(map(plain, r)) for r in got.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())
