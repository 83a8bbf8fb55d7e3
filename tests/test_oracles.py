"""Every registered query of the workforce operators against its DuckDB text, at the smallest scale."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from compare import TABLES, _digest  # noqa: E402

from staffline.catalog import QUERIES  # noqa: E402
from staffline.oracle import ORACLE  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    res = duck.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    theirs = res.fetchall()
    ours = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(cols)
    assert len(ours) == len(theirs)
    assert _digest(df.columns, ours, 9) == _digest(cols, theirs, 9)
