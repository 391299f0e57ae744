"""Every query with SQL gives the rows that DuckDB gives."""

from datetime import datetime

import duckdb
import pytest

from stintframe.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def in_order(rows):
    rows = [tuple(str(x) if isinstance(x, datetime) else x for x in r) for r in rows]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = in_order(tuple(r[c] for c in columns) for r in df.collect())
    q = con.execute(SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == columns
    want = in_order(tuple(r[names.index(c)] for c in columns) for r in q.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-4, nan_ok=True) if any(isinstance(x, float) for x in a) and None not in a else a == b
