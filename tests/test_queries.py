"""Every catalogued query against its DuckDB SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from hushpage import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def shown(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    cur = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got = Counter(repr([shown(r[c]) for c in sorted(columns)]) for r in rows)
    want = Counter(repr([shown(v) for _, v in sorted(zip(columns, r))]) for r in cur.fetchall())
    assert got == want
