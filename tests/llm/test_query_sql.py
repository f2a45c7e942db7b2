"""The queries of this subpackage that have DuckDB SQL, against it."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from hushpage.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in cur.description)
    assert columns == sorted(df.columns)
    shown = lambda v: round(v, 6) if isinstance(v, float) else v
    got = Counter(repr([shown(r[c]) for c in columns]) for r in df.collect())
    at = [[d[0] for d in cur.description].index(c) for c in columns]
    assert got == Counter(repr([shown(r[i]) for i in at]) for r in cur.fetchall())
