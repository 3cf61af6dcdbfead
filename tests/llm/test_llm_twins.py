"""Corpus queries that SQL can express, beside their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from gavel.llm.oracle import ORACLE
from gavel.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, sf, name):
    with duckdb.connect() as con:
        for path in Path(sf).glob("*.parquet"):
            con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        want = con.sql(ORACLE[name])
        columns, rows = want.columns, want.fetchall()
    frame = QUERIES[name](spark, sf)
    assert sorted(frame.columns) == sorted(columns)
    assert sorted(map(tuple, frame.select(*columns).collect()), key=repr) == sorted(rows, key=repr)
