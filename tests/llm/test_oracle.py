"""Every corpus query with SQL against DuckDB, over the whole small tables."""

import duckdb
import pytest

from textloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = db.execute(queries.ORACLE[name])
    columns = [d[0] for d in found.description]
    want = [dict(zip(columns, r, strict=True)) for r in found.fetchall()]
    got = queries.QUERIES[name](spark, SF)
    key = lambda r: tuple(str(r[c]) for c in sorted(columns))
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(key, want)) == sorted(key(r.asDict()) for r in got.collect())
