"""Every training-data query that has SQL, against DuckDB on the given tables."""
import duckdb
import pytest

from conftest import SF_MID
from rebound.llm.registry import QUERIES


def _norm(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_equals_sql(spark, name):
    build, sql = QUERIES[name]
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_MID}/{t}.parquet')")
    got = build(spark, SF_MID)
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(got.columns)
    assert _norm(got.select(cols).collect()) == _norm(res.fetchall())
