"""Each training-data query that has SQL, against it, on the small tables."""

import duckdb
import pytest

from loamgrid.llm.queries import QUERIES, SQL
from tests.test_queries_against_sql import TABLES, rows_of


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, sf_dir, con):
    df, want = QUERIES[name](spark, sf_dir), con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, want.fetchall())
