"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def said(rows):
    return sorted(tuple("null" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_rows(spark, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    assert sorted(d[0] for d in want.description) == columns
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert said(df.select(*columns).collect()) == said([[r[i] for i in order] for r in want.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
