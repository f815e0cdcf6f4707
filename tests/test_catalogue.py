"""Every query with an oracle gives the oracle's rows at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test data")


def rows(columns, records):
    return sorted(tuple("-" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in records) if columns else []


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, db, name):
    df = entry.queries()[name](spark, str(SF)).toPandas()
    want = db.execute(entry.oracle_sql()[name]).fetchdf()
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert rows(columns, df[columns].itertuples(index=False, name=None)) == rows(columns, want[columns].itertuples(index=False, name=None))


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_queries_have_names():
    assert len(entry.queries()) >= len(entry.oracle_sql()) > 50


def test_functions_of_all_code_lines(spark):
    found = entry.queries()["spread_functions_code"](spark, str(SF))
    assert sum(r["n"] for r in found.collect()) == spark.read.parquet(f"{SF}/lineitem.parquet").count()
