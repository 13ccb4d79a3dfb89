"""The registered queries: all thirteen and the pipeline, those with SQL against it."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import differences
from codequarry.llm import queries

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")


def test_one_query_by_operator():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for file in TABLES.glob("*.parquet"):
        db.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    rows = entry.queries()[name](spark, str(TABLES)).toPandas()
    assert len(rows) > 0
    assert differences(rows, db.sql(queries.oracle_sql()[name]).df()) == ""
