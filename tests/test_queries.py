"""Registered queries against their checking SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import differences
from codequarry.plans import oracle
from codequarry.plans import queries as registered

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")

SQL = entry.oracle_sql()
# The others of these families share their code with the ones here.
CHECKED = [
    "scan_files", "directory_inventory", "list_directory", "read_files", "decode_text",
    "search_files", "search_pages", "file_languages", "iface_nestjs", "iface_spring",
    "iface_warp", "discover_interfaces", "analyze_files", "socket_handlers", "map_interfaces",
    "interface_flows", "file_flows", "flow_counts", "package_profiles", "project_profiles",
    "json_flows", "json_packages", "search_index", "read_stored_files", "discover_stored",
    "refreshed_facts", "project_pages",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in TABLES.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_query_has_sql():
    assert set(registered.queries()) == set(oracle.oracle_sql())
    assert set(registered.queries()) <= set(entry.queries()) and set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, db, name):
    rows = entry.queries()[name](spark, str(TABLES)).toPandas()
    assert len(rows) > 0
    assert differences(rows, db.sql(SQL[name]).df()) == ""


def test_sample_keys_are_unique(spark):
    from codequarry.sources.sample import sample_files

    files = sample_files(spark, str(TABLES))
    assert files.count() == files.select("project", "path").distinct().count()
