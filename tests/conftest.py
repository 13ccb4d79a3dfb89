from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

from codequarry.sources.corpus import SCHEMA
from codequarry.workers import importable


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return importable(session)


@pytest.fixture(scope="session")
def source_files(spark):
    """Build source files from (path, content) or (project, path, content)."""

    def build(*files: tuple) -> DataFrame:
        rows = [f if len(f) == 3 else ("p", *f) for f in files]
        return spark.createDataFrame(
            [(project, path, text, len(text.encode())) for project, path, text in rows], SCHEMA
        )

    return build
