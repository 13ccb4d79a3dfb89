"""Text search over files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.sources.corpus import scan


def occurrences(text: Column, query: str) -> Column:
    """Non-overlapping occurrences of a literal, ignoring case."""
    lowered, needle = F.lower(text), F.lower(F.lit(query))
    removed = F.length(lowered) - F.length(F.replace(lowered, needle, F.lit("")))
    return (removed / F.length(needle)).cast("int")


def search_files(files: DataFrame, query: str, path: str = ".") -> DataFrame:
    """Files of any kind that contain the query: (project, path, matches)."""
    if not query:
        raise ValueError("query must not be empty")
    found = F.lower("content").contains(F.lower(F.lit(query)))
    return (
        scan(files, path)
        .where(found)
        .select("project", "path", occurrences(F.col("content"), query).alias("matches"))
    )


def search_text(table: DataFrame, query: str, key: str, text: str) -> DataFrame:
    """The same search over any table with a key and a text column."""
    if not query:
        raise ValueError("query must not be empty")
    found = F.lower(text).contains(F.lower(F.lit(query)))
    return table.where(found).select(key, occurrences(F.col(text), query).alias("matches"))
