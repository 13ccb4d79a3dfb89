"""What files and directories a project has."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from codequarry.functions.text import extension
from codequarry.sources.corpus import kind, only_kinds, scan, under

# Paths that are looked up by a list, in one filter.
LISTED = 200


def file_inventory(files: DataFrame, path: str = ".") -> DataFrame:
    """(project, path) of every scanned file; reads no text."""
    return scan(files, path).select("project", "path")


def _directories(files: DataFrame, name: str) -> DataFrame:
    """Every directory on the way to a file.

    Directories are made distinct before their parents are listed, so one with
    very many files counts once per task.
    """
    holder = F.regexp_extract("path", r"(?s)\A(.*)/[^/]*\z", 1)
    holders = files.select("project", holder.alias("holder")).where("holder <> ''").distinct()
    parts = F.split("holder", "/")
    depths = F.sequence(F.lit(1), F.size(parts))
    upward = F.transform(depths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return holders.select("project", F.explode(upward).alias(name)).distinct()


def directory_inventory(files: DataFrame, path: str = ".") -> DataFrame:
    """(project, directory) of every directory that holds scanned files."""
    return under(_directories(scan(files, path), "path"), path).select(
        "project", F.col("path").alias("directory")
    )


def list_directory(files: DataFrame, directory: str) -> DataFrame:
    """Children of a directory, ignored ones included: (project, name, type)."""
    below = under(files, directory)
    depth = len([p for p in directory.split("/") if p not in ("", ".")])
    parts = F.split("path", "/")
    is_directory = F.size(parts) > depth + 1
    return below.select(
        "project",
        parts[depth].alias("name"),
        F.when(is_directory, "directory").otherwise("file").alias("type"),
    ).distinct()


def file_info(files: DataFrame) -> DataFrame:
    """Type, size in bytes and extension, as written, of every file."""
    return files.select(
        "project",
        "path",
        F.lit("file").alias("type"),
        "size",
        extension(F.col("path")).alias("extension"),
    )


def directory_info(files: DataFrame) -> DataFrame:
    """Every directory as (project, path, type); a table of files knows no sizes of them."""
    return _directories(files, "path").select(
        "project", "path", F.lit("directory").alias("type")
    )


def read_files(files: DataFrame, wanted: DataFrame, listed: int = LISTED) -> DataFrame:
    """Content of the wanted (project, path) pairs.

    Up to ``listed`` pairs are also compared one by one, which Parquet skips row groups and
    pages by: a stored corpus is in order of (project, path), below directories that the names
    tell. More are a plain equi-join: Spark broadcasts ``wanted`` when its size allows and joins
    by hash or sort otherwise.
    """
    keys = wanted.select("project", "path").distinct()
    if "kind" in files.columns:
        few = keys.withColumn("kind", kind(F.col("path"))).limit(listed + 1).collect()
        if len(few) <= listed:
            files = only_kinds(files, *sorted({r["kind"] for r in few})).where(_is_one_of(few))
    return files.join(keys, ["project", "path"]).select("project", "path", "content")


def _is_one_of(keys: list[Row]) -> Column:
    by_project: dict[str, list[str]] = defaultdict(list)
    for r in keys:
        if r["project"] is not None and r["path"] is not None:
            by_project[r["project"]].append(r["path"])
    tests = [
        (F.col("project") == project) & reduce(or_, [F.col("path") == p for p in sorted(paths)])
        for project, paths in sorted(by_project.items())
    ]
    return reduce(or_, tests, F.lit(False))
