"""The table of source files every operator reads.

``source_files(project, path, content, size)`` holds one row per file;
``(project, path)`` is its key. As Parquet it is laid out by ``kind``, so that
work on paths reads no text, package manifests are found without touching code,
and code operators skip everything that is not code. Below it is laid out by the
rules whose words a file holds, so that interface rules skip files without them.
A ``digest`` of each text tells changed files from others without reading text.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.functions.languages import LANGUAGES, flow_language
from codequarry.functions.text import basename
from codequarry.rules.base import Detector
from codequarry.rules.evidence import EVIDENCE, evident, evidence

SCHEMA = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("size", T.LongType()),
    ]
)

# --- fixed values: directories never scanned, at any depth ------------------
IGNORED_DIRECTORIES = ("node_modules", ".git", "dist", "build", "coverage")
# -----------------------------------------------------------------------------

# Rows of a page, the least that a filter on project and path can skip.
PAGE_ROWS = 200

PACKAGE_KIND = "package"
OTHER_KIND = "other"
CODE_KINDS = tuple(sorted({key for key, _ in LANGUAGES.values()}))


def decode(raw: Column) -> Column:
    """Bytes as UTF-8 text, each malformed sequence replaced by U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def as_source_files(df: DataFrame) -> DataFrame:
    """Bring (project, path, content) with text or binary content to the schema."""
    binary = isinstance(df.schema["content"].dataType, T.BinaryType)
    text = decode(F.col("content")) if binary else F.col("content")
    size = F.col("size") if "size" in df.columns else F.octet_length("content")
    return df.select(
        "project", "path", text.alias("content"), size.cast("bigint").alias("size")
    )


def from_binary_files(df: DataFrame, root: str, project: str | None = None) -> DataFrame:
    """Source files from rows of Spark's ``binaryFile`` format, at any store Spark reads.

    Paths are taken relative to ``root``. Their first part is the project, unless all files
    are of one ``project``. Spark's file sources pass over names that start with ``.`` or
    ``_``; where these matter, list and read with ``sources/tree.py``.
    """
    start = root.rstrip("/") + "/"
    placed = df.select("content", "path", F.instr("path", start).alias("at")).where("at > 0")
    below = placed.select("content", F.substr("path", F.col("at") + len(start)).alias("below"))
    if project is not None:
        return as_source_files(
            below.select(F.lit(project).alias("project"), F.col("below").alias("path"), "content")
        )
    owned = below.where(F.col("below").contains("/")).select(
        F.substring_index("below", "/", 1).alias("project"),
        F.substr("below", F.instr("below", "/") + 1).alias("path"),
        "content",
    )
    return as_source_files(owned)


def kind(path: Column) -> Column:
    return F.coalesce(
        F.when(basename(path) == "package.json", PACKAGE_KIND),
        flow_language(path),
        F.lit(OTHER_KIND),
    )


def write_corpus(
    files: DataFrame,
    target: str,
    mode: str = "errorifexists",
    rebalance: bool = False,
    row_group_bytes: int = 16 << 20,
) -> None:
    """Write source files as Parquet, by kind and evidence, files ordered by (project, path).

    A kind has at most as many directories as its rules have combinations, 128.
    Texts are not shuffled: each task orders the rows it holds and writes them, so there are as
    many files as tasks times directories that they meet. Few tasks of some 256 MB of text make
    few files and still order them in memory. With ``rebalance`` one shuffle of all texts gathers
    each directory into files of the advisory partition size, splitting large ones, for tables
    that come in many small tasks. Within a file rows are in order, so a filter on a project or a
    subtree skips the row groups that lie outside of it. A scan is split by row
    groups; as its work is CPU, these are smaller than is usual.
    """
    laid_out = files.withColumns(
        {
            "digest": F.md5("content"),
            "kind": kind(F.col("path")),
            EVIDENCE: evidence(F.col("path"), F.col("content")),
        }
    )
    if rebalance:
        laid_out = laid_out.hint("rebalance", "kind", EVIDENCE)
    ordered = laid_out.sortWithinPartitions("kind", EVIDENCE, "project", "path")
    writer = ordered.write.partitionBy("kind", EVIDENCE).mode(mode)
    # Rows are skipped by pages of the columns that a filter names, which hold few bytes by row.
    writer = writer.option("parquet.page.row.count.limit", PAGE_ROWS)
    # Two thirds of what the default codec leaves of source texts.
    writer = writer.option("compression", "zstd")
    writer.option("parquet.block.size", row_group_bytes).parquet(target)


def read_corpus(spark: SparkSession, source: str) -> DataFrame:
    """Source files from Parquet, with or without the layout by kind."""
    return spark.read.parquet(source)


def only_kinds(files: DataFrame, *kinds: str) -> DataFrame:
    """Skip the other kinds where the table is laid out by kind."""
    return files.where(F.col("kind").isin(*kinds)) if "kind" in files.columns else files


def only_evident(files: DataFrame, detectors: Iterable[Detector]) -> DataFrame:
    """Skip files in which none of the rules can find anything, where that is stored."""
    return files.where(evident(detectors)) if EVIDENCE in files.columns else files


def under(files: DataFrame, directory: str) -> DataFrame:
    """Files below a directory given relative to the project root."""
    prefix = _prefix(directory)
    return files.where(F.col("path").startswith(prefix)) if prefix else files


def scan(files: DataFrame, directory: str = ".") -> DataFrame:
    """Files below a directory, without those in ignored directories.

    An ignored directory that is named as the start itself is scanned.
    """
    prefix = _prefix(directory)
    relative = F.substring(F.col("path"), len(prefix) + 1, 2**31 - 1)
    names = "|".join(d.replace(".", r"\.") for d in IGNORED_DIRECTORIES)
    return under(files, directory).where(~relative.rlike(f"(?:^|/)(?:{names})/"))


def _prefix(directory: str) -> str:
    parts = [p for p in directory.split("/") if p not in ("", ".")]
    return "".join(p + "/" for p in parts)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row, null fields left out."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
