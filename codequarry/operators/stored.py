"""Facts and interfaces by file, written once and kept up to date, for the operators that start
from them.

Mappings, flows and counts all run the same rules over the same text. Stored facts hold what
they are made of, one row by file, so that later queries read no source text:

    write_facts(files, "/lake/facts")
    facts = read_facts(spark, "/lake/facts")
    flows.interface_flows(facts)

    refresh_facts(files, "/lake/facts")     # after an edit: changed files alone are analysed

``mapping.map_interfaces``, ``mapping.mapping_count``, ``flows.interface_flows``,
``flows.file_flows`` and ``flows.flow_counts`` take them in place of source files.

A row keeps the digest of its text, so the table is its own manifest, and one that a lost
driver left half refreshed is put right by the next refresh.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.facts import flow_files
from codequarry.operators.flows import analyse
from codequarry.sources.corpus import SCHEMA

PARTITIONS = ("kind", "bucket")
# Directories by language that files are dealt to by a hash of their path: as much of a
# language as one changed file has rewritten.
BUCKETS = 16
# Changed files that are also looked up by a list of their paths, which Parquet skips by.
LISTED = 1000


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did, in files and in directories written."""

    added: int
    changed: int
    deleted: int
    unchanged: int
    rewritten: int


def write_facts(
    files: DataFrame,
    target: str,
    path: str = ".",
    mode: str = "errorifexists",
    buckets: int = BUCKETS,
) -> None:
    """Write the facts of source files as Parquet, by language and a hash of the path."""
    _write(_analysed(files, path, buckets), target, mode)


def read_facts(spark: SparkSession, source: str) -> DataFrame:
    return _stored(spark, source).drop(*PARTITIONS, "digest", "buckets")


def _stored(spark: SparkSession, source: str) -> DataFrame:
    try:
        return spark.read.parquet(source)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        # All files were deleted, and their directories with them.
        schema = _analysed(spark.createDataFrame([], SCHEMA), ".", BUCKETS).schema
        return spark.read.schema(schema).parquet(source)


def refresh_facts(files: DataFrame, target: str, path: str = ".") -> Refreshed:
    """Bring stored facts to what `write_facts` would write for these files, analysing only
    those that are new or whose text differs.

    Keys and digests are compared, in one join without texts where the corpus stores digests.
    Directories with a difference are written anew: stored rows of unchanged files as they are,
    analysed ones for the others. All else is neither read nor written. Each directory is
    replaced as a whole when all have been written; until then readers see the old ones.
    """
    spark = files.sparkSession
    stored = _stored(spark, target)
    first = stored.select("buckets").head()
    buckets = first["buckets"] if first else BUCKETS
    current = _keys(files, path, buckets)
    known = stored.select("project", "file", F.col("digest").alias("known"), *PARTITIONS)
    keys = ["project", "file", *PARTITIONS]
    compared = current.join(known, keys, "full")
    state = (
        F.when(F.col("known").isNull(), "added")
        .when(F.col("digest").isNull(), "deleted")
        .when(F.col("known") != F.col("digest"), "changed")
        .otherwise("unchanged")
    )
    # What differs is asked for three times; to find it texts may be read for their digests.
    compared = compared.select("project", "file", *PARTITIONS, state.alias("state"))
    compared = compared.persist(StorageLevel.DISK_ONLY)
    try:
        return _brought_up(files, path, stored, compared, target, buckets)
    finally:
        compared.unpersist()


def _brought_up(
    files: DataFrame, path: str, stored: DataFrame, compared: DataFrame, target: str, buckets: int
) -> Refreshed:
    # At most as many rows as there are directories and states.
    summary = compared.groupBy(*PARTITIONS, "state").count().collect()
    total: dict[str, int] = defaultdict(int)
    left: dict[tuple, int] = defaultdict(int)
    touched = set()
    for r in summary:
        place = (r["kind"], r["bucket"])
        total[r["state"]] += r["count"]
        if r["state"] != "deleted":
            left[place] += r["count"]
        if r["state"] != "unchanged":
            touched.add(place)
    if touched:
        differing = compared.where(F.col("state") != "unchanged").select("project", "file", "state")
        _replace(files, path, stored, differing, touched, total, target, buckets)
        _delete([p for p in touched if not left[p]], target, files.sparkSession)
    return Refreshed(
        total["added"], total["changed"], total["deleted"], total["unchanged"], len(touched)
    )


def _replace(
    files: DataFrame,
    path: str,
    stored: DataFrame,
    differing: DataFrame,
    touched: set[tuple],
    total: dict[str, int],
    target: str,
    buckets: int,
) -> None:
    fresh = differing.where(F.col("state") != "deleted")
    number = total["added"] + total["changed"]
    wanted = fresh.select("project", F.col("file").alias("path"))
    changed = files
    if number <= LISTED:
        listed = sorted({r["path"] for r in wanted.select("path").distinct().collect()})
        changed = changed.where(F.col("path").isin(listed))
    changed = changed.join(wanted, ["project", "path"], "left_semi")
    kept = stored.where(_any_of(touched)).join(differing, ["project", "file"], "left_anti")
    rows = kept.unionByName(_analysed(changed, path, buckets)) if number else kept
    _write(rows, target, "overwrite")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("project", "file"), F.lit(buckets)).cast("int")


def _with_digest(files: DataFrame) -> DataFrame:
    return files if "digest" in files.columns else files.withColumn("digest", F.md5("content"))


def _keys(files: DataFrame, path: str, buckets: int) -> DataFrame:
    """(project, file, kind, bucket, digest) of the files that have facts."""
    code = flow_files(_with_digest(files), path, also=("digest",))
    # Files without a text have facts as well, and a digest that no text has.
    return code.select(
        "project",
        "file",
        F.col("language").alias("kind"),
        _bucket(buckets).alias("bucket"),
        F.coalesce("digest", F.lit("")).alias("digest"),
    )


def _analysed(files: DataFrame, path: str, buckets: int) -> DataFrame:
    facts = analyse(_with_digest(files), path, also=("digest",))
    return facts.withColumns(
        {
            "digest": F.coalesce("digest", F.lit("")),
            "buckets": F.lit(buckets),
            "kind": F.col("language"),
            "bucket": _bucket(buckets),
        }
    )


def _any_of(places: set[tuple]) -> Column:
    by_kind: dict[str, list[int]] = defaultdict(list)
    for kind, bucket in places:
        by_kind[kind].append(bucket)
    tests = [(F.col("kind") == k) & F.col("bucket").isin(sorted(b)) for k, b in by_kind.items()]
    return reduce(lambda a, b: a | b, tests)


def _write(facts: DataFrame, target: str, mode: str) -> None:
    writer = facts.hint("rebalance", *PARTITIONS).write.partitionBy(*PARTITIONS).mode(mode)
    writer.option("partitionOverwriteMode", "dynamic").parquet(target)


def _delete(places: list[tuple], target: str, spark: SparkSession) -> None:
    """Directories that lost all their files; overwriting by partition leaves them as they are."""
    jvm = spark._jvm
    for kind, bucket in places:
        folder = jvm.org.apache.hadoop.fs.Path(f"{target}/kind={kind}/bucket={bucket}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
