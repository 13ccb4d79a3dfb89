"""Source files derived from the ``orders`` and ``documents`` tables.

One file per order: the number of the order picks the template, a document is
its comment text, and a third of all files lies in one project. All orders and
all documents are used, each document whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.sources.corpus import as_source_files
from codequarry.sources.sample_templates import TEMPLATES

EVERY = 5  # files of a template per file without evidence
# Characters of documents in the files of a task. Tasks that order them hold these in memory.
TASK_CHARS = 384 << 20


def table(spark: SparkSession, tables: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{tables}/{name}.parquet")


def sample_files(spark: SparkSession, tables: str) -> DataFrame:
    """(project, path, content, size) derived from the tables in a directory."""
    documents = table(spark, tables, "documents")
    orders = table(spark, tables, "orders").select("o_orderkey", "o_custkey")
    # Where documents state their lengths, their texts are not read to size the tasks.
    stated = "n_chars" in documents.columns
    length = F.col("n_chars") if stated else F.length("text")
    document_count, chars = documents.agg(F.count("*"), F.sum(length)).first()
    documents = documents.select("doc_id", "text")
    templates = spark.createDataFrame(
        [(i, *t) for i, t in enumerate(TEMPLATES)],
        "template bigint, path string, evidence string, body string",
    )
    n = len(TEMPLATES)
    key = F.col("o_orderkey")
    # The orders are small next to the text made from them: spread them first, by what they are
    # joined on, over as many tasks as that text needs. Sizes of the shuffle would not tell.
    tasks = orders.count() * (chars or 0) // max(document_count, 1) // TASK_CHARS + 1
    numbered = (
        orders.withColumn("doc_id", key % document_count)
        .repartition(max(tasks, 2 * spark.sparkContext.defaultParallelism), "doc_id")
        .select(
            F.when(key % 3 == 0, "mono")
            .otherwise(F.concat(F.lit("p"), (F.col("o_custkey") % 20).cast("string")))
            .alias("project"),
            key.cast("string").alias("k"),
            (key % n).alias("template"),
            (F.floor(key / n) % EVERY == 0).alias("bare"),
            "doc_id",
        )
    )
    text = F.concat(F.when(F.col("bare"), "").otherwise(F.col("evidence")), F.col("body"))
    content = F.replace(
        F.replace(text, F.lit("<<k>>"), F.col("k")),
        F.lit("<<noise>>"),
        F.coalesce("text", F.lit("")),
    )
    return as_source_files(
        # Templates last: what is dealt by document is small as well.
        numbered.join(documents, "doc_id", "left")
        .join(F.broadcast(templates), "template")
        .select(
            "project",
            F.replace("path", F.lit("<<k>>"), F.col("k")).alias("path"),
            content.alias("content"),
        )
    )
