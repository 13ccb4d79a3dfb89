"""From raw documents to packed training sequences, in five stages.

Each stage reads what the one before it wrote. All but the last return the columns of
documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import mixing, packing, pii, quality, queries, simhash
from codequarry.llm.common import Scratch, pick, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    scored = quality.classify(pick(docs, *COLUMNS), table(spark, sf_dir, "labels"))
    return scored.filter("accepted").select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id, nulls last.

    Rows are elected and removed by a key of their own, so it does not matter whether doc_ids
    repeat or are null. doc_id is that key where it is one; else rows get one and are written.
    Only keys of rows that go are joined.
    """
    scratch = Scratch(spark)
    whole = pick(docs, *COLUMNS)
    key = F.col("doc_id").cast("long")
    rows, ids = whole.agg(F.count("*"), F.count_distinct(key)).first()
    if rows == ids:
        whole = whole.withColumn("row_key", key)
    else:
        whole = scratch.save(whole.withColumn("row_key", F.monotonically_increasing_id()), "whole")
    gone = scratch.save(simhash.redundant(whole, shingle=3, max_bits=2), "gone")
    return whole.join(gone.hint("shuffle_hash"), "row_key", "left_anti").select(*COLUMNS)


def pii_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data; n_chars is counted anew."""
    clean = pii.sanitise(pick(docs, *COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's rate draws, shuffled."""
    return mixing.mix_sources(pick(docs, *COLUMNS)).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences."""
    return packing.pack(docs, queries.tokenizer(), queries.CAPACITY, queries.END_ID)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii_removal", pii_removal),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# Trained models, hashes and draws have no SQL; tests hold run() against its stages by hand.
ORACLE_SQL = None
