"""Exact duplicates by a 128-bit hash of the content, in DataFrame functions throughout."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import Scratch, pick

# A group that holds more than this part of all rows is hot; there are fewer of them than this.
HOT_SHARE = 1000


def ascii_lower(text: Column) -> Column:
    """A-Z alone in lower case; null as empty. `lower` does just that where all is ASCII."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(
        F.translate(whole, string.ascii_uppercase, string.ascii_lowercase)
    )


def md5_of(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def duplicates(
    docs: DataFrame, keep: str = "smallest", content_hash: Callable[[Column], Column] = md5_of
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for each row of `docs`.

    Texts are equal when identical after A-Z became lower case. Of equal texts the row of the
    `smallest` or `largest` doc_id stays (keep_id), marked by kept.

    Rows are grouped by a 128-bit hash. Texts of one hash are then compared byte by byte; where
    it stands for different ones, its rows are grouped by the texts themselves. Each task sends
    a text once, however many copies it meets, and that is the only shuffle of texts.

    Null text counts as empty; null doc_ids lose to any other; of equal doc_ids the row read
    first stays, so repeated rows leave one; an empty table gives an empty result. Election
    reads counts combined by task. Groups above 1/1000 of the rows, so fewer than 1000, are
    broadcast to the rows, and no other key holds more than that share.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep the smallest or the largest")
    scratch = Scratch(docs.sparkSession)
    texts = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(F.col("text")).alias("whole")
    )
    hashed = texts.withColumn("hash", content_hash(F.col("whole")))
    digest = F.unhex(F.sha2("whole", 256))
    rows = scratch.save(
        hashed.select(
            F.monotonically_increasing_id().alias("row_key"), "doc_id", "hash", digest.alias("digest")
        ),
        "rows",
    )
    groups = scratch.save(_elected(rows, keep, "hash"), "groups")
    collided = scratch.save(_collisions(hashed), "collided")
    if collided.isEmpty():
        return _named(rows, groups, scratch, "hash")

    # Rows of such hashes are grouped by their texts instead.
    apart = scratch.save(
        hashed.join(collided, "hash", "left_semi").select(
            F.monotonically_increasing_id().alias("row_key"), "doc_id", "hash", "whole",
            digest.alias("digest"),
        ),
        "apart",
    )
    by_text = scratch.save(_elected(apart, keep, "hash", "whole"), "by_text")
    sound = rows.join(collided, "hash", "left_anti")
    return _named(sound, groups, scratch, "hash").union(
        _named(apart, by_text, scratch, "hash", "whole")
    )


def _elected(rows: DataFrame, keep: str, *key: str) -> DataFrame:
    """(*key, group_size, keep_id, keep_key) of the groups of two and more rows."""
    # The complement turns the order round and cannot overflow.
    rank = F.col("doc_id") if keep == "smallest" else F.bitwise_not("doc_id")
    order = F.struct(F.col("doc_id").isNull().alias("null"), rank.alias("rank"), "row_key", "doc_id")
    found = rows.groupBy(*key).agg(F.count("*").alias("group_size"), F.min(order).alias("first"))
    return found.filter("group_size > 1").select(
        *key, "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row_key").alias("keep_key")
    )


def _collisions(hashed: DataFrame) -> DataFrame:
    """(hash): those that stand for more than one text, by comparing whole texts."""
    texts = hashed.groupBy("hash", "whole").count().groupBy("hash")
    return texts.agg(F.count("*").alias("texts")).filter("texts > 1").select("hash")


def _named(rows: DataFrame, groups: DataFrame, scratch: Scratch, *key: str) -> DataFrame:
    """Every row with its group: hot groups are broadcast, the others joined by key."""
    most = rows.count() // HOT_SHARE
    # Each hot group has more than 1/1000 of the rows, so there are fewer than 1000.
    hot = F.broadcast(groups.filter(F.col("group_size") > most)) if most else None
    joined = rows if hot is None else rows.join(hot.select(*key), [*key], "left_anti")
    joined = joined.join(groups.filter(F.col("group_size") <= most) if most else groups, [*key], "left")
    if hot is not None:
        joined = joined.unionByName(rows.join(hot, [*key]))
    alone = F.col("keep_key").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_key") == F.col("keep_key"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
