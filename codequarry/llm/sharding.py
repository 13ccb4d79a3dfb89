"""Sharding: groups that must stay together go to shards of near equal size."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.llm.common import Scratch, add_fields, pick, rank_within, with_columns

# Groups whose size agrees in this many leading bits are one size class. It bounds the plan:
# 2 ** SIZE_BITS classes for each doubling of the size, and exact classes below that.
SIZE_BITS = 10


def spread(loads: list[float], size: float, count: int) -> list[int]:
    """How many of `count` items of one size each shard gets if each goes to the least loaded.

    Whole rounds are filled up to a common level at once, the last few items go by a heap.
    """
    taken = [0] * len(loads)
    left = count
    while left > 2 * len(loads):
        open_ = sorted(loads[i] + taken[i] * size for i in range(len(loads)))
        level, used = 0.0, 0.0
        for n, load in enumerate(open_, 1):
            used += load
            level = (used + left * size) / n
            if n == len(open_) or level <= open_[n]:
                break
        more = [max(0, int((level - loads[i]) / size) - taken[i] - 1) for i in range(len(loads))]
        if not 0 < sum(more) <= left:
            break
        taken = [t + m for t, m in zip(taken, more, strict=True)]
        left -= sum(more)
    heap = [(loads[i] + taken[i] * size, i) for i in range(len(loads))]
    heapq.heapify(heap)
    for _ in range(left):
        load, i = heapq.heappop(heap)
        taken[i] += 1
        heapq.heappush(heap, (load + size, i))
    return taken


def schedule(classes: list[tuple[int, int, int]], n_shards: int) -> list[tuple[int, int, int]]:
    """Longest processing time first over (class, groups, bytes): (class, first rank, shard).

    Classes are taken by falling mean size of a group; the groups of a class are ranked from
    0, and those from `first rank` up to the next entry of the class go to `shard`.
    """
    loads = [0.0] * n_shards
    plan = []
    for kind, count, total in sorted(classes, key=lambda c: (-c[2] / c[1], c[0])):
        rank, size = 0, total / count
        for shard, n in enumerate(spread(loads, size, count)):
            if n:
                plan.append((kind, rank, shard))
                rank += n
                loads[shard] += n * size
    return plan


def _class_of(size: np.ndarray) -> np.ndarray:
    shift = np.maximum(np.floor(np.log2(size.astype(float))).astype(np.int64) - SIZE_BITS, 0)
    return (shift << 32) | (size >> shift)


def shard_documents(docs: DataFrame, n_shards: int = 8, max_classes: int = 1 << 20) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): equal texts share a shard, sizes are near equal.

    size is the UTF-8 bytes of the text plus one. Groups of equal texts, by falling total
    size, go to the shard that is least loaded; groups of one size class are alike, so the
    plan is made on counts by class and groups find their shard by their rank within it.
    slot numbers the documents of a shard from 0 without gaps.

    Null and empty texts are one group (size 1 each); ties are broken by place, repeated rows
    are documents of their own; an empty table gives an empty result. No group and no shard
    is brought to one task: a group is a count until its documents are joined with its shard
    (split by the engine where skewed), and slots are counted by task. `max_classes` bounds
    what the plan holds on the driver; 64-bit sizes stay below it by the width of classes.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = scratch.save(
        pick(docs, "doc_id", "text").select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
        ),
        "rows",
    )
    group = ["text_hash", "text_crc32", "size"]
    groups = rows.groupBy(group).agg((F.sum("size")).alias("bytes"))

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield with_columns(batch, size_class=_class_of(batch.column("bytes").to_numpy()))

    groups = groups.mapInArrow(classes, add_fields(groups, size_class=T.LongType()))
    ranked = rank_within(groups, "size_class", scratch, "groups")
    counted = ranked.groupBy("size_class").agg(F.count("*"), F.sum("bytes"))
    planned = [tuple(r) for r in counted.limit(max_classes + 1).collect()]
    if len(planned) > max_classes:
        raise ValueError("too many size classes")
    plan = sorted(schedule(planned, n_shards))
    kinds = np.array([p[0] for p in plan], np.int64)
    firsts = np.array([p[1] for p in plan], np.int64)
    shards = np.array([p[2] for p in plan], np.int32)
    sent = docs.sparkSession.sparkContext.broadcast((kinds, firsts, shards))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, firsts, shards = sent.value
        for batch in batches:
            kind = batch.column("size_class").to_numpy()
            rank = batch.column("rank").to_numpy()
            low = np.searchsorted(kinds, kind)
            at, most = low.copy(), np.searchsorted(kinds, kind, "right") - 1
            while True:  # at most as often as there are shards
                on = np.minimum(at + 1, most)
                go = (on > at) & (firsts[on] <= rank)
                if not go.any():
                    break
                at[go] = on[go]
            yield with_columns(batch, shard=shards[at])

    placed = ranked.mapInArrow(place, add_fields(ranked, shard=T.IntegerType()))
    members = rows.join(placed.select(*group, "shard"), group)
    members = members.select("doc_id", "size", "text_crc32", "shard")
    return rank_within(members, "shard", scratch, "members").withColumnRenamed("rank", "slot")
