"""What the operators share: scratch tables, ranks without hot tasks, components, hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.workers import importable

FOLDER = "spark.checkpoint.dir"
# Arrow batches handed to Python tasks: a few MB of text, however long the documents are.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": (str(2**31 - 1), str(16 << 20)),
}


# A row group is buffered whole by each task that writes one.
ROW_GROUP_BYTES = 8 << 20


class Scratch:
    """Tables written to the shared folder of the cluster, to cut lineage and to read twice.

    The folder is the session's `spark.checkpoint.dir`; only a local session without that
    setting gets a temporary one. A written table survives lost executors.
    """

    def __init__(self, spark: SparkSession):
        conf = importable(spark).sparkContext.getConf()
        folder = conf.get(FOLDER) or spark.conf.get(FOLDER, None)
        if not folder:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError(f"set {FOLDER} to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="codequarry-")
            spark.conf.set(FOLDER, folder)
        self.spark = spark
        self.saved: set[str] = set()
        self.folder = f"{folder.rstrip('/')}/codequarry-{uuid.uuid4().hex}"
        for key, (default, value) in BATCHES.items():
            if spark.conf.get(key, default) == default:
                spark.conf.set(key, value)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write and reread."""
        path = f"{self.folder}/{name}"
        self.saved.add(name)
        writer = df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def lean(scan: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a Python task, which hands unused memory back when its rows end.

    Workers are used again by later tasks and stages, next to the JVM of their executor.
    """

    @wraps(scan)
    def run(batches: Iterator) -> Iterator:
        yield from scan(batches)
        release_memory()

    return run


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc
        trim(0)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The first column of each name, by place: other columns of like names don't matter."""
    places = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return places.select(*(F.col(f"_{df.columns.index(n)}").alias(n) for n in names))


def distinct_names(df: DataFrame, *needed: str, without: tuple[str, ...] = ()) -> list[str]:
    """Columns that an operator passes on: of names alike but for case the needed one, else the
    first; none of `without`."""
    taken = {n.lower() for n in (*needed, *without)}
    names = []
    for n in dict.fromkeys(df.columns):
        if n in needed or n.lower() not in taken:
            names.append(n)
            taken.add(n.lower())
    return names


def keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(row_key, doc_id, text): a unique key by row, in the order of doc_id with nulls last.

    It is doc_id itself where that is unique. Else rows are put in order by (doc_id, digest of
    the text), numbered and written: repeated rows are documents of their own.
    """
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        return docs.select(F.col("doc_id").alias("row_key"), "doc_id", "text")
    order = [F.col("doc_id").asc_nulls_last(), F.md5(F.coalesce("text", F.lit("")).cast("binary"))]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.save(
        ordered.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", "text"), "keyed"
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add_fields(df: DataFrame, **kinds: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in kinds.items())])


def with_columns(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *arrays], names=[*batch.schema.names, *columns]
    )


def rank_within(df: DataFrame, key: str, scratch: Scratch, name: str) -> DataFrame:
    """Adds `rank`, from 0 without gaps within each value of the long column `key` (not null).

    No key is brought to one task: tasks number their own rows, the table is written, and the
    counts by (key, task) become offsets. A key may hold any share of the rows.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            values, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
            order = np.argsort(inverse, kind="stable")
            first = np.cumsum(counts) - counts
            base = np.array([seen.get(int(v), 0) for v in values], np.int64)
            local = np.empty(len(keys), np.int64)
            local[order] = np.arange(len(keys)) - np.repeat(first, counts)
            local += base[inverse]
            for v, n in zip(values.tolist(), counts.tolist(), strict=True):
                seen[v] = seen.get(v, 0) + n
            yield with_columns(batch, rank_part=np.full(len(keys), part, np.int32), rank_local=local)

    schema = add_fields(df, rank_part=T.IntegerType(), rank_local=T.LongType())
    numbered = scratch.save(df.mapInArrow(number, schema), name)
    before = Window.partitionBy(key).orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy(key, "rank_part")
        .agg(F.count("*").alias("n"))
        .select(key, "rank_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_base"))
    )
    joined = numbered.join(offsets, [key, "rank_part"])
    return joined.withColumn("rank", F.col("rank_base") + F.col("rank_local")).drop(
        "rank_part", "rank_local", "rank_base"
    )


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of the graph of `edges` (a long, b long): root is the smallest node reachable.

    Alternating large and small stars: each node links its greater neighbours to its least
    one, then its lesser ones. Only nodes with edges are returned. Nothing reaches the driver
    but a count and a checksum by round; every round is written, so lineage stays short. The
    least neighbours are written as well: both sides of a join are then read as they lie, so
    the engine can split the edges of a hub over tasks, which it cannot below an aggregate.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars = scratch.save(both.filter("u <> v").distinct(), f"{name}_0")
    state, turn = None, 0
    while True:
        found = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if found == state or not found[0]:
            break
        state, turn = found, turn + 1
        sides = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m"))
        least = scratch.save(least.select("u", F.least("u", "m").alias("m")), f"{name}_least_{turn}")
        large = sides.filter("v > u").join(least, "u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"{name}_large_{turn}")
        lowest = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}_lowest_{turn}")
        small = large.join(lowest, "u").filter("v <> m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = scratch.save(
            small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), f"{name}_{turn}"
        )
        for done in (f"{name}_{turn - 1}", *(f"{name}_{k}_{turn}" for k in ("least", "large", "lowest"))):
            scratch.drop(done)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


# Hashes of words, for whole texts at a time -------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BLOCK = 1 << 18
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, _BLOCK)
        for side, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[side] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of h."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _block_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = _SPACE[raw]
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return mix(hashes ^ ((ends - starts).astype(np.uint64) << np.uint64(40))), starts, ends


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words `[^\\x20\\x09-\\x0D]+` of UTF-8 text: hash (uint64), first byte, end byte.

    Long texts go in blocks cut between words, so tables of powers stay small.
    """
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= 2 * _BLOCK:
        return _block_words(raw)
    found, at = [], 0
    while at < len(raw):
        end = min(at + _BLOCK, len(raw))
        while end < len(raw):
            ahead = np.flatnonzero(_SPACE[raw[end : end + _BLOCK]])
            if len(ahead):
                end += int(ahead[0])
                break
            end = min(end + _BLOCK, len(raw))
        h, s, e = _block_words(raw[at:end])
        found.append((h, s + at, e + at))
        at = end
    h, s, e = zip(*found, strict=True)
    return np.concatenate(h), np.concatenate(s), np.concatenate(e)


def window_hashes(words: np.ndarray, at: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of the `length` words that begin at each of `at`."""
    if salt:
        words = mix(words, salt)
    total = np.zeros(len(at), np.uint64)
    for j in range(length):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += words[at + j]
    return mix(total, salt)
