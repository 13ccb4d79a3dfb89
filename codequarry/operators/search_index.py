"""An index that search skips by: which blocks of a corpus hold which trigrams.

    write_search_index(spark, "/lake/source_files", "/lake/search")
    search_indexed(spark, "/lake/source_files", "/lake/search", "password").show()

A block is a few consecutive rows of one Parquet file, about BLOCK_BYTES of text. Of each the
index holds the least and greatest key and a set of the trigrams of bytes in the lower-cased
text, hashed to 2^16 bits: 8 KB by block, under a hundredth of the text. A text that contains a
query holds its trigrams, so blocks without one of them are not read. The others are, by their
keys, and searched as ever: results are those of `search_files`.

Parquet files never change once written. Those that the index does not know are read whole, and
`write_search_index` with mode "append" indexes them alone; what it knows of files that are gone
is passed over. So an index that is behind costs time, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.search import search_files
from codequarry.workers import importable

BLOCK_BYTES = 1 << 20
BITS = 16
# Blocks that are looked up by their keys; if more may hold a query, their files are read whole.
MOST_BLOCKS = 200
_SCHEMA = (
    "part string, rows long, first_project string, first_path string, "
    "last_project string, last_path string, grams array<long>"
)


def gram_bits(text: bytes) -> np.ndarray:
    """The bits of all trigrams of bytes."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    codes = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return (codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


class _Block:
    def __init__(self, part: str):
        self.part, self.rows, self.size = part, 0, 0
        self.first = self.last = None
        self.marks = np.zeros(1 << BITS, bool)

    def add(self, key: tuple[str, str], text: bytes) -> None:
        self.first = key if self.first is None else min(self.first, key)
        self.last = key if self.last is None else max(self.last, key)
        self.rows += 1
        self.size += len(text)
        if len(text) > 2:
            self.marks[gram_bits(text)] = True

    def row(self) -> tuple:
        words = np.packbits(self.marks, bitorder="little").view("<i8").tolist()
        return (self.part, self.rows, *self.first, *self.last, words)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64()] + [pa.string()] * 4 + [pa.list_(pa.int64())]
    names = [f.split()[0] for f in _SCHEMA.split(", ")]

    def out(blocks: list[_Block]) -> pa.RecordBatch:
        columns = zip(*(b.row() for b in blocks), strict=True)
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    block = None
    for batch in batches:
        for part, project, path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block is not None and (block.part != part or block.size >= block_bytes):
                yield out([block])
                block = None
            if block is None:
                block = _Block(part)
            # An order of code points, as that of UTF-8 bytes in Parquet.
            block.add((project or "", path or ""), (text or "").encode("utf-8", "surrogatepass"))
    if block is not None:
        yield out([block])


def _indexed(spark: SparkSession, index: str) -> DataFrame:
    try:
        return spark.read.schema(_SCHEMA).parquet(index)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA)


def write_search_index(
    spark: SparkSession,
    corpus: str,
    index: str,
    mode: str = "errorifexists",
    block_bytes: int = BLOCK_BYTES,
) -> None:
    """Index a corpus that `write_corpus` wrote; with "append" the files not indexed yet.

    Tasks read the corpus as it lies and return a row by block; nothing is shuffled.
    """
    importable(spark)
    files = spark.read.parquet(corpus)
    rows = files.select(
        F.col("_metadata.file_path").alias("part"), "project", "path", F.lower("content").alias("text")
    )
    if mode == "append":
        new = sorted(_listed(files) - _parts(spark, index))
        if not new:
            return
        rows = _only_parts(spark, corpus, new).select(
            F.col("_metadata.file_path").alias("part"), "project", "path", F.lower("content").alias("text")
        )
    blocks = rows.mapInArrow(lambda batches: _blocks(batches, block_bytes), _SCHEMA)
    blocks.write.mode(mode).parquet(index)


def _same(part: str) -> str:
    """The file as rows name theirs; listings write local ones with more slashes."""
    return part.replace("file:///", "file:/", 1) if part.startswith("file:///") else part


def _listed(files: DataFrame) -> set[str]:
    return set(map(_same, files.inputFiles()))


def _parts(spark: SparkSession, index: str) -> set[str]:
    """Files the index knows: a list as long as the listing of the corpus."""
    return {_same(r["part"]) for r in _indexed(spark, index).select("part").distinct().collect()}


def _only_parts(spark: SparkSession, corpus: str, parts: list[str]) -> DataFrame:
    return spark.read.option("basePath", corpus).parquet(*map(unquote, parts))


def _may_hold(needle: bytes) -> Column:
    """Blocks whose set has all trigrams of the needle."""
    masks: dict[int, int] = {}
    for bit in gram_bits(needle).tolist():
        masks[bit // 64] = masks.get(bit // 64, 0) | 1 << bit % 64
    tests = []
    for word, mask in sorted(masks.items()):
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        tests.append(F.get("grams", F.lit(word)).bitwiseAND(F.lit(signed).cast("long")) == signed)
    return reduce(lambda a, b: a & b, tests)


def _between(first: tuple[str, str], last: tuple[str, str]) -> Column:
    """Keys from one to another, in comparisons that Parquet skips row groups and pages by."""
    project, path = F.col("project"), F.col("path")
    if first[0] == last[0]:
        return (project == first[0]) & path.between(first[1], last[1])
    return (
        (project.between(*(k[0] for k in (first, last))))
        & ((project > first[0]) | (path >= first[1]))
        & ((project < last[0]) | (path <= last[1]))
    )


def candidates(spark: SparkSession, corpus: str, index: str, query: str) -> DataFrame:
    """The part of the corpus that may hold the query: all of it if the index cannot tell.

    A list of blocks reaches the driver, of at most MOST_BLOCKS with their keys; beyond it a list
    of the files they are in, which is no longer than the listing of the corpus.
    """
    files = spark.read.parquet(corpus)
    # In lower case by the same rules as the texts.
    lowered = spark.range(1).select(F.lower(F.lit(query)).alias("q")).head()["q"]
    needle = lowered.encode("utf-8", "surrogatepass")
    if len(needle) < 3:
        return files
    listed = _listed(files)
    unknown = sorted(listed - _parts(spark, index))
    found = _indexed(spark, index).where(_may_hold(needle))
    blocks = found.drop("grams", "rows").limit(MOST_BLOCKS + 1).collect()
    if len(blocks) > MOST_BLOCKS:
        held = {_same(r["part"]) for r in found.select("part").distinct().collect()} & listed
        wanted = sorted(held) + unknown
        return _only_parts(spark, corpus, wanted) if len(wanted) < len(listed) else files
    blocks = [b for b in blocks if _same(b["part"]) in listed]
    read = [_only_parts(spark, corpus, unknown)] if unknown else []
    if blocks:
        parts = sorted({b["part"] for b in blocks})
        ranges = [
            _between((b["first_project"], b["first_path"]), (b["last_project"], b["last_path"]))
            for b in blocks
        ]
        read.append(_only_parts(spark, corpus, parts).where(reduce(lambda a, b: a | b, ranges)))
    if not read:
        return files.limit(0)
    return reduce(lambda a, b: a.unionByName(b), read)


def search_indexed(
    spark: SparkSession, corpus: str, index: str, query: str, path: str = "."
) -> DataFrame:
    """(project, path, matches) as `search_files` gives, reading what may hold the query."""
    if not query:
        raise ValueError("query must not be empty")
    return search_files(candidates(spark, corpus, index, query), query, path)
