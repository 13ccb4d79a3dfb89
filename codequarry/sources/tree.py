"""Read directory trees of source files.

Spark's file sources hide names that start with ``_`` or ``.``, so
``__init__.py`` or ``.github/`` would be missing. Here the tasks walk the trees
themselves; these must be readable under the same path everywhere.

    read_trees(spark, {"shop": "/srv/shop", "blog": "/srv/blog"})

reads any number of trees in two stages: tasks list directories, a few levels at
a time, into a table of paths, and the paths are spread by hash before any file
is opened, so that neither a big project, a deep subtree nor a directory with
many files is the work of one task. For one small tree there is also a data source:

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").option("project", "shop").load("/srv/shop")
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from codequarry.sources.corpus import IGNORED_DIRECTORIES, SCHEMA

# Levels of directories that are dealt out anew each before whole subtrees are walked.
LEVELS = 4
# Bytes of text gathered for one batch.
BATCH_BYTES = 4 << 20

_LISTED = "project string, root string, path string, directory boolean"
_ARROW = pa.schema(
    [("project", pa.string()), ("path", pa.string()), ("content", pa.string()), ("size", pa.int64())]
)


def list_trees(
    spark: SparkSession, roots: dict[str, str] | DataFrame, start: str = ".", partitions: int | None = None
) -> DataFrame:
    """(project, root, path) of every file below the roots, listed in tasks.

    ``roots`` maps projects to directories, or is a table (project, root). Links are not
    followed; ignored directories below ``start`` are left out.
    """
    parts = partitions or 4 * spark.sparkContext.defaultParallelism
    if isinstance(roots, dict):
        roots = spark.createDataFrame(
            [(p, os.path.abspath(r)) for p, r in roots.items()], "project string, root string"
        )
    first = os.path.normpath(start)
    rows = roots.select("project", "root", F.lit(first).alias("path"), F.lit(True).alias("directory"))

    def opened(whole: bool):
        def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for project, root, path, directory in zip(
                    *(c.to_pylist() for c in batch.columns), strict=True
                ):
                    found = _below(root, path, whole) if directory else [(path, False)]
                    yield from _listed_batches(project, root, found)

        return step

    for level in range(LEVELS + 1):
        rows = rows.repartition(parts, "project", "path")
        rows = rows.mapInArrow(opened(whole=level == LEVELS), _LISTED)
    return rows.where("not directory").select("project", "root", "path")


def read_trees(
    spark: SparkSession, roots: dict[str, str] | DataFrame, start: str = ".", partitions: int | None = None
) -> DataFrame:
    """Source files of all trees. Files that cannot be read are passed over."""
    parts = partitions or 4 * spark.sparkContext.defaultParallelism

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row
            for batch in batches
            for project, root, path in zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for row in _read(project, root, path)
        )
        yield from _content_batches(rows)

    listed = list_trees(spark, roots, start, partitions)
    return listed.repartition(parts, "project", "path").mapInArrow(read, SCHEMA)


def _below(root: str, path: str, whole: bool) -> Iterator[tuple[str, bool]]:
    """Files of a directory and, one level down, its directories; or all files below it."""
    pending = [path]
    while pending:
        at = pending.pop()
        for entry in _readable_entries(os.path.join(root, at)):
            name = entry.name if at == "." else f"{at}/{entry.name}"
            if _is_source_directory(entry):
                if whole:
                    pending.append(name)
                else:
                    yield name, True
            elif entry.is_file(follow_symlinks=False):
                yield name, False


def _listed_batches(
    project: str, root: str, found: Iterable[tuple[str, bool]], rows: int = 10_000
) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, bool]] = []

    def batch() -> pa.RecordBatch:
        paths = [p.replace(os.sep, "/") for p, _ in held]
        columns = [[project] * len(held), [root] * len(held), paths, [d for _, d in held]]
        kinds = (pa.string(), pa.string(), pa.string(), pa.bool_())
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["project", "root", "path", "directory"],
        )

    for item in found:
        if _is_text(item[0]):
            held.append(item)
        if len(held) == rows:
            yield batch()
    if held:
        yield batch()


def _is_text(name: str) -> bool:
    """Names that are no UTF-8 cannot be paths of the corpus."""
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def _read(project: str, root: str, path: str) -> Iterator[tuple]:
    try:
        with open(os.path.join(root, path), "rb") as f:
            raw = f.read()
    except OSError:
        return
    yield project, path, raw.decode("utf-8", errors="replace"), len(raw)


def _content_batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW
        )

    for row in rows:
        held.append(row)
        size += row[3]
        if size >= BATCH_BYTES or len(held) == 10_000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


@dataclass
class Part(InputPartition):
    """Whole subtrees, and one slice of the files lying directly in a directory."""

    directory: str
    subtree: bool
    slice: int = 0
    slices: int = 1


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return SourceTreeReader(self.options)


class SourceTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["path"])
        self.project = options.get("project", os.path.basename(self.root))
        self.start = os.path.normpath(os.path.join(self.root, options.get("start", ".")))
        self.splits = int(options.get("splits", "64"))

    def partitions(self) -> list[InputPartition]:
        """Open directories breadth-first until there are enough subtrees."""
        opened: list[str] = []
        waiting = [self.start]
        while waiting and len(waiting) < self.splits and len(opened) < self.splits:
            directory = waiting.pop(0)
            opened.append(directory)
            waiting += [e.path for e in _entries(directory) if _is_source_directory(e)]
        slices = max(1, self.splits // max(1, len(opened)))
        loose = [Part(d, False, i, slices) for d in opened for i in range(slices)]
        return loose + [Part(d, True) for d in waiting]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _content_batches(self._rows(partition))

    def _rows(self, partition: Part) -> Iterator[tuple]:
        pending = [partition.directory]
        while pending:
            for entry in _entries(pending.pop()):
                if _is_source_directory(entry):
                    if partition.subtree:
                        pending.append(entry.path)
                elif entry.is_file(follow_symlinks=False) and _in_slice(entry.name, partition):
                    relative = os.path.relpath(entry.path, self.root).replace(os.sep, "/")
                    yield from _read(self.project, self.root, relative)


def _entries(directory: str) -> Iterator[os.DirEntry]:
    with os.scandir(directory) as found:
        yield from found


def _readable_entries(directory: str) -> Iterator[os.DirEntry]:
    """What can be listed of a directory; a project may be gone by the time it is read."""
    try:
        yield from _entries(directory)
    except OSError:
        return


def _is_source_directory(entry: os.DirEntry) -> bool:
    return entry.is_dir(follow_symlinks=False) and entry.name not in IGNORED_DIRECTORIES


def _in_slice(name: str, part: Part) -> bool:
    return zlib.crc32(name.encode("utf-8", "surrogateescape")) % part.slices == part.slice
