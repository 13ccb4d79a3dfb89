"""Embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.llm.common import Scratch, add_fields, components, pick, rank_within, with_columns

# Principal dimensions of the grid; rows of a block; rows below which all pairs are compared.
GRID_DIMENSIONS = 8
BLOCK_ROWS = 1024
LEAF_ROWS = 64
# Children of an interval: 2 ** FANOUT_BITS.
FANOUT_BITS = 4
# Added to the squared radius when blocks are skipped, against rounding of coordinates.
SLACK = 1e-6


def usable() -> Column:
    """Whether a row can link: label set, components set and finite, not the zero vector."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    known = F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return F.coalesce(known & fine & some, F.lit(False))


def principal_axes(classes: DataFrame, size: int, axes: int) -> np.ndarray:
    """Leading eigenvectors (size x axes) of the second moments of unit vectors of that size.

    Tasks sum up their rows; Spark adds up the sums, a row of the matrix to a group.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = _matrix(batch.column("embedding"), size)
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            total += x.T @ x
        rows = pa.array([r.tobytes() for r in total], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), rows], names=["at", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(r, float) for r in table.column("sums").to_pylist())
        return pa.table({"at": table.column("at").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    same = classes.filter(F.size("embedding") == size).select("embedding")
    kind = "at long, sums binary"
    summed = same.mapInArrow(moments, kind).groupBy("at").applyInArrow(add, kind)
    matrix = np.zeros((size, size))
    for at, sums in summed.collect():
        matrix[at] = np.frombuffer(sums, float)
    _, vectors = np.linalg.eigh(matrix)
    return vectors[:, ::-1][:, :axes]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def _boxes_apart(a: np.ndarray, b: np.ndarray, limit: float) -> bool:
    gap = np.maximum(np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)), 0)
    return float(gap @ gap) > limit


def join_intervals(
    a: tuple[np.ndarray, np.ndarray, np.ndarray],
    b: tuple[np.ndarray, np.ndarray, np.ndarray],
    cosine: float,
    limit: float,
    at: tuple[int, int] = (0, 0),
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= `cosine` between two intervals (vectors, norms, grid coords).

    Halves whose boxes are farther apart than the radius are skipped; small ones are compared.
    """
    if _boxes_apart(a[2], b[2], limit):
        return
    n, m = len(a[0]), len(b[0])
    if max(n, m) <= LEAF_ROWS:
        likeness = (a[0] @ b[0].T) / (a[1][:, None] * b[1][None, :])
        i, j = np.nonzero(likeness >= cosine)
        if len(i):
            yield i + at[0], j + at[1]
        return
    for s in (slice(0, (n + 1) // 2), slice((n + 1) // 2, n)) if n > LEAF_ROWS else (slice(0, n),):
        for t in (slice(0, (m + 1) // 2), slice((m + 1) // 2, m)) if m > LEAF_ROWS else (slice(0, m),):
            left, right = tuple(x[s] for x in a), tuple(x[t] for x in b)
            yield from join_intervals(
                left, right, cosine, limit, (at[0] + s.start, at[1] + t.start)
            )


def _least_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index linked to each of n, by repeated minima."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.98,
    axes: int = GRID_DIMENSIONS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links of cosine >= `cosine` within a label.

    Cosines are taken in double precision. n_links counts other vectors linked directly,
    component_id is the smallest vec_id reachable (itself included), kept marks that vector.

    Equal vectors of a label are one class with a count. Classes are sorted by label and then
    by grid cell on the leading principal axes, cell width being the Euclidean radius of the
    cosine. The sorted sequence is cut into blocks, and intervals of blocks are joined from
    the whole sequence downwards: a pair of intervals whose boxes are farther apart than the
    radius, or of different labels, is dropped with all below it. A task that compares two
    blocks returns a link count and a local component by vector, never pairs.

    A vector that is null, zero, holds nulls or non-finite numbers, or has no label links with
    nothing; vectors of different sizes don't link; a null vec_id never names a component
    unless alone; repeated rows are vectors of their own; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    chosen = pick(vectors, "vec_id", "embedding", "label")
    # Components stay as wide as they come; arithmetic is in double precision.
    kind = "float" if chosen.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "double"
    rows = chosen.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast(f"array<{kind}>").alias("embedding"),
        F.col("label").cast("string").alias("label"),
    )
    fine = rows.filter(usable())
    classes = fine.groupBy("label", "embedding").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies")
    )
    # Rows find their class by two hashes of the vector if these tell all classes apart.
    keys = {
        "key_a": F.xxhash64("label", "embedding"),
        "key_b": F.xxhash64("embedding", F.lit("b"), "label"),
    }
    numbered = classes.withColumn("class_id", F.monotonically_increasing_id()).withColumns(keys)
    classes = scratch.save(numbered, "classes")
    clear = classes.groupBy(*keys).count().filter("count > 1").isEmpty()
    by = [*keys] if clear else ["label", "embedding"]
    radius = float(np.sqrt(max(2 - 2 * cosine, 1e-6)))
    limit = radius * radius + SLACK
    sizes = classes.groupBy(F.size("embedding").alias("size")).count()
    top = sizes.orderBy(F.desc("count"), "size").first()
    if top is None:
        found = None
    else:
        turn = principal_axes(classes, top["size"], axes)
        width = np.float32 if kind == "float" else np.float64
        found = _joined(classes, turn, cosine, radius, limit, axes, block_rows, width, scratch)
    if found is None:
        return rows.select(
            "vec_id",
            F.lit(0).cast("long").alias("n_links"),
            F.col("vec_id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch, "stars")
    links = found.groupBy("node").agg(F.sum("links").alias("others"))
    known = classes.join(links, classes["class_id"] == links["node"], "left").drop("node")
    known = known.join(roots, known["class_id"] == roots["node"], "left")
    known = known.withColumn("group_id", F.coalesce("root", "class_id"))
    names = known.groupBy("group_id").agg(F.min("first").alias("component_id"))
    known = known.join(names, "group_id").select(
        *by,
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"),
        "component_id",
    )
    # Written, so that the engine can split a class that holds many rows.
    known = scratch.save(known, "known")
    joined = fine.withColumns(keys).select("vec_id", *by).join(known, by)
    linked = joined.select(
        "vec_id",
        F.col("links").cast("long").alias("n_links"),
        "component_id",
        F.col("component_id").eqNullSafe(F.col("vec_id")).alias("kept"),
    )
    alone = rows.filter(~usable()).select(
        "vec_id", F.lit(0).cast("long"), F.col("vec_id").alias("component_id"), F.lit(True)
    )
    return linked.union(alone)


def _joined(
    classes: DataFrame,
    turn: np.ndarray,
    cosine: float,
    radius: float,
    limit: float,
    axes: int,
    block_rows: int,
    width: type,
    scratch: Scratch,
) -> DataFrame:
    """(node, links, root) by class and pair of blocks that hold links of it."""
    cells = [f"cell_{d}" for d in range(axes)]

    def coordinates(x: np.ndarray) -> np.ndarray:
        unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
        if x.shape[1] == len(turn):
            return unit @ turn
        grid = np.zeros((len(x), axes))
        grid[:, : min(axes, x.shape[1])] = unit[:, :axes]
        return grid

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            sizes = column.value_lengths().to_numpy()
            grid = np.zeros((len(sizes), axes), np.int32)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = _matrix(column.take(pa.array(at)), int(size))
                grid[at] = np.floor(coordinates(x) / radius)
            yield with_columns(batch, **{c: grid[:, d] for d, c in enumerate(cells)})

    place = F.concat_ws("|", F.lpad(F.size("embedding").cast("string"), 9, "0"), "label")
    members = classes.select("class_id", "copies", "embedding", place.alias("place"))
    located = members.mapInArrow(locate, add_fields(members, **{c: T.IntegerType() for c in cells}))
    located = scratch.save(located, "located")
    order = ["place", *cells, "class_id"]
    ordered = located.repartitionByRange(*order).sortWithinPartitions(*order)

    names = ["place", "ids", "copies", "vectors", *(f"lo_{d}" for d in range(axes)), *(f"hi_{d}" for d in range(axes))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            x = np.array([r[3] for r in held], float)
            grid = coordinates(x)
            values = [
                held[0][0],
                np.array([r[1] for r in held], np.int64).tobytes(),
                np.array([r[2] for r in held], np.int64).tobytes(),
                x.astype(width).tobytes(),
                *grid.min(axis=0).tolist(),
                *grid.max(axis=0).tolist(),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=names)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("place", "class_id", "copies", "embedding"))
            for row in zip(*columns, strict=True):
                if held and (len(held) == block_rows or held[0][0] != row[0]):
                    yield block()
                held.append(row)
        if held:
            yield block()

    schema = T.StructType(
        [
            T.StructField("place", T.StringType()),
            *(T.StructField(c, T.BinaryType()) for c in names[1:4]),
            *(T.StructField(c, T.DoubleType()) for c in names[4:]),
        ]
    )
    blocks = ordered.mapInArrow(cut, schema).withColumn("whole", F.lit(0).cast("long"))
    blocks = rank_within(blocks, "whole", scratch, "blocks").drop("whole")

    boxes = [F.min("place").alias("from"), F.max("place").alias("to")]
    boxes += [F.min(f"lo_{d}").alias(f"lo_{d}") for d in range(axes)]
    boxes += [F.max(f"hi_{d}").alias(f"hi_{d}") for d in range(axes)]
    narrow = blocks.select("rank", *(c for c in names if c not in names[1:4]))
    leaves = scratch.save(narrow.groupBy("rank").agg(*boxes), "level_0")
    count = leaves.count()
    levels = 0
    while count > 1 << (FANOUT_BITS * levels):
        levels += 1
    # The whole sequence with itself, as a table: constants would turn the join into a product.
    whole = leaves.agg(F.min("rank").alias("a"), F.min("rank").alias("b"))
    pairs = scratch.save(whole.select("a", "b"), "whole")
    near = F.lit(0.0)
    for d in range(axes):
        gap = F.greatest(
            F.col(f"x.lo_{d}") - F.col(f"y.hi_{d}"), F.col(f"y.lo_{d}") - F.col(f"x.hi_{d}"), F.lit(0.0)
        )
        near = near + gap * gap
    close = (
        (F.col("x.rank") <= F.col("y.rank"))
        & (F.col("x.from") <= F.col("y.to"))
        & (F.col("y.from") <= F.col("x.to"))
        & (near <= limit)
    )
    for level in range(max(levels - 1, 0), -1, -1):
        bits = FANOUT_BITS * level
        merged = [F.min("from").alias("from"), F.max("to").alias("to"), *boxes[2:]]
        nodes = leaves
        if level:
            nodes = leaves.withColumn("rank", F.shiftright("rank", bits)).groupBy("rank").agg(*merged)
        nodes = nodes.withColumn("parent", F.shiftright("rank", FANOUT_BITS))
        x, y = nodes.alias("x"), nodes.alias("y")
        pairs = pairs.join(x, F.col("a") == F.col("x.parent")).join(y, F.col("b") == F.col("y.parent"))
        pairs = scratch.save(
            pairs.filter(close).select(F.col("x.rank").alias("a"), F.col("y.rank").alias("b")),
            f"pairs_{level}",
        )

    data = blocks.select("rank", F.struct("ids", "copies", "vectors").alias("block"))
    both = (
        pairs.join(data.select(F.col("rank").alias("a"), F.col("block").alias("left")), "a")
        .join(data.select(F.col("rank").alias("b"), F.col("block").alias("right")), "b")
        .select("a", "b", "left", "right")
    )

    def read(block: dict) -> tuple:
        ids = np.frombuffer(block["ids"], np.int64)
        x = np.frombuffer(block["vectors"], width).astype(float).reshape(len(ids), -1)
        return ids, np.frombuffer(block["copies"], np.int64), (x, np.sqrt((x * x).sum(1)), coordinates(x))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, left, right = (batch.column(c)[k].as_py() for c in range(4))
                ids, copies, one = read(left)
                found = list(join_intervals(one, one if a == b else read(right)[2], cosine, limit))
                if not found:
                    continue
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                if a == b:
                    i, j = i[i < j], j[i < j]
                else:
                    other, other_copies, _ = read(right)
                    j = j + len(ids)
                    ids, copies = np.append(ids, other), np.append(copies, other_copies)
                links = np.zeros(len(ids), np.int64)
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                root = ids[_least_reachable(len(ids), i, j)]
                on = links > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[on]), pa.array(links[on]), pa.array(root[on])],
                    names=["node", "links", "root"],
                )

    return scratch.save(both.mapInArrow(compare, "node long, links long, root long"), "found")
