"""Small tables with every awkward case, and plain restatements of the operators."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n: int, seed: int, size: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(size)}" for _ in range(n))


def prose() -> list[tuple]:
    """Clean documents: copies, near copies, shared passages, one hot source."""
    passage = words(60, 1, 10**6)
    rows = []
    for k in range(40):
        text = words(30 + 7 * k, 100 + k, 10**6)
        if k % 5 == 0:
            text = f"{words(15, 500 + k, 10**6)} {passage}\n{text}"
        if k % 7 == 3:
            text = rows[1][1]
        if k % 9 == 4:
            text = rows[2][1] + " end"
        rows.append((k, text, ("en", "de")[k % 2], "hot" if k % 3 else f"s{k % 4}", len(text)))
    return rows


def awkward() -> list[tuple]:
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows."""
    long = words(30_000, 9)
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, "Ünï 1.2.3.4 \U0001f600 a@b.co", "de", "", 9),
        (5, long, "en", "a", len(long)),
        (6, long, "en", "a", len(long)),
        (7, "one two", None, "b", 7),
        (7, "one two", None, "b", 7),
        (8, "other " + words(50, 3), "de", "b", -1),
        (8, words(50, 3), "de", "b", 1),
        (None, words(40, 4), "de", "b", 1),
        (None, None, "de", "b", 1),
        (None, "x" * 70_000, "en", "b", 70_000),
    ]


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, DOCS)


def clashing(docs: DataFrame) -> DataFrame:
    """With more columns, named as the operators name theirs."""
    from pyspark.sql import functions as F

    names = ["row_key", "rank", "bits", "kept", "length", "shard", "size", "copy", "rate", "spans", "TEXT"]
    return docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))


def groups(ids: list, linked) -> dict:
    """Smallest id reachable, by trying all pairs."""
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
