"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from codequarry.llm import queries, spelling
from tests.llm.helpers import awkward, clashing, frame

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def is_near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts: dict[str, int], times: int = 5) -> list[tuple]:
    near = {w: [v for v in counts if v != w and is_near(v, w)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None))
    return sorted(rows)


def result(spark, counts: dict[str, int], times: int = 5) -> list[tuple]:
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted(tuple(r) for r in spelling.group_variants(words, times).collect())


def dense(seed: int, letters: str, size: int) -> dict[str, int]:
    draw = random.Random(seed)
    return {
        "".join(draw.choice(letters) for _ in range(draw.randrange(1, 6))): draw.choice((1, 2, 5, 5, 30, 150, 800))
        for _ in range(size)
    }


@pytest.mark.parametrize(
    "counts",
    [
        {},
        {"alone": 7},
        {"aaab": 3, "aab": 15, "ab": 80, "abb": 2, "abbb": 2, "ba": 1},
        {"gross": 5, "groß": 25, "gros": 25, "Gros": 25, "élan": 5, "elan": 125, "a": 1, "": 9},
        {"word": 1, "ward": 5, "wird": 5, "worde": 4, "w\U0001f600rd": 5},
        dense(1, "ab", 60),
        dense(2, "aé", 60),
        dense(3, "abcde", 300),
    ],
)
@pytest.mark.parametrize("times", [2, 5])
def test_as_by_all_pairs(spark, counts, times):
    assert result(spark, counts, times) == brute(counts, times)


def test_long_chains_reach_their_root(spark):
    counts = {"a" * k: 2**k for k in range(1, 40)}
    assert result(spark, counts, 2) == brute(counts, 2)
    assert {r[2] for r in result(spark, counts, 2)} == {"a" * 39}


def test_rows_grow_with_the_letters_only(spark):
    """One key holds every word but for one letter: a row each, no pairs."""
    words = spark.createDataFrame([(f"wor{chr(192 + k)}d", 1) for k in range(64)], "word string, n long")
    assert spelling.rotations(words).count() == 64 * (5 + 6)
    found = spelling.group_variants(words).collect()
    assert {r["n_near"] for r in found} == {63}


def counted(rows: list[tuple], length: int, least: int) -> dict[str, int]:
    found = Counter()
    for doc_id, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= length and n >= least}


def prose_rows() -> list[tuple]:
    draw = random.Random(5)
    stems = ["".join(draw.choice("aeilnorstÉéß×÷A") for _ in range(draw.randrange(2, 9))) for _ in range(60)]
    return [
        (k, ", ".join(draw.choice(stems) for _ in range(200)), None, None, None) for k in range(60)
    ] + [(None, "Wörter wörter wÖrter " * 20, None, None, None), (3, None, None, None, None)]


@pytest.mark.parametrize("rows", [prose_rows(), awkward(), []])
def test_vocabulary_and_whole_query(spark, rows):
    docs = clashing(frame(spark, rows))
    words = spelling.vocabulary(docs, least_length=6, least_count=5, respell=queries.misspelt)
    assert {r["word"]: r["n"] for r in words.collect()} == counted(rows, 6, 5)
    found = sorted(tuple(r) for r in spelling.group_variants(words).collect())
    assert found == brute(counted(rows, 6, 5))
    plain = spelling.vocabulary(docs, least_length=1, least_count=1)
    runs = [r for _, t, *_ in rows for r in RUN.findall(t or "")]
    assert sum(r["n"] for r in plain.collect()) == len(runs)


def test_refuses_forms_no_more_frequent(spark):
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([], "word string, n long"), times=1)
