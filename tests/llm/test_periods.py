"""Periodic runs against comparing a text with itself at every lag."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from codequarry.llm import periods, queries
from tests.llm.helpers import WORD, awkward, clashing, frame, words


def brute(x: list, least: int = 12) -> list[tuple[int, int, int]]:
    found = []
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            length = i - s + q
            if length >= max(least, 2 * q):
                cut = x[s : s + length]
                if not any(cut[p:] == cut[:-p] for p in range(1, q)):
                    found.append((s, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def hard(draw: random.Random, size: int) -> list[int]:
    """Texts of few letters with many runs, nested, touching and overlapping."""
    kind = draw.randrange(6)
    if kind == 0:
        return [draw.randrange(2) for _ in range(size)]
    if kind == 1:
        unit, x = [draw.randrange(3) for _ in range(draw.randrange(1, size // 6))], []
        while len(x) < size:
            x += unit * draw.randrange(1, 4) + [draw.randrange(3)] * draw.randrange(3)
        return x
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < size:
            a, b = b, b + a
        return b[draw.randrange(5) :]
    if kind == 3:
        x = [0]
        while len(x) < size:
            x = x + [1 - v for v in x]
        return x[draw.randrange(9) :] * draw.randrange(1, 3)
    if kind == 4:  # two runs of one period that touch: a run for every odd number of letters
        u = [draw.randrange(2) for _ in range(draw.randrange(1, 5))]
        x = u * (size // 8) + u[: draw.randrange(len(u) + 1)] + u[::-1] * (size // 8)
        return x + [2] + x if draw.random() < 0.5 else x
    return ([0] * (size // 4) + [1] + [0] * (size // 4) + [draw.randrange(1, 3)]) * 2


@pytest.mark.parametrize("scale", [4, 8, 32])
def test_all_runs_of_hard_texts(monkeypatch, scale):
    monkeypatch.setattr(periods, "FIRST_SCALE", scale)
    draw = random.Random(scale)
    total = 0
    for k in range(300):
        x = hard(draw, draw.randrange(20, 60 if scale < 32 else 400 if k % 10 else 1500))
        least = draw.choice((2, 5, 12))
        want = brute(x, least)
        assert periods.find_runs(np.array(x, np.int64), least) == want, x
        total += len(want)
    assert total > 3000


def plain(text: str | None, least: int = 12) -> tuple[list, str]:
    w = WORD.findall(text or "")
    runs = brute(w, least)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, " ".join(v for i, v in enumerate(w) if i not in gone)


def repeats() -> list[tuple]:
    draw = random.Random(3)
    texts = [
        "a " * 11, "a " * 12, "a\tb\n" * 6, "a b " * 5 + "a b a", words(80, 1) + "\r\n" + words(80, 1),
        (words(33, 2) + " ") * 3, words(40, 3, 10**6) + " x" * 50 + " " + words(40, 3, 10**6) + " x" * 50,
        "  é é " * 13, "\x1c " * 20, (words(200, 4) + " ") * 4 + words(100, 4),
    ]
    texts += [" ".join(map(str, hard(draw, 150))) for _ in range(30)]
    return [(k, t, None, None, None) for k, t in enumerate(texts)]


@pytest.mark.parametrize("rows", [repeats(), awkward(), [], [(1, None, None, None, None)] * 2])
def test_collapse(spark, rows):
    docs = clashing(frame(spark, rows))
    got = [
        (r["doc_id"], [tuple(v) for v in r["runs"]], r["collapsed"]) for r in periods.collapse(docs).collect()
    ]
    # Only the text of 30,000 words is too long to compare at every lag; it has no runs.
    want = [
        (i, *(plain(t) if len(t or "") < 10**5 else ([], " ".join(WORD.findall(t))))) for i, t, *_ in rows
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)



def test_columns_pass_and_new_names_win(spark):
    docs = frame(spark, repeats()).selectExpr("*", "doc_id AS RUNS", "map('a', 1) AS more", "1.5BD AS d")
    found = periods.collapse(docs)
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "more", "d", "runs", "collapsed"]
    assert {r["more"]["a"] for r in found.collect()} == {1}


def repeated(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is None or not w:
        return text
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))


def test_whole_query(spark):
    rows = [(k, words(5 + k % 90, k, 40 if k % 2 else 10**6), None, None, None) for k in range(400)]
    rows += repeats() + [r for r in awkward() if len(r[1] or "") < 10**5]
    found = periods.digests(
        periods.collapse(queries.with_repeats(clashing(frame(spark, rows))), digest=True)
    )
    want = []
    for doc_id, text, *_ in rows:
        runs, kept = plain(repeated(doc_id, text))
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append(
            (doc_id, len(runs), s, n, q, 1000 * n // q if runs else None)
            + tuple(hashlib.sha256(v.encode()).hexdigest() for v in (lines, kept))
        )
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in got) > 40


def test_work_in_proportion_to_the_text():
    """One period over all of a text, at large and small scales, and one long run beside prose."""
    for unit in ("one ", "two words ", words(500, 1, 10**6) + " "):
        spent = []
        for size in (100_000, 200_000):
            text = (unit * (size // len(unit.split()))).encode()
            began = time.perf_counter()
            ((runs, _),) = periods.collapse_texts([text], 12, True)
            spent.append(time.perf_counter() - began)
            assert len(runs) == 1
        assert spent[1] < 4 * spent[0] + 0.2


def test_long_words_and_parts(monkeypatch):
    monkeypatch.setattr(periods, "_AT_ONCE", 3)
    text = ("ab " * 20 + "x" * 500 + " y z").encode()
    ((runs, kept),) = periods.collapse_texts([text], 12, False)
    assert runs == [(0, 20, 1)] and kept == "ab " + "x" * 500 + " y z"
