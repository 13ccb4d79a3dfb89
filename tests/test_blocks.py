"""Handler blocks and windows: exact on random texts, linear on long ones."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from codequarry.functions import blocks
from codequarry.functions.patterns import Rx
from codequarry.functions.text import matches_with_window
from tests.test_text import closing_brace

HEAD = re.compile(r"socket\.on\('(\w+)',")


def cut(text: str) -> list[str]:
    pieces, at = [], 0
    for m in HEAD.finditer(text):
        pieces += [text[at : m.start()], m[0]]
        at = m.end()
    return [*pieces, text[at:]]


def plain_handlers(text: str) -> list[tuple]:
    found, free = [], 0
    for m in HEAD.finditer(text):
        if m.start() < free:
            continue
        arrow = text.find("=>", m.end())
        brace = text.find("{", arrow) if arrow >= 0 else -1
        body = closing_brace(text[brace:]) if brace >= 0 else ""
        if body:
            free = brace + len(body)
            lines = (text.count("\n", 0, m.start()) + 1, text.count("\n", 0, free) + 1)
            found.append((m[1], body, m.start(), *lines))
    return found


def test_blocks_behind_random_braces():
    rng = random.Random(7)
    pieces = ["{", "}", "{", "}", "'", '"', "`", "//", "/*", "*/", "\\", "\n", "a", "/", "*", " "]
    closed = 0
    for _ in range(1500):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 60)))
        known = blocks.Blocks(text)
        places = [i for i, c in enumerate(text) if c == "{"]
        rng.shuffle(places)
        for i in places:
            body = closing_brace(text[i:])
            assert known.end(i) == (i + len(body) if body else -1)
            closed += bool(body)
    assert closed > 1500


def test_handlers_in_random_texts():
    rng = random.Random(8)
    pieces = [
        "socket.on('a',", "socket.on('b',", "=>", "=> {", "{", "}", "}", "\n", "'", "//", "/*", "*/", "x",
    ]
    found = 0
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 50)))
        rows = blocks.handler_blocks(cut(text))
        assert rows == plain_handlers(text)
        found += len(rows)
    assert found > 1000


def test_a_handler_over_many_other_starts(source_files):
    from codequarry.operators import mapping

    inner = "\n".join(f"socket.on('i{k}', () => {{}})" for k in range(40))
    text = f"socket.on('a', () => {{\n{inner}\n}})\nsocket.on('z', () => {{ 1 }})"
    rows = mapping.socket_handlers(source_files(("a.js", text), ("b.md", text))).collect()
    assert [(r.file, r.event, r.line, r.end_line) for r in rows] == [("a.js", "a", 1, 42), ("a.js", "z", 43, 43)]


SHAPES = {
    "named, no block": lambda n: "socket.on('a', onA);\n" * n,
    "open": lambda n: "socket.on('a', () => {\n" * n,
    "nested": lambda n: "socket.on('a', () => {\n" * n + "})\n" * n,
    "closed": lambda n: "socket.on('a', () => { x('{'); })\n" * n,
    "commented": lambda n: "// socket.on('a', () => {\n" * n,
    "open behind a comment": lambda n: "socket.on('a', () => {\n" + "// socket.on('a', () => { }\n" * n,
    "named, then one open": lambda n: "socket.on('a', onA);\n" * n + "x = () => {" + " y;" * n,
    "open quotes": lambda n: "socket.on('a', () => { \"`\n" * n,
    "open comments": lambda n: "socket.on('e', x => { /*" * n,
    "line comments on one line": lambda n: "socket.on('e', x => { // " * n,
    "escaped quotes": lambda n: 'socket.on(\'e\', x => { \\" \\` ' * n,
    "backslashes": lambda n: "socket.on('e', x => { \"\\\\" * n,
    "quotes to one end": lambda n: 'socket.on(\'e\', x => { \\" ' * n + '"' + "x" * 50 * n,
    "deep": lambda n: "socket.on('a', () => " + "{" * n + "}" * n + ")",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_work_is_linear_in_the_text(monkeypatch, shape):
    """A look-up in the index costs the logarithm of its size; there are few by token."""
    looks = []
    look_up = blocks.bisect_left

    def counted(places, place):
        looks[-1] += 1
        return look_up(places, place)

    monkeypatch.setattr(blocks, "bisect_left", counted)
    for n in (500, 1000, 2000, 4000):
        looks.append(0)
        text = SHAPES[shape](n)
        blocks.handler_blocks(cut(text))
        tokens = len(blocks.Delimiters(text).starts)
        assert looks[-1] < 6 * tokens + 100
    assert all(b <= 2.2 * a + 100 for a, b in zip(looks, looks[1:], strict=False))
    few = SHAPES[shape](30)
    assert blocks.handler_blocks(cut(few)) == plain_handlers(few)


@pytest.mark.parametrize("shape", SHAPES)
def test_long_texts_take_little_time(shape):
    pieces = cut(SHAPES[shape](8000))
    began = time.perf_counter()
    blocks.handler_blocks(pieces)
    assert time.perf_counter() - began < 1


@pytest.mark.parametrize("mark", ["'", '"', "`", "//", "/*"])
def test_what_closes_a_quote_or_a_comment(mark):
    """The index against reading on from the mark, one character at a time."""
    rng = random.Random(9)
    for _ in range(2000):
        text = mark + "".join(rng.choices(["\\", "\\", "'", '"', "`", "*", "/", "\n", "a"], k=rng.randint(0, 12)))
        at, escaped = len(mark), False
        end = {"//": "\n", "/*": "*/"}.get(mark, mark)
        while at < len(text):
            if escaped:
                escaped = False
            elif len(mark) == 1 and text[at] == "\\":
                escaped = True
            elif text.startswith(end, at):
                break
            at += 1
        assert blocks.Delimiters(text).behind(0) == min(at + len(end), len(text))


@pytest.mark.parametrize("window", [(0, 5), (7, 3), (20, 30), (200, 300)])
def test_windows_around_matches(spark, window):
    rng = random.Random(5)
    pieces = ["go(1)", "go(1)", "x", "\n", "é", "\U0001f600", " " * 25, "(", "\x01"]
    values = ["".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(300)]
    values += ["go(1)" * 200, "x" * 400 + "go(1)" + "y" * 400]
    pattern = Rx(r"go\(1\)")
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    found = table.select("i", matches_with_window(F.col("t"), pattern, window, 5).alias("m")).collect()
    before, after = window
    for r in found:
        text = values[r.i]
        wanted = [
            (m[0], text[max(0, m.start() - before) : m.start() + after])
            for m in re.finditer(r"go\(1\)", text)
        ]
        assert [tuple(x) for x in r.m] == wanted


def test_windows_read_a_bounded_piece_of_text(spark):
    """Doubling the matches doubles what the windows hold, not more."""
    sizes = []
    for n in (1000, 2000):
        text = "warp::path(\"x\").and(warp::get())\n" * n
        rows = spark.createDataFrame([(text,)], "t string").select(
            matches_with_window(F.col("t"), Rx(r'warp::path\("x"\)'), (200, 300), 15).alias("m")
        )
        found = rows.collect()[0].m
        sizes.append(sum(len(x.near) for x in found))
        assert len(found) == n and max(len(x.near) for x in found) == 500
    assert sizes[1] < 2.1 * sizes[0]
