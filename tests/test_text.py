"""Text expressions against plain Python on random input."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from codequarry.functions.patterns import Rx
from codequarry.functions.text import (
    all_matches,
    extension,
    join_paths,
    matches_with_line,
    mentions,
)
from codequarry.operators import facts, flows, mapping
from codequarry.rules import (
    csharp,
    dart,
    elixir,
    go,
    java,
    javascript,
    kotlin,
    php,
    python,
    ruby,
    rust,
    scala,
    swift,
)

MODULES = (
    csharp, dart, elixir, go, java, javascript, kotlin, php, python, ruby, rust, scala, swift,
    facts, flows, mapping,
)


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def closing_brace(text: str) -> str:
    """Character by character: the block that opens the text, or ''."""
    depth, quote, i = 0, None, 0
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if quote == "//":
            quote = None if c == "\n" else quote
        elif quote == "/*":
            if two == "*/":
                quote = None
                i += 1
        elif quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = None
        elif two in ("//", "/*"):
            quote = two
            i += 1
        elif c in "'\"`":
            quote = c
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return text[: i + 1]
        i += 1
    return ""


@pytest.mark.parametrize("mark", ["", "\x01"])
def test_lines_of_matches(spark, mark):
    rng = random.Random(3)
    pieces = ["go (", "go\n(", "go(", "\n", "xgo(", "é", " ", "(", mark]
    values = ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(300)]
    pattern = Rx(r"\bgo\s*\(")
    rows = (
        texts(spark, values)
        .select(
            "i",
            matches_with_line(F.col("t"), pattern, lambda m: m).alias("lines"),
        )
        .collect()
    )
    for r in rows:
        found = list(re.finditer(r"\bgo\s*\(", values[r.i], re.ASCII))
        lines = [f"{values[r.i].count(chr(10), 0, m.start()) + 1}:{m[0]}" for m in found]
        assert r.lines == lines


def test_all_patterns_compile(spark):
    patterns = [v for m in MODULES for v in vars(m).values() if isinstance(v, Rx)]
    patterns += [p for ps in facts.FUNCTIONS.values() for p in ps]
    patterns += [p for _, p in mapping.NAMED_FUNCTIONS]
    found = [p.found_in(F.col("t")).alias(f"c{i}") for i, p in enumerate(patterns)]
    assert len(texts(spark, ["x"]).select(*found).collect()[0]) > 130


def test_boundaries_are_ascii(spark):
    cases = {"éget(": True, "xget(": False, "9get(": False, "$get(": True, "get(": True}
    rows = texts(spark, cases).select("t", Rx(r"\bget\(").found_in(F.col("t")).alias("f"))
    assert {r.t: r.f for r in rows.collect()} == cases
    ends = {"import xé": True, "import xy": False, "import x": True}
    rows = texts(spark, ends).select("t", Rx(r"import x\b").found_in(F.col("t")).alias("f"))
    assert {r.t: r.f for r in rows.collect()} == ends


def test_faster_patterns_find_the_same(spark):
    rng = random.Random(11)
    words = [
        "public", "private", "static", "internal", "void", "foo", "x9", "9x", "$a", "a$", "(", ")",
        " ", " ", "\n", ".", "find", "create", "query", "execute", "<T>", "[]", ",", "{", "async",
        "Future<int>", "é", ";", ".find(", ".query (", "$", "9$b", "_",
    ]
    values = ["".join(rng.choices(words, k=rng.randint(3, 30))) for _ in range(4000)]
    fast = [p for ps in facts.FUNCTIONS.values() for p in ps if p.faster]
    fast += [facts.ORM_CALL, facts.QUERY_CALL]
    assert len(fast) == 5
    plain = [Rx(p.source, p.ignore_case) for p in fast]
    columns = [
        F.struct(
            matches_with_line(F.col("t"), p, lambda m: m).alias("a"), p.all(F.col("t"), 1).alias("b")
        )
        for p in (*fast, *plain)
    ]
    found = 0
    for r in texts(spark, values).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect():
        for i in range(len(fast)):
            assert r[i] == r[i + len(fast)]
            found += len(r[i].b)
    assert found > 1500


def test_extensions(spark):
    cases = {
        ".gitignore": "", "a.": ".", "x.tar.gz": ".gz", "d.e/A.JS": ".JS", "d.e/f": "", "..x": ".x",
    }
    rows = texts(spark, cases).select("t", extension(F.col("t")).alias("e")).collect()
    assert {r.t: r.e for r in rows} == cases


def test_joined_paths(spark):
    cases = [("", ""), ("a", ""), ("", "b/"), ("/a/", "//b"), ("/", "/"), ("a", "b")]
    df = spark.createDataFrame(cases, "p string, q string")
    rows = df.select(
        join_paths(F.col("p"), F.col("q"), strip_end=True).alias("stripped"),
        join_paths(F.col("p"), F.col("q"), strip_end=False).alias("kept"),
    ).collect()
    assert [r.stripped for r in rows] == ["/", "/a", "/b", "/a/b", "/", "/a/b"]
    assert [r.kept for r in rows] == ["/", "/a/", "/b/", "/a/b", "/", "/a/b"]


def test_matches_are_looked_for_in_front_of_their_ends_alone(spark):
    """Calls and methods come from the few words in front of a bracket, as from the whole text."""
    texts = [
        "a.find(\n$b$.findOne (x.b.update(y).deleteMany(1a.create(DB.Query\n(",
        "f(public  static\nList<int[]> g (a b(\n\nprivate x\n y\t(static z  w(",
        "new X(publicint a(b c d e f( g h(", ").find(.query($.query(_.execute(é.find(x",
        "word " * 5000, "",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    t = F.col("t")
    patterns = [facts.DB_CALL, *facts.FUNCTIONS["java"], *facts.FUNCTIONS["csharp"]]
    for p in patterns:
        assert p.end is not None
        plain = Rx(p.source, p.ignore_case)
        shown = rows.select(
            all_matches(t, p), plain.all(t),
            matches_with_line(t, p, lambda m: m), matches_with_line(t, plain, lambda m: m),
        )
        for found, wanted, placed, wanted_places in shown.collect():
            assert (found, placed) == (wanted, wanted_places)


def test_patterns_led_by_first_characters_find_the_same(spark):
    rng = random.Random(12)
    words = [
        "async ", "function", "function a(", "def a(", "fn a(", "let a =", "a =>", "fn", "pub ", "def", "const", "let", "var", "xlet", "cet", " ", " ",
        "\n", "f", "g$", "(", ")", "=", "=>", "a", "x =", "async def", "pub async fn", "éfn", "_",
        "@Controller(", "@Controller", "@Get", "class A", "@",
    ]
    values = ["".join(rng.choices(words, k=rng.randint(3, 24))) for _ in range(4000)]
    values += ["@Controller('a') class A " + "@Get @Controllers " * 9000]  # no deep stack
    led = [p for ps in facts.FUNCTIONS.values() for p in ps if p.led]
    led += [p for _, p in mapping.NAMED_FUNCTIONS]
    assert len(led) == 9 and all(p.led for p in led)
    led.append(javascript.NEST_BLOCK)
    columns = [F.struct(p.all(F.col("t")), Rx(p.source).all(F.col("t"))) for p in led]
    found = 0
    for r in texts(spark, values).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect():
        for quick, plain in r:
            assert quick == plain
            found += len(quick)
    assert found > 500


def test_lines_of_few_and_of_many_matches(spark):
    """Both ways to number lines, with matches behind long gaps and over several lines."""
    gaps = ["", "\n", "x " * 300, "a\n\nb ", "é" * 250 + "\n"]
    rng = random.Random(23)
    calls = ["db.query(", "User.find(", "a$b\n.find(", "query (", ".run("]
    values = [
        "".join(rng.choice(gaps) + rng.choice(calls) for _ in range(n)) for n in [*range(30)] * 4
    ]
    plain = Rx(facts.DB_CALL.source, ignore_case=True)
    t = F.col("t")
    rows = texts(spark, values).select(
        "t",
        *[matches_with_line(t, p, lambda m: m).alias(n) for n, p in (("a", facts.DB_CALL), ("b", plain))],
    )
    for r in rows.collect():
        found = re.finditer(r"[\w$]*\.(?:find|query|run)\s*\(", r.t, re.ASCII)
        lines = [f"{r.t.count(chr(10), 0, m.start()) + 1}:{m[0]}" for m in found]
        assert r.a == lines and r.b == lines


def test_names_longer_than_what_is_looked_at_first(spark):
    name = "n" * 1000
    [r] = texts(spark, [f"x\n{name}.find("]).select(all_matches(F.col("t"), facts.DB_CALL).alias("m")).collect()
    assert r.m == [f"{name}.find("]


def test_words_are_mentioned_or_not(spark):
    words = ["express", "xpress", "=>", "e", "http.", "socket.io-client", "aa"]
    values = ["express", "xpress expres", "=", "socket.io-clien socket.io-client", "", None, "aéhttps.http."]
    rows = texts(spark, values).select("t", *[mentions(F.col("t"), w) for w in words]).collect()
    for r in rows:
        assert list(r[1:]) == [None if r.t is None else w in r.t for w in words]


def test_rewritten_rule_patterns_find_the_same(spark):
    words = [
        "@", "GetMapping", "RequestMapping", " ", "\n", "(", ")", "é", "x", "_", "9", "=", "FastAPI",
        "APIRouter", "from", "import", "fastapi", ".Map", "Get", "MapGet", "'a'", "[Http", "[ApiController]",
        "ControllerBase", "Microsoft.AspNetCore", ".SignalR", ":", "Hub", "Clients.", "All", "SendAsync",
        "= FastAPI(", "r=APIRouter(", "x.MapPost(", "WebApplication.CreateBuilder",
    ]
    rng = random.Random(29)
    df = texts(spark, ["".join(rng.choices(words, k=rng.randint(2, 25))) for _ in range(6000)])
    t = F.col("t")
    for p in (
        java.SPRING_MAPPING, python.FASTAPI_EVIDENCE, python.FASTAPI_APP, python.FASTAPI_ROUTER,
        csharp.ASPNET_EVIDENCE, csharp.ASPNET_MAP, csharp.SIGNALR_EVIDENCE,
    ):
        plain = Rx(p.source, p.ignore_case)
        assert df.where(all_matches(t, p) != plain.all(t)).count() == 0, p.source
    other = df.where(~t.contains(".Map"))
    plain = Rx(csharp.ASPNET_EVIDENCE.source)
    assert other.where(csharp.ASPNET_OTHER_EVIDENCE.found_in(t) != plain.found_in(t)).count() == 0
