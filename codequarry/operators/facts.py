"""Functions, imports, database and outgoing API calls of source files.

Every fact is read from the text of its own file, so each operator is one
projection over one scan. A fact starts as one string, ``line:...``, which makes
repeats cheap to drop, and is split into its fields afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.languages import flow_language
from codequarry.functions.patterns import Rx
from codequarry.functions.text import (
    kept,
    let,
    matches_with_line,
    mentions,
    no_strings,
    strings_if,
)
from codequarry.sources.corpus import CODE_KINDS, only_kinds, scan

# --- fixed values: patterns, verbs and words ---------------------------------
_JS_FUNCTIONS = (
    Rx(
        r"""(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(""",
        led=r"""[af](?:(?<=a)sync\s+function|(?<=f)unction)\s+([A-Za-z_$][\w$]*)\s*\(""",
    ),
    Rx(
        r"""(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>""",
        led=r"""[clv](?:(?<=c)onst|(?<=l)et|(?<=v)ar)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>""",
    ),
)
# Backwards from a bracket: at most a name, its type, `static` and a modifier.
_FOUR_WORDS = r"""\s*+(?:[\w<>,[\]]++\s*+){0,4}+"""
FUNCTIONS = {
    "javascript": _JS_FUNCTIONS,
    "typescript": _JS_FUNCTIONS,
    "python": (
        Rx(
            r"""(?:async\s+)?def\s+([A-Za-z_][\w]*)\s*\(""",
            led=r"""[ad](?:(?<=a)sync\s+def|(?<=d)ef)\s+([A-Za-z_][\w]*)\s*\(""",
        ),
    ),
    "java": (
        Rx(
            r"""(?:public|private|protected)?\s*(?:static\s+)?[\w<>,[\]]+\s+([A-Za-z_][\w]*)\s*\(""",
            faster=r"""(?:\s++|p(?:ublic|rivate|rotected)\s*+|(?=static)|(?<![\s\w<>,[\]]))(?:static\s+)?(?<![\w<>,[\]])[\w<>,[\]]++\s++([A-Za-z_]\w*+)\s*+\(""",
            end=r"""\(""",
            reach=_FOUR_WORDS,
        ),
    ),
    "csharp": (
        Rx(
            r"""(?:public|private|protected|internal)?\s*(?:static\s+)?[\w<>,[\]]+\s+([A-Za-z_][\w]*)\s*\(""",
            faster=r"""(?:\s++|(?:p(?:ublic|rivate|rotected)|internal)\s*+|(?=static)|(?<![\s\w<>,[\]]))(?:static\s+)?(?<![\w<>,[\]])[\w<>,[\]]++\s++([A-Za-z_]\w*+)\s*+\(""",
            end=r"""\(""",
            reach=_FOUR_WORDS,
        ),
    ),
    "go": (Rx(r"""func\s+(?:\([^)]+\)\s*)?([A-Za-z_][\w]*)\s*\("""),),
    "ruby": (Rx(r"""def\s+([A-Za-z_][\w!?=]*)"""),),
    "php": (Rx(r"""function\s+([A-Za-z_][\w]*)\s*\("""),),
    "rust": (
        Rx(
            r"""(?:pub\s+)?(?:async\s+)?fn\s+([A-Za-z_][\w]*)\s*\(""",
            led=r"""[paf](?:(?<=p)ub\s+(?:async\s+)?fn|(?<=a)sync\s+fn|(?<=f)n)\s+([A-Za-z_][\w]*)\s*\(""",
        ),
    ),
    "kotlin": (Rx(r"""fun\s+([A-Za-z_][\w]*)\s*\("""),),
    "swift": (Rx(r"""func\s+([A-Za-z_][\w]*)\s*\("""),),
    "dart": (
        Rx(
            r"""(?:Future<[^>]+>\s+)?([A-Za-z_][\w]*)\s*\([^)]*\)\s*(?:async)?\s*\{""",
            faster=r"""(?:Future<[^>]+>\s+)?(?<![A-Za-z_])([A-Za-z_]\w*+)\s*+\([^)]*+\)\s*+(?:async)?\s*+\{""",
        ),
    ),
    "scala": (Rx(r"""def\s+([A-Za-z_][\w]*)\s*\("""),),
    "elixir": (Rx(r"""def(?:p)?\s+([A-Za-z_][\w!?]*)\s*(?:\(|do)"""),),
}
# A word each function pattern of a language needs, one per pattern.
FUNCTION_WORDS = {
    "javascript": ("function", "=>"),
    "typescript": ("function", "=>"),
    "python": ("def",),
    "java": ("(",),
    "csharp": ("(",),
    "go": ("func",),
    "ruby": ("def",),
    "php": ("function",),
    "rust": ("fn",),
    "kotlin": ("fun",),
    "swift": ("func",),
    "dart": ("{",),
    "scala": ("def",),
    "elixir": ("def",),
}

IMPORT_FROM = Rx(r"""import\s+.*?\s+from\s+["'`](.*?)["'`]""")
IMPORT_BARE = Rx(r"""import\s+["'`](.*?)["'`]""")
IMPORT_REQUIRE = Rx(r"""require\s*\(\s*["'`](.*?)["'`]\s*\)""")
IMPORTS = (IMPORT_FROM, IMPORT_BARE, IMPORT_REQUIRE)

# The first kind with a word in the lower-cased source counts.
IMPORT_KINDS = (
    ("service", ("service",)),
    ("repository", ("repository", "repo")),
    ("model", ("model", "schema", "entity")),
    ("controller", ("controller",)),
    ("middleware", ("middleware",)),
    ("utility", ("util", "helper")),
)
OTHER_IMPORT_KIND = "module"
DEPENDENCY_FIELDS = {
    "services": "service",
    "repositories": "repository",
    "models": "model",
    "controllers": "controller",
    "middleware": "middleware",
    "utilities": "utility",
    "modules": "module",
}

ORM_CALL = Rx(
    r"""\b([A-Za-z_$][\w$]*)\.(find|findOne|findById|findByIdAndUpdate|findByIdAndDelete|create|insertMany|updateOne|updateMany|deleteOne|deleteMany)\s*\(""",
    faster=r"""((?:[A-Za-z_](?<!\w[A-Za-z_])|\$(?<=\w\$))[\w$]*+)\.(find|findOne|findById|findByIdAndUpdate|findByIdAndDelete|create|insertMany|updateOne|updateMany|deleteOne|deleteMany)\s*+\(""",
)
QUERY_CALL = Rx(
    r"""\b([A-Za-z_$][\w$]*)\.(query|execute)\s*\(""",
    faster=r"""((?:[A-Za-z_](?<!\w[A-Za-z_])|\$(?<=\w\$))[\w$]*+)\.(query|execute)\s*+\(""",
)
CONNECTION_CALL = Rx(
    r"""\b(?:db|database|connection)\.(query|execute|run|prepare)\s*\(""", ignore_case=True
)
# All that the three may match, with the whole name in front: its end is found by one pattern.
_CALL_END = r"""\.(?:find(?:One|ById(?:AndUpdate|AndDelete)?)?|create|insertMany|(?:update|delete)(?:One|Many)|query|execute|run|prepare)\s*+\("""
DB_CALL = Rx(r"""[\w$]*+""" + _CALL_END, ignore_case=True, end=_CALL_END, reach=r"""[\w$]*+""")

FETCH_CALL = Rx(r"""\bfetch\s*\(\s*["'`]([^"'`]+)""", ignore_case=True)
AXIOS_CALL = Rx(
    r"""\baxios\.(get|post|put|patch|delete|request)\s*\(\s*["'`]([^"'`]+)""", ignore_case=True
)
REQUESTS_CALL = Rx(
    r"""\brequests\.(get|post|put|patch|delete|request)\s*\(\s*["'`]([^"'`]+)""",
    ignore_case=True,
)
HTTP_CALL = Rx(
    r"""\b(?:http|https)\.(get|post|put|patch|delete|request)\s*\(\s*["'`]([^"'`]+)""",
    ignore_case=True,
)
CLIENT_CALLS = (("axios", AXIOS_CALL), ("requests", REQUESTS_CALL), ("http", HTTP_CALL))
CLIENT_WORDS = {"axios": ("axios.",), "requests": ("requests.",), "http": ("http.", "https.")}
# -----------------------------------------------------------------------------


def flow_files(files: DataFrame, path: str = ".", also: tuple[str, ...] = ()) -> DataFrame:
    """(project, file, language, content, *also, lower) of the files that have facts."""
    return (
        only_kinds(scan(files, path), *CODE_KINDS)
        .select(
            "project",
            F.col("path").alias("file"),
            flow_language(F.col("path")).alias("language"),
            "content",
            *also,
        )
        .where(F.col("language").isNotNull())
        .withColumn("lower", F.lower("content"))
    )


def _records(strings: Column, *fields: str) -> Column:
    """Distinct ``line:field:field`` strings as structs; the last field may hold colons."""

    def record(s: Column) -> Column:
        parts = F.split(s, ":", len(fields) + 1)
        return let(
            parts,
            lambda p: F.struct(
                *[p[i + 1].alias(f) for i, f in enumerate(fields)],
                p[0].cast("int").alias("line"),
            ),
        )

    return F.transform(F.array_distinct(strings), record)


def functions_in(text: Column, language: Column) -> Column:
    """Distinct (name, line) by the patterns of the language."""
    lines = F
    for name, patterns in FUNCTIONS.items():
        found = [
            strings_if(
                mentions(text, word), matches_with_line(text, p, lambda m, p=p: p.part(m, 1))
            )
            for p, word in zip(patterns, FUNCTION_WORDS[name], strict=True)
        ]
        lines = lines.when(language == name, F.concat(*found) if len(found) > 1 else found[0])
    return _records(lines.otherwise(no_strings()), "name")


def import_kind(source: Column) -> Column:
    lowered = F.lower(source)
    kind = F
    for name, words in IMPORT_KINDS:
        kind = kind.when(mentions(lowered, *words), name)
    return kind.otherwise(OTHER_IMPORT_KIND)


def imports_in(text: Column) -> Column:
    """Distinct (source, kind, line) of ECMAScript-style imports, in any language."""

    def found(word: str, *patterns: Rx) -> Column:
        lines = [matches_with_line(text, p, lambda m, p=p: p.part(m, 1)) for p in patterns]
        return strings_if(mentions(text, word), F.concat(*lines))

    lines = F.concat(
        found("import", IMPORT_FROM, IMPORT_BARE), found("require", IMPORT_REQUIRE)
    )
    return F.transform(
        _records(lines, "source"),
        lambda r: F.struct(
            r["source"].alias("source"), import_kind(r["source"]).alias("kind"), r["line"].alias("line")
        ),
    )


def _joined(*parts: Column | str) -> Column:
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def db_call_lines(text: Column) -> Column:
    """``line:call`` for all that may be a database call, in text order."""
    return matches_with_line(text, DB_CALL, lambda m: m)


def db_operations_in(text: Column, calls: Column | None = None) -> Column:
    """Distinct (kind, target, operation, line); ``db.query(`` counts as two. The calls are
    looked for in the text unless they are given."""

    def named(calls: Column, pattern: Rx, kind: str) -> Column:
        return F.transform(
            F.filter(calls, pattern.found_in),
            lambda c: _joined(
                F.substring_index(c, ":", 1), kind, pattern.part(c, 1), pattern.part(c, 2)
            ),
        )

    def lines(calls: Column) -> Column:
        connected = F.transform(
            F.filter(calls, CONNECTION_CALL.found_in),
            lambda c: _joined(
                F.substring_index(c, ":", 1), "database", "database", CONNECTION_CALL.part(c, 1)
            ),
        )
        found = F.concat(
            named(calls, ORM_CALL, "orm"), named(calls, QUERY_CALL, "database"), connected
        )
        return strings_if(F.size(calls) > 0, found)

    found = let(db_call_lines(text), lines) if calls is None else lines(calls)
    return _records(found, "kind", "target", "operation")


def external_apis_in(text: Column, lower: Column) -> Column:
    """Distinct (client, method, target, line), the method as written."""
    fetched = strings_if(
        mentions(lower, "fetch"),
        matches_with_line(
            text, FETCH_CALL, lambda m: _joined("fetch", "fetch", FETCH_CALL.part(m, 1))
        ),
    )
    called = [
        strings_if(
            mentions(lower, *CLIENT_WORDS[client]),
            matches_with_line(
                text, p, lambda m, c=client, p=p: _joined(c, p.part(m, 1), p.part(m, 2))
            ),
        )
        for client, p in CLIENT_CALLS
    ]
    return _records(F.concat(fetched, *called), "client", "method", "target")


def dependencies_of(imports: Column) -> Column:
    """Imports by kind, each an array of (source, line)."""

    def of_kind(kind: str) -> Column:
        return F.transform(
            F.filter(imports, lambda i: i["kind"] == kind),
            lambda i: F.struct(i["source"].alias("source"), i["line"].alias("line")),
        )

    return F.struct(*[of_kind(kind).alias(field) for field, kind in DEPENDENCY_FIELDS.items()])


def functions(files: DataFrame, path: str = ".") -> DataFrame:
    found = functions_in(F.col("content"), F.col("language"))
    return flow_files(files, path).select("project", "file", "language", F.inline(found))


def imports(files: DataFrame, path: str = ".") -> DataFrame:
    return flow_files(files, path).select("project", "file", F.inline(imports_in(F.col("content"))))


def db_operations(files: DataFrame, path: str = ".") -> DataFrame:
    found = db_operations_in(F.col("content"))
    return flow_files(files, path).select("project", "file", F.inline(found))


def external_apis(files: DataFrame, path: str = ".") -> DataFrame:
    found = external_apis_in(F.col("content"), F.col("lower"))
    return flow_files(files, path).select("project", "file", F.inline(found))


def dependencies(files: DataFrame, path: str = ".") -> DataFrame:
    """One row per file with its imports by kind."""
    found = let(imports_in(F.col("content")), dependencies_of)
    return flow_files(files, path).select("project", "file", found.alias("d")).select(
        "project", "file", "d.*"
    )


def file_facts(
    text: Column, lower: Column, language: Column, calls: Column | None = None
) -> Column:
    """All facts of a file in one struct."""
    return F.struct(
        functions_in(text, language).alias("functions"),
        let(imports_in(text), dependencies_of).alias("dependencies"),
        db_operations_in(text, calls).alias("databaseOperations"),
        external_apis_in(text, lower).alias("externalApis"),
    )


@kept
def facts_of_file(calls: str | None = None) -> Column:
    """``file_facts`` of the columns ``content``, ``lower`` and ``language``, and of the column
    named that holds the file's database calls by line, if there is one."""
    known = None if calls is None else F.col(calls)
    return file_facts(F.col("content"), F.col("lower"), F.col("language"), known)


def analyze_files(files: DataFrame, path: str = ".") -> DataFrame:
    """One row per file with all its facts, from a single scan."""
    facts = facts_of_file()
    return flow_files(files, path).select("project", "file", "language", facts.alias("f")).select(
        "project", "file", "language", "f.*"
    )
