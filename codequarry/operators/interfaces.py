"""Interfaces that applications offer or use, found in their source files.

All rules run in one projection over one scan: a file goes to the rules of its
language only, and its rows come out of an array. The table is neither joined
nor shuffled, so skewed projects and unevenly spread languages cost nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.languages import interface_language
from codequarry.functions.text import kept, let
from codequarry.rules import DETECTORS
from codequarry.rules.base import FIELDS, Detector, Source, no_rows
from codequarry.rules.javascript import EXPRESS_ROUTE
from codequarry.sources.corpus import CODE_KINDS, only_evident, only_kinds, scan

# Languages whose rules have case-insensitive evidence.
_LOWERED = ("javascript", "typescript", "php")


def detectors_named(*names: str) -> tuple[Detector, ...]:
    unknown = set(names) - {d.name for d in DETECTORS}
    if unknown:
        raise ValueError(f"unknown detectors: {sorted(unknown)}")
    return tuple(d for d in DETECTORS if d.name in names)


def _by_language(detectors: Iterable[Detector]) -> dict[tuple[Detector, ...], list[str]]:
    """Languages grouped by the rules that apply to them."""
    rules: dict[str, list[Detector]] = defaultdict(list)
    for detector in detectors:
        for language in detector.languages:
            rules[language].append(detector)
    groups: dict[tuple[Detector, ...], list[str]] = defaultdict(list)
    for language, applicable in rules.items():
        groups[tuple(applicable)].append(language)
    return groups


@kept
def _rows_of(detector: Detector, one_direction: bool) -> Column:
    source = Source(F.col("file"), F.col("content"), F.col("lower"), one_direction)
    return detector.rows(source)


def _file_interfaces(
    language: Column, one_direction: bool, detectors: Iterable[Detector]
) -> Column:
    """All interfaces of a file as one array, in rule order then text order."""
    rows = F
    for applicable, languages in _by_language(detectors).items():
        found = [_rows_of(d, one_direction or not d.directed) for d in applicable]
        rows = rows.when(
            language.isin(*languages), F.concat(*found) if len(found) > 1 else found[0]
        )
    return no_rows() if rows is F else rows.otherwise(no_rows())


@kept
def found_interfaces(
    language: str, one_direction: bool, detectors: tuple[Detector, ...] = DETECTORS
) -> Column:
    """All interfaces of a file, from its columns ``file``, ``content``, ``lower`` and the
    language that the named column holds."""
    return let(F.col(language), lambda x: _file_interfaces(x, one_direction, detectors))


def code_files(
    files: DataFrame,
    path: str = ".",
    detectors: Iterable[Detector] = DETECTORS,
    with_evidence: bool = False,
) -> DataFrame:
    """(project, file, language, content, lower) of the files the rules apply to, or of those
    in which they may find something."""
    languages = sorted({x for d in detectors for x in d.languages})
    code = only_kinds(scan(files, path), *[k for k in CODE_KINDS if k in languages])
    if with_evidence:
        code = only_evident(code, detectors)
    return (
        code.select(
            "project",
            F.col("path").alias("file"),
            interface_language(F.col("path")).alias("language"),
            "content",
        )
        .where(F.col("language").isin(*languages))
        .withColumn("lower", F.when(F.col("language").isin(*_LOWERED), F.lower("content")))
    )


def _interfaces(
    files: DataFrame, path: str, detectors: Iterable[Detector], one_direction: bool
) -> DataFrame:
    found = found_interfaces("language", one_direction, tuple(detectors))
    return (
        code_files(files, path, detectors, with_evidence=True)
        .select("project", "file", "language", F.posexplode(found).alias("ord", "row"))
        .select("project", "file", "language", *[f"row.{f}" for f in FIELDS], "ord")
    )


def discover_interfaces(
    files: DataFrame, path: str = ".", detectors: Iterable[Detector] = DETECTORS
) -> DataFrame:
    """Distinct interfaces per file; a socket event appears once per role.

    ``ord`` is the place of the row among those of its file.
    """
    return _interfaces(files, path, detectors, one_direction=True)


def interfaces_full(files: DataFrame, path: str = ".") -> DataFrame:
    """As above, but a socket event appears once per role and direction."""
    return _interfaces(files, path, DETECTORS, one_direction=False)


def interface_count(files: DataFrame, path: str = ".") -> DataFrame:
    """Number of discovered interfaces per project; sums per file before grouping."""
    found = found_interfaces("language", True)
    return (
        code_files(files, path)
        .select("project", F.size(found).cast("bigint").alias("n"))
        .groupBy("project")
        .agg(F.sum("n").alias("count"))
    )


def detect_routes(files: DataFrame, path: str = ".") -> DataFrame:
    """Express-like calls in ``.js``, ``.mjs`` and ``.cjs`` files, repeats kept."""
    name = F.col("path")
    script = name.endswith(".js") | name.endswith(".mjs") | name.endswith(".cjs")
    found = F.transform(
        EXPRESS_ROUTE.all(F.col("content")),
        lambda m: F.struct(
            F.upper(EXPRESS_ROUTE.part(m, 2)).alias("method"),
            EXPRESS_ROUTE.part(m, 3).alias("route"),
        ),
    )
    return (
        only_kinds(scan(files, path), "javascript")
        .where(script)
        .select("project", name.alias("file"), F.posexplode(found).alias("ord", "call"))
        .select("project", "file", "call.method", "call.route", "ord")
    )
