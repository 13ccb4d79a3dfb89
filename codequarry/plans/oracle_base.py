"""Shared pieces of the checking SQL: the sample files and pattern matches."""

from __future__ import annotations

from collections.abc import Iterable

from codequarry.functions.languages import LANGUAGES, WITHOUT_INTERFACES
from codequarry.functions.patterns import Rx
from codequarry.sources.corpus import IGNORED_DIRECTORIES
from codequarry.sources.sample import EVERY
from codequarry.sources.sample_templates import TEMPLATES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: Rx) -> str:
    """The pattern as an SQL literal for RE2."""
    return quoted(("(?i)" if pattern.ignore_case else "") + pattern.source)


def found(*patterns: Rx) -> str:
    return " OR ".join(f"regexp_matches(content, {rx(p)})" for p in patterns).join("()")


def literal(text: str) -> str:
    return f"contains(content, {quoted(text)})"


def one_of(texts: Iterable[str]) -> str:
    return " OR ".join(literal(t) for t in texts).join("()")


def groups(pattern: Rx, group: int, text: str = "content") -> str:
    return f"regexp_extract_all({text}, {rx(pattern)}, {group})"


def newlines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')))"


def matches(pattern: Rx, source: str) -> str:
    """Every match with its offset and line, from the gaps between the matches.

    Adds (i, full, start, line) to the rows of the source; offsets start at 0.
    """
    gap = f"string_split_regex(content, {rx(pattern)})"
    earlier = "OVER (PARTITION BY project, file ORDER BY i ROWS"
    return f"""SELECT * EXCLUDE (gap),
  CAST(sum(length(gap)) {earlier} UNBOUNDED PRECEDING)
    + coalesce(sum(length("full")) {earlier} BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS BIGINT) AS start,
  CAST(1 + sum({newlines("gap")}) {earlier} UNBOUNDED PRECEDING)
    + coalesce(sum({newlines('"full"')}) {earlier} BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS INTEGER) AS line
  FROM (SELECT *, unnest({groups(pattern, 0)}) AS "full",
      unnest({gap}[1:len({groups(pattern, 0)})]) AS gap,
      generate_subscripts({groups(pattern, 0)}, 1) AS i FROM ({source}))"""


_VALUES = ",\n".join(
    f"({i}, {', '.join(quoted(x) for x in t)})" for i, t in enumerate(TEMPLATES)
)
_IGNORED = "|".join(d.replace(".", r"\.") for d in IGNORED_DIRECTORIES)


def _languages(column: int, skip: tuple[str, ...] = ()) -> str:
    extension = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '.(\.[^.]*)$', 1))"
    cases = " ".join(
        f"WHEN {quoted(ext)} THEN {quoted(names[column])}"
        for ext, names in LANGUAGES.items()
        if ext not in skip
    )
    return f"CASE {extension} {cases} END"


EXTENSION = r"regexp_extract(regexp_extract(path, '[^/]*$'), '.(\.[^.]*)$', 1)"

# corpus: all sample files; files: those scanned.
CORPUS = f"""WITH templates(template, path, evidence, body) AS (VALUES
{_VALUES}),
numbered AS (SELECT CAST(o_orderkey AS VARCHAR) AS k,
    CASE WHEN o_orderkey % 3 = 0 THEN 'mono'
      ELSE 'p' || CAST(o_custkey % 20 AS VARCHAR) END AS project,
    o_orderkey % {len(TEMPLATES)} AS template,
    (o_orderkey // {len(TEMPLATES)}) % {EVERY} = 0 AS bare,
    o_orderkey % (SELECT count(*) FROM documents) AS doc_id
  FROM orders),
corpus AS MATERIALIZED (SELECT project, replace(t.path, '<<k>>', k) AS path,
    replace(replace(CASE WHEN bare THEN '' ELSE evidence END || body, '<<k>>', k), '<<noise>>',
      coalesce(d.text, '')) AS content
  FROM numbered AS n JOIN templates AS t ON n.template = t.template
  LEFT JOIN documents AS d ON d.doc_id = n.doc_id),
files AS (SELECT * FROM corpus
  WHERE NOT regexp_matches(path, '(^|/)({_IGNORED})/'))"""

# code: scanned files the interface rules apply to; flow: those that have facts.
CODE = f"""{CORPUS},
code AS (SELECT project, path AS file, content, {_languages(0, WITHOUT_INTERFACES)} AS language
  FROM files),
flow AS (SELECT project, path AS file, content, {_languages(0)} AS language
  FROM files WHERE {_languages(0)} IS NOT NULL)"""

DISPLAY_LANGUAGE = _languages(1)
