"""Regular expressions written in ECMAScript syntax, run by Spark's Java engine.

The rule tables state their patterns in ECMAScript syntax. Java reads some of
that syntax differently, and some of it differently from one JDK to the next
(``\\b`` is Unicode-aware before JDK 19), so every pattern is rewritten once, on
the driver, into a form with the same meaning on any JDK.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

# ECMAScript white space: ASCII, no-break space, BOM and the Unicode separators, the
# latter behind a range test so that most characters are told apart at once. The first are
# listed one by one, as they are looked up in a table then.
_SPACE = (
    r"\t\n\x0B\f\r \x{a0}\x{feff}[\x{1680}-\x{3000}"
    r"&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)
_ANY_BUT_NEWLINE = r"[^\n\r\x{2028}\x{2029}]"
# ASCII word boundary; the short form serves where a word character must follow.
_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_BOUNDARY_BEFORE_WORD = r"(?<!\w)"

# What may follow a boundary: words only, or something else that starts with one.
_WORDS = r"(?:\((?:\?:)?(?P<words>\w+(?:\|\w+)*)\)|(?P<word>[A-Za-z])|(?P<name>\((?:\?:)?[A-Za-z]|\(?\[A-Za-z_\]))"
_TOKEN = re.compile(
    r"(?P<all>\[\\s\\S\])"
    r"|(?P<set>\[\^?(?:\\.|[^\]\\])*\])"
    rf"|(?P<edge>\\b)(?={_WORDS})?"
    r"|(?P<space>\\s)"
    r"|(?P<escape>\\.)"
    r"|(?P<dot>\.)"
    r"|(?P<end>\$)"
)


def _rewrite(m: re.Match) -> str:
    if m["set"]:
        body = re.sub(r"(?<!\\)\[", r"\\[", m["set"][1:-1])
        return "[" + body.replace(r"\s", _SPACE) + "]"
    if m["words"] or m["word"]:
        # Looking at the next character first spares most looks back.
        first = "".join(sorted({word[0] for word in (m["words"] or m["word"]).split("|")}))
        return f"(?=[{first}]){_BOUNDARY_BEFORE_WORD}"
    if m["edge"]:
        return _BOUNDARY_BEFORE_WORD if m["name"] else _BOUNDARY
    if m["space"]:
        return f"[{_SPACE}]"
    if m["dot"]:
        return _ANY_BUT_NEWLINE
    if m["end"]:
        return r"\z"
    return m[0]


class Rx:
    """One pattern and the column expressions that apply it."""

    def __init__(
        self,
        source: str,
        ignore_case: bool = False,
        faster: str | None = None,
        led: str | None = None,
        end: str | None = None,
        reach: str | None = None,
    ):
        """``faster`` finds the same matches with less backtracking, for the
        patterns that can start almost anywhere: possessive quantifiers where
        what follows cannot match inside the repeat, and no new start within a
        word whose beginning has failed. ``led`` finds the same as well, led by
        the characters that its words begin with, which pass over others fastest.

        ``end`` is what each match ends with and holds nowhere else. Matches are then looked
        for in front of it alone, as far back as ``reach`` goes, which reads the text backwards
        and stops no later than in front of what ``source`` can tell apart from a start."""
        self.source = source
        self.ignore_case = ignore_case
        self.faster = faster
        self.led = led
        self.end = Rx(end, ignore_case) if end else None
        self.reach = Rx(r"\A(?:" + reach + ")") if reach else None

    @cached_property
    def java(self) -> str:
        flags = "(?i)" if self.ignore_case else ""
        return flags + _TOKEN.sub(_rewrite, self.led or self.faster or self.source)

    def found_in(self, text: Column) -> Column:
        """Does the pattern occur anywhere in the text?"""
        return text.rlike(self.java)

    def all(self, text: Column, group: int = 0) -> Column:
        """One group of every match, in text order; '' where the group is unset."""
        return F.regexp_extract_all(text, F.lit(self.java), F.lit(group))

    def part(self, text: Column, group: int) -> Column:
        """One group of the first match, '' without a match."""
        return F.regexp_extract(text, self.java, group)
