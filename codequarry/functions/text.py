"""Column expressions on text that the operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.patterns import Rx

_MARK = "\x01"  # a control character, all but absent from source text
# Up to so many matches the line ends in front of each are added up one match at a time.
_FEW_MATCHES = 12
# Characters in front of the end of a match that are looked at before all of them are.
_NEAR = 200


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Inside lambdas Spark shares no subexpressions, and a column that is
    referenced once is inlined into the lambda that uses it, so a costly value
    would otherwise be recomputed for every element.
    """
    return F.transform(F.array(value), body)[0]


def numbered_keys(keys: Column) -> Column:
    """(key, i) of an array of strings in order, to look keys up with ``first_place``."""
    return F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("i"))))


def first_place(places: Column, key: Column) -> Column:
    """The least i of a key among ordered (key, i), null without; by halving the array.

    Built-in look-ups in arrays and maps read them from the start each time.
    """

    def halved(places: Column) -> Column:
        def closer(s: Column, _: Column) -> Column:
            middle = F.shiftright(s["low"] + s["high"], 1)
            below = F.get(places, middle)["key"] < key
            return (
                F.when(s["low"] >= s["high"], s)
                .when(below, F.struct((middle + 1).alias("low"), s["high"].alias("high")))
                .otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))
            )

        size = F.size(places)
        start = F.struct(F.lit(0).alias("low"), size.alias("high"))
        steps = F.sequence(F.lit(1), F.length(F.bin(size)))
        at = F.get(places, F.aggregate(steps, start, closer, lambda s: s["low"]))
        return let(at, lambda p: F.when(p["key"] == key, p["i"]))

    return let(places, halved)


def kept(build: Callable[..., Column]) -> Callable[..., Column]:
    """Build a column over named columns once and use it again.

    A large column is ten thousand calls into the JVM, which take seconds. It names the
    columns it reads, so it fits every table that has them.
    """
    built: dict[tuple, Column] = {}

    @wraps(build)
    def found(*args) -> Column:
        key = (id(SparkContext._gateway), *args)
        if key not in built:
            built[key] = build(*args)
        return built[key]

    return found


# Characters by how often they stand in text, the most frequent first; all others are rare.
_FREQUENT = " etaoinsrhldcumfgpywb,.v"
# The least length of an end of a word that is looked for in its place.
_SHORTEST_END = 3


def _rareness(character: str) -> int:
    place = _FREQUENT.find(character)
    return len(_FREQUENT) if place < 0 else place


def _mentioned(text: Column, word: str) -> Column:
    """Spark compares the whole word wherever its first character stands. So the end of the word
    that begins with its rarest character is looked for first, the word itself only behind it."""
    starts = range(max(len(word) - _SHORTEST_END, 0) + 1)
    start = max(starts, key=lambda k: (_rareness(word[k]), -k))
    held = text.contains(word)
    return text.contains(word[start:]) & held if start else held


def mentions(text: Column, *words: str) -> Column:
    """Plain substring test, used to spare the regular expression behind it."""
    return reduce(lambda a, b: a | b, [_mentioned(text, w) for w in words])


def no_strings() -> Column:
    return F.array().cast("array<string>")


def strings_if(condition: Column, values: Column) -> Column:
    return F.when(condition, values).otherwise(no_strings())


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def newlines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def join_paths(prefix: Column, path: Column, strip_end: bool) -> Column:
    """Join two URL paths under one leading slash, runs of slashes collapsed.

    With ``strip_end`` an empty part adds no slash and one at the end is
    dropped; without it ``/a`` and an empty path give ``/a/``.
    """
    if strip_end:
        joined = F.concat(F.lit("/"), F.concat_ws("/", blank_to_null(prefix), blank_to_null(path)))
        return F.regexp_replace(F.regexp_replace(joined, "/+", "/"), r"(?<!\A)/\z", "")
    return F.regexp_replace(F.concat(F.lit("/"), prefix, F.lit("/"), path), "/+", "/")


def rooted(path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """``.gitignore`` has none, ``a.`` has ``.``, ``x.tar.gz`` has ``.gz``."""
    return F.regexp_extract(path, r"(?s)[^/](\.[^./]*)\z", 1)


def _gaps(text: Column, pattern: Rx, found: Column) -> Column:
    """The text in front of each match."""
    return F.slice(F.split(text, pattern.java, -1), F.lit(1), F.size(found))


def pieces_around(text: Column, pattern: Rx) -> Column:
    """The text cut at its matches: gap, match, gap, ..., match, gap.

    One pass sets marks around the matches; only a text that holds the mark
    itself is taken apart by gaps and matches.
    """
    by_gap = let(
        pattern.all(text),
        lambda found: F.concat(
            F.flatten(
                F.zip_with(_gaps(text, pattern, found), found, lambda gap, m: F.array(gap, m))
            ),
            F.slice(F.split(text, pattern.java, -1), -1, 1),
        ),
    )

    def cut(marked: Column) -> Column:
        # Marks make the text longer.
        return (
            F.when(F.octet_length(marked) == F.octet_length(text), F.array(text))
            .when(text.contains(_MARK), by_gap)
            .otherwise(F.split(marked, _MARK))
        )

    return let(F.regexp_replace(text, pattern.java, f"{_MARK}$0{_MARK}"), cut)


def _behind(pieces: Column, piece: Column, index: Column, pattern: Rx) -> Column:
    """The match that ends with a piece, '' without, by the text in front as far as it reaches."""

    def reached(gap: Column) -> Column:
        return F.reverse(F.regexp_extract(F.reverse(gap), pattern.reach.java, 0))

    def read(gap: Column) -> Column:
        # Most gaps need not be turned round as a whole.
        return let(
            reached(F.right(gap, F.lit(_NEAR))),
            lambda near: F.when(F.length(near) < _NEAR, near).otherwise(reached(gap)),
        )

    near = let(F.get(pieces, index - 1), read)
    return pattern.part(F.concat(near, piece), 0)


def all_matches(text: Column, pattern: Rx) -> Column:
    """Every match, in text order."""
    if pattern.end is None:
        return pattern.all(text)

    def found(pieces: Column) -> Column:
        matches = F.transform(
            pieces,
            lambda p, i: F.when(i % 2 == 0, "").otherwise(_behind(pieces, p, i, pattern)),
        )
        return strings_if(F.size(pieces) > 1, F.filter(matches, lambda m: m != ""))

    return let(pieces_around(text, pattern.end), found)


def matches_with_line(text: Column, pattern: Rx, show: Callable[[Column], Column]) -> Column:
    """``line:show(match)`` for every match, the line being where the match starts.

    Behind few matches the line ends in front of each are counted. Otherwise the text is written
    out again with nothing but its line ends and the matches in hex; split into lines, each match
    stands on its own line. All steps are linear in the text.
    """

    def line_ends(piece: Column) -> Column:
        return F.size(F.split(piece, "\n", -1)) - 1

    def counted(pieces: Column) -> Column:
        """The same for few matches: what is behind the last one is not looked at."""

        def shown(ends: Column, i: Column) -> Column:
            def at(match: Column, last: Column, own: Column) -> Column:
                line = F.aggregate(F.slice(ends, 1, last), F.lit(1) - own, lambda a, n: a + n)
                return F.concat(line.cast("string"), F.lit(":"), show(match))

            if pattern.end is None:
                return at(F.get(pieces, i), i, F.lit(0))
            return let(
                _behind(pieces, F.get(pieces, i), i, pattern),
                lambda m: F.when(m != "", at(m, i + 1, line_ends(m))),
            )

        found = let(
            F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), line_ends),
            lambda ends: F.transform(
                F.sequence(F.lit(1), F.size(ends) - 1, F.lit(2)), lambda i: shown(ends, i)
            ),
        )
        return found if pattern.end is None else F.filter(found, lambda s: s.isNotNull())

    def ends(piece: Column) -> Column:
        return F.regexp_replace(piece, r"[^\n]++", "")

    def kept(piece: Column, index: Column) -> Column:
        own = ends(piece)
        return F.when(index % 2 == 0, own).otherwise(F.concat(F.hex(piece), F.lit(" "), own))

    def kept_behind(pieces: Column, piece: Column, index: Column) -> Column:
        """The line ends of a gap and a piece, the match where it starts among them."""
        all_ends = ends(F.concat(F.get(pieces, index - 1), piece))

        def placed(match: Column) -> Column:
            own = ends(match)
            before = F.left(all_ends, F.octet_length(all_ends) - F.octet_length(own))
            return F.when(match == "", all_ends).otherwise(
                F.concat(before, F.hex(match), F.lit(" "), own)
            )

        return F.when(index % 2 == 0, "").otherwise(
            let(_behind(pieces, piece, index, pattern), placed)
        )

    def on_line(line: Column, index: Column) -> Column:
        number = F.concat((index + 1).cast("string"), F.lit(":"))
        return strings_if(
            line != "",
            F.transform(
                F.filter(F.split(line, " "), lambda h: h != ""),
                lambda h: F.concat(number, show(F.unhex(h).cast("string"))),
            ),
        )

    def numbered(pieces: Column) -> Column:
        if pattern.end is None:
            shown = F.transform(pieces, kept)
        else:
            shown = F.transform(pieces, lambda p, i: kept_behind(pieces, p, i))
        lines = F.split(F.array_join(shown, ""), "\n")
        return F.flatten(F.transform(lines, on_line))

    def found(pieces: Column) -> Column:
        # Pieces are null for a text that is.
        size = F.size(pieces)
        few = (size > 1) & (size <= 2 * _FEW_MATCHES + 1)
        return F.when(few, counted(pieces)).otherwise(strings_if(size > 1, numbered(pieces)))

    return let(pieces_around(text, pattern.end or pattern), found)


def matches_with_window(
    text: Column, pattern: Rx, window: tuple[int, int], shortest: int
) -> Column:
    """(match, near) for every match: the text so many characters before and from its start.

    ``shortest`` is the least length of a match. So many matches at most have room in
    a window, and each piece of text around them is cut to the window first, so the
    work by match is bounded whatever the length of the text.
    """
    before, after = window
    back, ahead = 2 * (before // shortest + 1), 2 * (after // shortest + 1) + 1

    def one(pieces: Column, tails: Column, heads: Column, i: Column) -> Column:
        first = F.greatest(i - back, F.lit(0))
        left = F.array_join(F.slice(tails, first + 1, i - first), "")
        right = F.array_join(F.slice(heads, i + 1, F.lit(ahead)), "")
        near = F.concat(F.right(left, F.lit(before)), F.left(right, F.lit(after)))
        return F.struct(F.get(pieces, i).alias("match"), near.alias("near"))

    def windows(pieces: Column) -> Column:
        sides = F.struct(
            F.transform(pieces, lambda p: F.right(p, F.lit(before))).alias("tails"),
            F.transform(pieces, lambda p: F.left(p, F.lit(after))).alias("heads"),
        )
        starts = F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2))
        found = let(
            sides,
            lambda s: F.transform(starts, lambda i: one(pieces, s["tails"], s["heads"], i)),
        )
        return F.when(F.size(pieces) > 1, found).otherwise(
            F.array().cast("array<struct<match:string,near:string>>")
        )

    return let(pieces_around(text, pattern), windows)
