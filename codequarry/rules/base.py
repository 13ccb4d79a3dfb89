"""Building blocks of the interface rules.

A rule turns the text of one file into an array of interface rows. Everything a
rule needs is in the row of the file, so all rules run inside one narrow
projection: no join and no shuffle, whatever the number of files.

Rows repeat in a file (a route registered twice, a pattern that also matches
inside another). Repeats are dropped on arrays of strings, which Spark hashes;
``array_distinct`` on structs would compare all pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.patterns import Rx
from codequarry.functions.text import no_strings, strings_if

FIELDS = ("type", "protocol", "framework", "role", "method", "path", "event", "direction")
ROWS_TYPE = "array<struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">>"


@dataclass(frozen=True)
class Source:
    """The columns of one file a rule may read.

    ``lower`` is the lower-cased text, there for cheap substring tests ahead of
    case-insensitive patterns. ``one_direction`` asks for socket events to be
    listed once per role, in the direction found first.
    """

    path: Column
    text: Column
    lower: Column
    one_direction: bool = True


@dataclass(frozen=True)
class Detector:
    name: str
    languages: tuple[str, ...]
    rows: Callable[[Source], Column]
    # Do the rows depend on whether one direction by role is asked for?
    directed: bool = False


def no_rows() -> Column:
    return F.array().cast(ROWS_TYPE)


def rows_if(condition: Column, rows: Column) -> Column:
    return F.when(condition, rows).otherwise(no_rows())


def _row(**values: Column | str | None) -> Column:
    missing = F.lit(None).cast("string")

    def field(name: str) -> Column:
        value = values.get(name)
        if value is None:
            return missing.alias(name)
        return (value if isinstance(value, Column) else F.lit(value)).alias(name)

    return F.struct(*[field(name) for name in FIELDS])


def call(method: Column, path: Column) -> Column:
    """Method and path of one route as one string, ``GET /a``."""
    return F.concat(method, F.lit(" "), path)


def http_rows(framework: Column | str, calls: Column, protocol: str = "rest") -> Column:
    return F.transform(
        F.array_distinct(calls),
        lambda c: _row(
            type="http",
            protocol=protocol,
            framework=framework,
            role="server",
            method=F.substring_index(c, " ", 1),
            path=F.substr(c, F.instr(c, " ") + 1),
        ),
    )


def event_rows(
    protocol: str,
    framework: str,
    events: Column,
    role: Column | str = "server",
    direction: str | None = None,
) -> Column:
    return F.transform(
        F.array_distinct(events),
        lambda e: _row(
            type="realtime",
            protocol=protocol,
            framework=framework,
            role=role,
            event=e,
            direction=direction,
        ),
    )


def routes(
    framework: str,
    gate: Column,
    text: Column,
    pattern: Rx,
    method: int = 1,
    path: int = 2,
    any_verbs: tuple[str, ...] = (),
) -> Column:
    """Rows for a pattern with the verb in one group and the path in another."""

    def one(match: Column) -> Column:
        verb = F.upper(pattern.part(match, method))
        if any_verbs:
            verb = F.when(verb.isin(*any_verbs), "ANY").otherwise(verb)
        return call(verb, pattern.part(match, path))

    return http_rows(framework, strings_if(gate, F.transform(pattern.all(text), one)))


def any_calls(paths: Column) -> Column:
    return F.transform(paths, lambda p: call(F.lit("ANY"), p))


def grpc_rows(names: Column, fallback: Column | None = None) -> Column:
    """gRPC services, none where ``names`` is null; ``grpc`` stands in where no name was found."""
    stand_in = F.size(names) == 0 if fallback is None else (F.size(names) == 0) & fallback
    named = F.when(names.isNull(), no_strings()).when(stand_in, F.array(F.lit("grpc")))
    return event_rows("grpc", "gRPC", named.otherwise(names))
