"""Interface rules for Dart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.patterns import Rx
from codequarry.functions.text import let, mentions, strings_if
from codequarry.rules.base import Source, call, http_rows, routes

# --- fixed values: patterns --------------------------------------------------
SHELF_EVIDENCE = Rx(r"""package:shelf|shelf_router|\bRouter\s*\(\s*\)""")
SHELF_ROUTE = Rx(
    r"""\b[A-Za-z_]\w*\.(get|post|put|patch|delete|options|head)\s*\(\s*["']([^"']+)["']""",
    ignore_case=True,
)

DART_FROG_PACKAGE = "package:dart_frog"
DART_FROG_HANDLER = Rx(r"""\bonRequest\s*\(\s*RequestContext\s+context\s*\)""")
DART_FROG_METHOD = Rx(
    r"""HttpMethod\.(get|post|put|patch|delete|head|options)""", ignore_case=True
)
# -----------------------------------------------------------------------------


def shelf(src: Source) -> Column:
    near = mentions(src.text, "shelf", "Router")
    return routes("Shelf", near & SHELF_EVIDENCE.found_in(src.text), src.text, SHELF_ROUTE)


def dart_frog(src: Source) -> Column:
    """The route is the place of the file below the last ``routes`` directory."""
    place = F.regexp_extract(
        F.concat(F.lit("/"), F.replace(src.path, F.lit("\\"), F.lit("/"))),
        r"(?s)\A.*/routes/(.*)\z",
        1,
    )
    segments = F.filter(
        F.split(F.regexp_replace(place, r"(?i)\.dart\z", ""), "/"),
        lambda s: (s != "") & (s != "index"),
    )
    named = F.transform(segments, lambda s: F.regexp_replace(s, r"\A\[(.+)\]\z", ":$1"))
    route = F.concat(F.lit("/"), F.array_join(named, "/"))
    methods = let(
        F.transform(DART_FROG_METHOD.all(src.text, 1), F.upper),
        lambda m: F.when(F.size(m) > 0, m).otherwise(F.array(F.lit("ANY"))),
    )
    gate = (place != "") & (
        mentions(src.text, DART_FROG_PACKAGE)
        | (mentions(src.text, "onRequest") & DART_FROG_HANDLER.found_in(src.text))
    )
    calls = let(route, lambda path: F.transform(methods, lambda m: call(m, path)))
    return http_rows("Dart Frog", strings_if(gate, calls))
