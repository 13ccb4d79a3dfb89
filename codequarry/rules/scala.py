"""Interface rules for Scala."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.patterns import Rx
from codequarry.functions.text import let, mentions, strings_if
from codequarry.rules.base import Source, call, http_rows
from codequarry.rules.rust import nearby_calls

# --- fixed values: patterns --------------------------------------------------
PLAY_EVIDENCE = ("play.api.mvc", "play.routing", "playframework")
PLAY_BLOCK = Rx(r"""((?:\s*@[A-Za-z][\w.]*\s*(?:\([^)]*\))?\s*)+)\s*def\s+\w+""")
PLAY_PATH = Rx(r"""@Path\s*\(\s*["']([^"']+)["']\s*\)""")
PLAY_VERB = Rx(r"""@(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\b""")

AKKA_EVIDENCE = "akka.http.scaladsl"
AKKA_PATH = Rx(r"""\bpath(?:Prefix)?\s*\(\s*["']([^"']+)["']\s*\)""")
AKKA_METHOD = Rx(r"""\b(get|post|put|patch|delete|options|head)\s*\{""", ignore_case=True)
AKKA_WINDOW = (120, 300)
AKKA_SHORTEST = len('path("x")')
# -----------------------------------------------------------------------------


def play(src: Source) -> Column:
    """Annotated definitions that carry both a path and a method."""

    def one(annotations: Column) -> Column:
        return let(
            PLAY_PATH.part(annotations, 1),
            lambda path: strings_if(
                path != "",
                F.transform(PLAY_VERB.all(annotations, 1), lambda m: call(m, path)),
            ),
        )

    gate = mentions(src.text, *PLAY_EVIDENCE) & mentions(src.text, "@Path")
    calls = F.flatten(F.transform(PLAY_BLOCK.all(src.text, 1), one))
    return http_rows("Play Framework", strings_if(gate, calls))


def akka_http(src: Source) -> Column:
    gate = mentions(src.text, AKKA_EVIDENCE)
    calls = nearby_calls(src.text, AKKA_PATH, AKKA_METHOD, AKKA_WINDOW, AKKA_SHORTEST)
    return http_rows("Akka HTTP", strings_if(gate, calls))
