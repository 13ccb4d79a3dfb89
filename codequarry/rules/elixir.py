"""Interface rules for Elixir."""

from __future__ import annotations

from pyspark.sql import Column

from codequarry.functions.patterns import Rx
from codequarry.functions.text import mentions
from codequarry.rules.base import Source, routes

# --- fixed values: patterns --------------------------------------------------
PHOENIX_EVIDENCE = Rx(r"""use\s+Phoenix\.Router|Phoenix\.Controller|scope\s+["']""")
PHOENIX_ROUTE = Rx(
    r"""(?:^|\n)\s*(get|post|put|patch|delete|options|head)\s+["']([^"']+)["']\s*,""",
    ignore_case=True,
)
# -----------------------------------------------------------------------------


def phoenix(src: Source) -> Column:
    near = mentions(src.text, "Phoenix.", "scope")
    return routes("Phoenix", near & PHOENIX_EVIDENCE.found_in(src.text), src.text, PHOENIX_ROUTE)
