"""Interface rules for Kotlin."""

from __future__ import annotations

from pyspark.sql import Column

from codequarry.functions.patterns import Rx
from codequarry.functions.text import mentions
from codequarry.rules.base import Source, routes

# --- fixed values: patterns --------------------------------------------------
KTOR_EVIDENCE = Rx(r"""io\.ktor|\bembeddedServer\s*\(|\brouting\s*\{""")
KTOR_ROUTE = Rx(
    r"""\b(get|post|put|patch|delete|options|head)\s*\(\s*["']([^"']+)["']\s*\)""",
    ignore_case=True,
)
# -----------------------------------------------------------------------------


def ktor(src: Source) -> Column:
    near = mentions(src.text, "io.ktor", "embeddedServer", "routing")
    return routes("Ktor", near & KTOR_EVIDENCE.found_in(src.text), src.text, KTOR_ROUTE)
