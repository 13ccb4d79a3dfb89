"""Interface rules for Ruby."""

from __future__ import annotations

from pyspark.sql import Column

from codequarry.functions.patterns import Rx
from codequarry.functions.text import mentions
from codequarry.rules.base import Source, routes

# --- fixed values: patterns --------------------------------------------------
RAILS_EVIDENCE = Rx(
    r"""Rails\.application\.routes\.draw|class\s+\w+Controller\s*<\s*ApplicationController|ActionController::"""
)
RAILS_ROUTE = Rx(
    r"""(?:^|\n)\s*(get|post|put|patch|delete|options|head)\s+["']([^"']+)["']""",
    ignore_case=True,
)

SINATRA_EVIDENCE = Rx(r"""require\s+["']sinatra["']|Sinatra::Base""")
SINATRA_ROUTE = Rx(
    r"""(?:^|\n)\s*(get|post|put|patch|delete|options|head)\s+["']([^"']+)["']\s+do\b""",
    ignore_case=True,
)
# -----------------------------------------------------------------------------


def rails(src: Source) -> Column:
    near = mentions(src.text, "Rails.", "ApplicationController", "ActionController::")
    return routes("Rails", near & RAILS_EVIDENCE.found_in(src.text), src.text, RAILS_ROUTE)


def sinatra(src: Source) -> Column:
    near = mentions(src.text, "sinatra", "Sinatra::Base")
    return routes("Sinatra", near & SINATRA_EVIDENCE.found_in(src.text), src.text, SINATRA_ROUTE)
