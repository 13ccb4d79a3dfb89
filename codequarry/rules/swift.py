"""Interface rules for Swift."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.patterns import Rx
from codequarry.functions.text import let, mentions, strings_if
from codequarry.rules.base import Source, call, http_rows

# --- fixed values: patterns --------------------------------------------------
VAPOR_EVIDENCE = Rx(r"""import\s+Vapor""")
VAPOR_ROUTE = Rx(r"""\bapp\.(get|post|put|patch|delete|on)\s*\(([^)]*)\)""", ignore_case=True)
VAPOR_METHOD = Rx(r"""\.(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\b""", ignore_case=True)
QUOTED = Rx(r"""["']([^"']+)["']""")
# -----------------------------------------------------------------------------


def vapor(src: Source) -> Column:
    """The strings among the arguments are the path segments."""

    def one(match: Column) -> Column:
        def route(p: Column) -> Column:
            named = VAPOR_METHOD.part(p["args"], 1)
            method = F.when(p["verb"] != "ON", p["verb"]).otherwise(
                F.upper(F.when(named != "", named).otherwise("ANY"))
            )
            joined = F.concat(F.lit("/"), F.array_join(QUOTED.all(p["args"], 1), "/"))
            return call(method, F.regexp_replace(joined, "/+", "/"))

        parts = F.struct(
            F.upper(VAPOR_ROUTE.part(match, 1)).alias("verb"),
            VAPOR_ROUTE.part(match, 2).alias("args"),
        )
        return let(parts, route)

    gate = mentions(src.text, "Vapor") & VAPOR_EVIDENCE.found_in(src.text)
    return http_rows("Vapor", strings_if(gate, F.transform(VAPOR_ROUTE.all(src.text), one)))
