"""Interface rules for PHP."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.patterns import Rx
from codequarry.functions.text import let, mentions, strings_if
from codequarry.rules.base import Source, call, http_rows, routes

# --- fixed values: patterns --------------------------------------------------
LARAVEL_FACADE = "Illuminate\\Support\\Facades\\Route"
LARAVEL_CALL = Rx(
    r"""\bRoute::(?:get|post|put|patch|delete|options|any|match)\s*\(""", ignore_case=True
)
LARAVEL_ROUTE = Rx(
    r"""\bRoute::(get|post|put|patch|delete|options|any|match)\s*\(\s*["']([^"']+)["']""",
    ignore_case=True,
)

SYMFONY_EVIDENCE = Rx(r"""Symfony\\Component\\Routing|#\[\s*Route\s*\(|@Route\s*\(""")
SYMFONY_ATTRIBUTE = Rx(r"""#\[\s*Route\s*\(([\s\S]*?)\)\s*\]""")
SYMFONY_ANNOTATION = Rx(r"""@Route\s*\(([\s\S]*?)\)""")
SYMFONY_METHODS = Rx(r"""methods\s*[:=]\s*[\{\[]([\s\S]*?)[\}\]]""")
QUOTED = Rx(r"""["']([^"']+)["']""")
QUOTED_WORD = Rx(r"""["']([A-Za-z]+)["']""")

SLIM_EVIDENCE = Rx(r"""Slim\\|AppFactory::create\s*\(|\$app\s*=\s*new\s+Slim\\App""")
SLIM_ROUTE = Rx(
    r"""\$[A-Za-z_]\w*->(get|post|put|patch|delete|options|any|map)\s*\(\s*["']([^"']+)["']""",
    ignore_case=True,
)
# -----------------------------------------------------------------------------


def laravel(src: Source) -> Column:
    gate = mentions(src.text, LARAVEL_FACADE) | (
        mentions(src.lower, "route::") & LARAVEL_CALL.found_in(src.text)
    )
    return routes("Laravel", gate, src.text, LARAVEL_ROUTE, any_verbs=("ANY", "MATCH"))


def symfony(src: Source) -> Column:
    def methods(args: Column) -> Column:
        return let(
            F.transform(QUOTED_WORD.all(SYMFONY_METHODS.part(args, 1), 1), F.upper),
            lambda m: F.when(F.size(m) > 0, m).otherwise(F.array(F.lit("ANY"))),
        )

    def one(args: Column) -> Column:
        return let(
            QUOTED.part(args, 1),
            lambda path: strings_if(
                path != "", F.transform(methods(args), lambda m: call(m, path))
            ),
        )

    gate = mentions(src.text, "Symfony", "Route") & SYMFONY_EVIDENCE.found_in(src.text)
    found = F.concat(SYMFONY_ATTRIBUTE.all(src.text, 1), SYMFONY_ANNOTATION.all(src.text, 1))
    return http_rows("Symfony", strings_if(gate, F.flatten(F.transform(found, one))))


def slim(src: Source) -> Column:
    gate = mentions(src.text, "Slim", "AppFactory") & SLIM_EVIDENCE.found_in(src.text)
    return routes("Slim", gate, src.text, SLIM_ROUTE, any_verbs=("ANY", "MAP"))
