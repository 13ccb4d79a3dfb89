"""Interface rules for Rust."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.patterns import Rx
from codequarry.functions.text import (
    let,
    matches_with_window,
    mentions,
    rooted,
    strings_if,
)
from codequarry.rules.base import Source, call, grpc_rows, http_rows, routes

# --- fixed values: patterns --------------------------------------------------
ATTRIBUTE_ROUTE = Rx(
    r"""#\[(get|post|put|patch|delete|head|options)\s*\(\s*["']([^"']+)["']\s*\)\]""",
    ignore_case=True,
)

ACTIX_EVIDENCE = Rx(r"""actix_web|\bHttpServer::new\b|\bApp::new\b""")

AXUM_EVIDENCE = Rx(r"""axum::|\bRouter::new\s*\(""")
AXUM_ROUTE = Rx(r"""\.route\s*\(\s*["']([^"']+)["']\s*,\s*([^\n;]+)""")
AXUM_METHOD = Rx(r"""\b(get|post|put|patch|delete|head|options)\s*\(""", ignore_case=True)

ROCKET_EVIDENCE = Rx(r"""rocket::|extern\s+crate\s+rocket|#\[launch\]""")

WARP_EVIDENCE = "warp::"
WARP_PATH = Rx(r"""warp::path!?\s*\(\s*["']([^"']+)["']\s*\)""")
WARP_METHOD = Rx(r"""warp::(get|post|put|patch|delete|head|options)\s*\(""", ignore_case=True)

WARP_WINDOW = (200, 300)
WARP_SHORTEST = len('warp::path("x")')

GRPC_EVIDENCE = Rx(r"""tonic::|tonic_build|\.add_service\s*\(""")
GRPC_SERVICE = Rx(r"""\.add_service\s*\(\s*([A-Za-z_]\w*)Server::new""")
# -----------------------------------------------------------------------------


def actix_web(src: Source) -> Column:
    gate = mentions(
        src.text, "actix_web", "HttpServer::new", "App::new"
    ) & ACTIX_EVIDENCE.found_in(src.text)
    return routes("Actix Web", gate, src.text, ATTRIBUTE_ROUTE)


def axum(src: Source) -> Column:
    """One row per distinct method named in the rest of a route's line."""

    def one(match: Column) -> Column:
        return let(
            AXUM_ROUTE.part(match, 1),
            lambda path: F.transform(
                AXUM_METHOD.all(AXUM_ROUTE.part(match, 2), 1), lambda m: call(F.upper(m), path)
            ),
        )

    gate = mentions(src.text, "axum::", "Router::new") & AXUM_EVIDENCE.found_in(src.text)
    calls = F.flatten(F.transform(AXUM_ROUTE.all(src.text), one))
    return http_rows("Axum", strings_if(gate, calls))


def rocket(src: Source) -> Column:
    gate = mentions(src.text, "rocket", "#[launch]") & ROCKET_EVIDENCE.found_in(src.text)
    return routes("Rocket", gate, src.text, ATTRIBUTE_ROUTE)


def nearby_calls(
    text: Column, path: Rx, method: Rx, window: tuple[int, int], shortest: int
) -> Column:
    """A call per path and method named near the path, else ANY.

    The window is so many characters before and from the start of the match.
    """

    def one(found: Column) -> Column:
        named = let(
            F.transform(method.all(found["near"], 1), F.upper),
            lambda m: F.when(F.size(m) > 0, m).otherwise(F.array(F.lit("ANY"))),
        )
        own = rooted(path.part(found["match"], 1))
        return let(own, lambda p: F.transform(named, lambda m: call(m, p)))

    return F.flatten(F.transform(matches_with_window(text, path, window, shortest), one))


def warp(src: Source) -> Column:
    gate = mentions(src.text, WARP_EVIDENCE)
    calls = nearby_calls(src.text, WARP_PATH, WARP_METHOD, WARP_WINDOW, WARP_SHORTEST)
    return http_rows("Warp", strings_if(gate, calls))


def grpc(src: Source) -> Column:
    gate = mentions(src.text, "tonic", "add_service") & GRPC_EVIDENCE.found_in(src.text)
    found = F.when(gate, GRPC_SERVICE.all(src.text, 1))
    return let(found, lambda names: grpc_rows(names))
