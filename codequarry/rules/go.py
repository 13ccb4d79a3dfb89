"""Interface rules for Go."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.patterns import Rx
from codequarry.functions.text import let, mentions, no_strings, strings_if
from codequarry.rules.base import (
    Source,
    any_calls,
    event_rows,
    grpc_rows,
    http_rows,
    routes,
)

# --- fixed values: patterns --------------------------------------------------
NET_HTTP_EVIDENCE = Rx(r"""["'`]net\/http["'`]|\bhttp\.(?:Handle|HandleFunc|NewServeMux)\b""")
NET_HTTP_HANDLE_FUNC = Rx(
    r"""\b(?:http|mux|router|server)\.HandleFunc\s*\(\s*["'`]([^"'`]+)["'`]"""
)
NET_HTTP_HANDLE = Rx(r"""\b(?:http|mux|router|server)\.Handle\s*\(\s*["'`]([^"'`]+)["'`]""")

UPPER_ROUTE = Rx(
    r"""\b[A-Za-z_]\w*\.(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\s*\(\s*["'`]([^"'`]+)["'`]"""
)
TITLE_ROUTE = Rx(
    r"""\b[A-Za-z_]\w*\.(Get|Post|Put|Patch|Delete|Options|Head)\s*\(\s*["'`]([^"'`]+)["'`]"""
)

GIN_IMPORT = "github.com/gin-gonic/gin"
GIN_NEW = Rx(r"""\bgin\.(?:Default|New)\s*\(""")
ECHO_IMPORT = "github.com/labstack/echo"
ECHO_NEW = Rx(r"""\becho\.New\s*\(""")
FIBER_IMPORT = "github.com/gofiber/fiber"
FIBER_NEW = Rx(r"""\bfiber\.New\s*\(""")
CHI_IMPORT = "github.com/go-chi/chi"
CHI_NEW = Rx(r"""\bchi\.NewRouter\s*\(""")

GRPC_IMPORT = "google.golang.org/grpc"
GRPC_NEW = Rx(r"""\bgrpc\.NewServer\s*\(""")
GRPC_REGISTER = Rx(r"""\bRegister([A-Za-z_]\w*)Server\s*\(""")

WEBSOCKET_IMPORTS = ("gorilla/websocket", "nhooyr.io/websocket")
WEBSOCKET_USE = Rx(r"""\bwebsocket\.Upgrader\b|\.Upgrade\s*\(""")
WEBSOCKET_READ = Rx(r"""\bRead(?:JSON|Message)\s*\(""")
# -----------------------------------------------------------------------------


def net_http(src: Source) -> Column:
    gate = mentions(src.text, "net/http", "http.") & NET_HTTP_EVIDENCE.found_in(src.text)
    paths = F.concat(NET_HTTP_HANDLE_FUNC.all(src.text, 1), NET_HTTP_HANDLE.all(src.text, 1))
    return http_rows("net/http", any_calls(strings_if(gate, paths)))


def gin(src: Source) -> Column:
    gate = mentions(src.text, GIN_IMPORT) | (
        mentions(src.text, "gin.") & GIN_NEW.found_in(src.text)
    )
    return routes("Gin", gate, src.text, UPPER_ROUTE)


def echo(src: Source) -> Column:
    gate = mentions(src.text, ECHO_IMPORT) | (
        mentions(src.text, "echo.New") & ECHO_NEW.found_in(src.text)
    )
    return routes("Echo", gate, src.text, UPPER_ROUTE)


def fiber(src: Source) -> Column:
    gate = mentions(src.text, FIBER_IMPORT) | (
        mentions(src.text, "fiber.New") & FIBER_NEW.found_in(src.text)
    )
    return routes("Fiber", gate, src.text, TITLE_ROUTE)


def chi(src: Source) -> Column:
    gate = mentions(src.text, CHI_IMPORT) | (
        mentions(src.text, "chi.NewRouter") & CHI_NEW.found_in(src.text)
    )
    return routes("Chi", gate, src.text, TITLE_ROUTE)


def grpc(src: Source) -> Column:
    def rows(names: Column) -> Column:
        gate = (
            mentions(src.text, GRPC_IMPORT)
            | (F.size(names) > 0)
            | (mentions(src.text, "grpc.NewServer") & GRPC_NEW.found_in(src.text))
        )
        return grpc_rows(F.when(gate, names))

    found = F.when(
        mentions(src.text, "Register"), GRPC_REGISTER.all(src.text, 1)
    ).otherwise(no_strings())
    return let(found, rows)


def websocket(src: Source) -> Column:
    gate = mentions(src.text, *WEBSOCKET_IMPORTS) | (
        mentions(src.text, "Upgrade") & WEBSOCKET_USE.found_in(src.text)
    )
    event = F.when(WEBSOCKET_READ.found_in(src.text), "message").otherwise("websocket")
    return event_rows("websocket", "WebSocket", strings_if(gate, F.array(event)))
