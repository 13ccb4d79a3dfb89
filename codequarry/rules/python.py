"""Interface rules for Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.patterns import Rx
from codequarry.functions.text import all_matches, join_paths, let, mentions, strings_if
from codequarry.rules.base import Source, any_calls, call, event_rows, grpc_rows, http_rows

# --- fixed values: patterns --------------------------------------------------
FLASK_EVIDENCE = Rx(
    r"""from\s+flask\s+import\b|import\s+flask\b|\b(?:Flask|Blueprint)\s*\(|@(?:app|router)\.route\s*\("""
)
FLASK_DECORATOR = Rx(
    r"""@(?:app|router)\.(route|get|post|put|patch|delete|options|head)\s*\(([\s\S]*?)\)""",
    ignore_case=True,
)
FLASK_PATH = Rx(r"""(?:^\s*|rule\s*=\s*)["'`]([^"'`]+)["'`]""")
FLASK_METHODS = Rx(r"""methods\s*=\s*[\[\(]([\s\S]*?)[\]\)]""", ignore_case=True)
QUOTED_WORD = Rx(r"""["'`]([A-Za-z]+)["'`]""")

FASTAPI_EVIDENCE = Rx(
    r"""\bFastAPI\s*\(|\bAPIRouter\s*\(|from\s+fastapi\s+import\b|import\s+fastapi\b""",
    faster=r"""[FAfi](?:(?<=F)(?<!\wF)astAPI\s*+\(|(?<=A)(?<!\wA)PIRouter\s*+\(|(?<=f)rom\s++fastapi\s++import\b|(?<=i)mport\s++fastapi\b)""",
)
FASTAPI_APP = Rx(
    r"""\b([A-Za-z_]\w*)\s*=\s*FastAPI\s*\(""",
    end=r"""=\s*+FastAPI\s*+\(""",
    reach=r"""\s*+\w*+""",
)
FASTAPI_ROUTER = Rx(
    r"""\b([A-Za-z_]\w*)\s*=\s*APIRouter\s*\(([\s\S]*?)\)""",
    faster=r"""([A-Za-z_](?<!\w[A-Za-z_])\w*+)\s*+=\s*+APIRouter\s*+\(([^)]*+)\)""",
)
FASTAPI_PREFIX = Rx(r"""prefix\s*=\s*["'`]([^"'`]+)["'`]""")
FASTAPI_ROUTE = Rx(
    r"""@([A-Za-z_]\w*)\.(get|post|put|patch|delete|options|head)\s*\(\s*["'`]([^"'`]+)["'`]""",
    ignore_case=True,
)
FASTAPI_KNOWN = ("app=", "router=")

DJANGO_EVIDENCE = Rx(
    r"""from\s+django\.urls\s+import\b|import\s+django\.urls\b|\burlpatterns\s*="""
)
DJANGO_PATH = Rx(r"""path\s*\(\s*["'`]([^"'`]+)["'`]\s*,\s*([^,)]+)""")
DJANGO_RE_PATH = Rx(r"""re_path\s*\(\s*["'`]([^"'`]+)["'`]\s*,\s*([^,)]+)""")

FLASK_SOCKETIO_EVIDENCE = Rx(
    r"""from\s+flask_socketio\s+import\b|import\s+flask_socketio\b|\bSocketIO\s*\("""
)
FLASK_SOCKETIO_ON = Rx(r"""@([A-Za-z_]\w*)\.on\s*\(\s*["'`]([^"'`]+)["'`]""")
FLASK_SOCKETIO_EMIT = Rx(r"""\b([A-Za-z_]\w*)\.emit\s*\(\s*["'`]([^"'`]+)["'`]""")

CHANNELS_EVIDENCE = Rx(
    r"""from\s+channels\.|import\s+channels\b|\b(?:WebsocketConsumer|AsyncWebsocketConsumer|AsyncJsonWebsocketConsumer|JsonWebsocketConsumer)\b|\bwebsocket_urlpatterns\b|\b(?:ProtocolTypeRouter|URLRouter)\s*\("""
)

GRPC_EVIDENCE = Rx(
    r"""import\s+grpc\b|from\s+grpc\b|\bgrpc\.server\s*\(|\badd_[A-Za-z_]\w*Servicer_to_server\s*\("""
)
GRPC_ADD_SERVICER = Rx(r"""\badd_([A-Za-z_]\w*)Servicer_to_server\s*\(""")
GRPC_CLASS = Rx(r"""class\s+([A-Za-z_]\w*)\s*\([^)]*Servicer[^)]*\)\s*:""")
GRPC_SERVER = Rx(r"""\bgrpc\.server\s*\(""")
# -----------------------------------------------------------------------------


def flask(src: Source) -> Column:
    """Decorated routes, one row per method; a route without a path is skipped."""

    def methods(decorator: Column, args: Column) -> Column:
        listed = F.transform(QUOTED_WORD.all(FLASK_METHODS.part(args, 1), 1), F.upper)
        own = F.when(decorator == "ROUTE", "GET").otherwise(decorator)
        return let(listed, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(own)))

    def one(match: Column) -> Column:
        parts = F.struct(
            F.upper(FLASK_DECORATOR.part(match, 1)).alias("decorator"),
            FLASK_DECORATOR.part(match, 2).alias("args"),
            FLASK_PATH.part(FLASK_DECORATOR.part(match, 2), 1).alias("path"),
        )
        return let(
            parts,
            lambda p: strings_if(
                p["path"] != "",
                F.transform(methods(p["decorator"], p["args"]), lambda m: call(m, p["path"])),
            ),
        )

    gate = mentions(src.text, "flask", "Flask", "Blueprint", ".route") & FLASK_EVIDENCE.found_in(
        src.text
    )
    calls = F.flatten(F.transform(FLASK_DECORATOR.all(src.text), one))
    return http_rows("Flask", strings_if(gate, calls))


def fastapi(src: Source) -> Column:
    """Routes of known apps and routers; the last definition of a name counts."""
    known = F.concat(
        F.array(*[F.lit(k) for k in FASTAPI_KNOWN]),
        F.transform(
            strings_if(mentions(src.text, "FastAPI"), all_matches(src.text, FASTAPI_APP)),
            lambda m: F.concat(FASTAPI_APP.part(m, 1), F.lit("=")),
        ),
        F.transform(
            strings_if(mentions(src.text, "APIRouter"), FASTAPI_ROUTER.all(src.text)),
            lambda m: F.concat(
                FASTAPI_ROUTER.part(m, 1),
                F.lit("="),
                FASTAPI_PREFIX.part(FASTAPI_ROUTER.part(m, 2), 1),
            ),
        ),
    )

    def one(match: Column, names: Column) -> Column:
        receiver = F.concat(FASTAPI_ROUTE.part(match, 1), F.lit("="))
        definition = let(
            receiver,
            lambda r: F.try_element_at(F.filter(names, lambda n: n.startswith(r)), F.lit(-1)),
        )
        return let(
            definition,
            lambda d: call(
                F.upper(FASTAPI_ROUTE.part(match, 2)),
                join_paths(
                    F.substr(d, F.instr(d, "=") + 1),
                    FASTAPI_ROUTE.part(match, 3),
                    strip_end=False,
                ),
            ),
        )

    gate = mentions(src.text, "FastAPI", "APIRouter", "fastapi") & FASTAPI_EVIDENCE.found_in(
        src.text
    )
    calls = let(
        known, lambda names: F.transform(FASTAPI_ROUTE.all(src.text), lambda m: one(m, names))
    )
    return http_rows("FastAPI", F.filter(strings_if(gate, calls), lambda c: c.isNotNull()))


def django(src: Source) -> Column:
    gate = mentions(src.text, "django", "urlpatterns") & DJANGO_EVIDENCE.found_in(src.text)
    paths = F.concat(DJANGO_PATH.all(src.text, 1), DJANGO_RE_PATH.all(src.text, 1))
    return http_rows("Django", any_calls(strings_if(gate, paths)))


def flask_socketio(src: Source) -> Column:
    gate = mentions(
        src.text, "flask_socketio", "SocketIO"
    ) & FLASK_SOCKETIO_EVIDENCE.found_in(src.text)
    events = F.concat(FLASK_SOCKETIO_ON.all(src.text, 2), FLASK_SOCKETIO_EMIT.all(src.text, 2))
    return event_rows("socketio", "Flask-SocketIO", strings_if(gate, events))


def django_channels(src: Source) -> Column:
    near = mentions(
        src.text, "channels", "WebsocketConsumer", "websocket_urlpatterns", "TypeRouter", "URLRouter"
    )
    gate = near & CHANNELS_EVIDENCE.found_in(src.text)
    return event_rows(
        "websocket", "Django Channels", strings_if(gate, F.array(F.lit("websocket")))
    )


def grpc(src: Source) -> Column:
    gate = mentions(src.text, "grpc", "Servicer_to_server") & GRPC_EVIDENCE.found_in(src.text)
    names = F.concat(GRPC_ADD_SERVICER.all(src.text, 1), GRPC_CLASS.all(src.text, 1))
    found = F.when(gate, names)
    return let(found, lambda n: grpc_rows(n, fallback=GRPC_SERVER.found_in(src.text)))
