"""Interface rules for Java; some also apply to Kotlin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.patterns import Rx
from codequarry.functions.text import join_paths, let, mentions, strings_if
from codequarry.rules.base import Source, call, event_rows, grpc_rows, http_rows, rows_if

# --- fixed values: patterns --------------------------------------------------
SPRING_EVIDENCE = Rx(
    r"""org\.springframework\.|@(RestController|Controller|RequestMapping|GetMapping|PostMapping|PutMapping|PatchMapping|DeleteMapping)\b"""
)
# Group 1 is the text behind the "@", 300 characters with it.
SPRING_MAPPING = Rx(
    r"""@(?=([\s\S]{0,299}))(GetMapping|PostMapping|PutMapping|PatchMapping|DeleteMapping|RequestMapping)\s*(?:\(([^)]*)\))?""",
    faster=r"""@(?=(?:Get|Post|Put|Patch|Delete|Request)Mapping)(?=([\s\S]{0,299}))(GetMapping|PostMapping|PutMapping|PatchMapping|DeleteMapping|RequestMapping)\s*(?:\(([^)]*)\))?""",
)
SPRING_MAPPING_ARGS = Rx(r"""^@\w+\s*\(([^)]*)\)""")
SPRING_CLASS = Rx(
    r"""@RequestMapping\s*(?:\(([^)]*)\))?[\s\S]{0,300}?\b(?:class|interface|record)\s+\w+"""
)
SPRING_TYPE_WORD = Rx(r"""\b(?:class|interface|record)\b""")
SPRING_NAMED_PATH = Rx(r"""(?:value|path)\s*=\s*(?:\{)?\s*["'`]([^"'`]+)["'`]""")
SPRING_METHOD = Rx(r"""RequestMethod\.(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)""")
QUOTED = Rx(r"""["'`]([^"'`]+)["'`]""")

SPRING_WEBSOCKET_EVIDENCE = Rx(
    r"""org\.springframework\.messaging|org\.springframework\.web\.socket|@(MessageMapping|SubscribeMapping|SendTo)\b"""
)
SPRING_WEBSOCKET_EVENT = Rx(
    r"""@(MessageMapping|SubscribeMapping|SendTo)\s*(?:\(\s*["'`]([^"'`]+)["'`]\s*\))?"""
)

JAXRS_PACKAGE = Rx(r"""(?:javax|jakarta)\.ws\.rs""")
JAXRS_ANNOTATION = Rx(r"""@(Path|GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\b""")
JAXRS_PATH_ANNOTATION = Rx(r"""@Path\b""")
JAXRS_METHOD_BLOCK = Rx(
    r"""((?:\s*@[A-Za-z][\w.]*\s*(?:\([^)]*\))?\s*)+)\s*(?:public|protected|private)?[\s\w<>,.?[\]]+\s+\w+\s*\("""
)
JAXRS_VERB = Rx(r"""@(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\b""")
JAXRS_PATH = Rx(r"""@Path\s*\(\s*["'`]([^"'`]+)["'`]\s*\)""")
JAXRS_CLASS_PATH = Rx(r"""@Path\s*\(\s*["'`]([^"'`]+)["'`]\s*\)[\s\S]{0,300}?\bclass\s+\w+""")

GRPC_EVIDENCE = Rx(r"""io\.grpc|@GrpcService\b|\b[A-Za-z_]\w*ImplBase\b|\bbindService\s*\(""")
GRPC_BASE = Rx(
    r"""(?:extends|implements)\s+([A-Za-z_]\w*(?:Grpc)?\.[A-Za-z_]\w*ImplBase|[A-Za-z_]\w*ImplBase)\b"""
)
GRPC_METHOD = Rx(
    r"""@Override\s+[\s\S]{0,200}?\b(?:StreamObserver<[^>]+>|void|[A-Za-z_]\w*)\s+([a-zA-Z_]\w*)\s*\("""
)
# -----------------------------------------------------------------------------


def spring(src: Source) -> Column:
    """Mapped methods under the prefix of the first mapped type.

    A RequestMapping directly in front of a type is its prefix, not a route.
    """

    def path_of(args: Column) -> Column:
        return let(
            SPRING_NAMED_PATH.part(args, 1),
            lambda named: F.when(named != "", named).otherwise(QUOTED.part(args, 1)),
        )

    def requested(args: Column) -> Column:
        return let(
            SPRING_METHOD.all(args, 1),
            lambda m: F.when(F.size(m) > 0, m).otherwise(F.array(F.lit("ANY"))),
        )

    def one(match: Column, ahead: Column, prefix: Column) -> Column:
        name = F.regexp_extract(match, r"\A@(\w+)Mapping", 1)
        args = SPRING_MAPPING_ARGS.part(match, 1)
        on_type = SPRING_TYPE_WORD.found_in(F.substring_index(ahead, "{", 1))

        def rows(p: Column) -> Column:
            methods = F.when(p["name"] == "Request", requested(p["args"])).otherwise(
                F.array(F.upper(p["name"]))
            )
            return strings_if(
                (p["name"] != "Request") | ~on_type,
                let(
                    join_paths(prefix, path_of(p["args"]), strip_end=False),
                    lambda path: F.transform(methods, lambda m: call(m, path)),
                ),
            )

        return let(F.struct(name.alias("name"), args.alias("args")), rows)

    gate = mentions(
        src.text, "org.springframework.", "Controller", "Mapping"
    ) & SPRING_EVIDENCE.found_in(src.text)
    found = F.arrays_zip(
        SPRING_MAPPING.all(src.text).alias("match"), SPRING_MAPPING.all(src.text, 1).alias("ahead")
    )
    calls = let(
        path_of(SPRING_CLASS.part(src.text, 1)),
        lambda prefix: F.flatten(
            F.transform(found, lambda f: one(f["match"], f["ahead"], prefix))
        ),
    )
    return http_rows("Spring", strings_if(gate, calls))


def jax_rs(src: Source) -> Column:
    """Annotated methods; the last path of a method goes under that of the class."""

    def one(annotations: Column, prefix: Column) -> Column:
        own = F.coalesce(F.try_element_at(JAXRS_PATH.all(annotations, 1), F.lit(-1)), F.lit(""))
        return let(
            join_paths(prefix, own, strip_end=True),
            lambda path: F.transform(JAXRS_VERB.all(annotations, 1), lambda m: call(m, path)),
        )

    text = src.text
    gate = (
        mentions(text, "@Path")
        & JAXRS_PATH_ANNOTATION.found_in(text)
        & (JAXRS_PACKAGE.found_in(text) | JAXRS_ANNOTATION.found_in(text))
    )
    calls = let(
        JAXRS_CLASS_PATH.part(text, 1),
        lambda prefix: F.flatten(
            F.transform(JAXRS_METHOD_BLOCK.all(text, 1), lambda a: one(a, prefix))
        ),
    )
    framework = F.when(mentions(text, "jakarta.ws.rs"), "Jakarta REST").otherwise("JAX-RS")
    return rows_if(gate, let(framework, lambda f: http_rows(f, calls)))


def spring_websocket(src: Source) -> Column:
    def one(match: Column) -> Column:
        return let(
            SPRING_WEBSOCKET_EVENT.part(match, 2),
            lambda name: F.when(name != "", name)
            .when(match.startswith("@SendTo"), "send")
            .otherwise("message"),
        )

    near = mentions(src.text, "org.springframework.", "MessageMapping", "SubscribeMapping", "SendTo")
    gate = near & SPRING_WEBSOCKET_EVIDENCE.found_in(src.text)
    events = F.transform(SPRING_WEBSOCKET_EVENT.all(src.text), one)
    return event_rows("websocket", "Spring WebSocket", strings_if(gate, events))


def grpc(src: Source) -> Column:
    text = src.text
    gate = mentions(
        text, "io.grpc", "GrpcService", "ImplBase", "bindService"
    ) & GRPC_EVIDENCE.found_in(text)
    services = F.transform(
        GRPC_BASE.all(text, 1),
        lambda n: F.regexp_replace(F.substring_index(n, ".", -1), r"ImplBase\z", ""),
    )
    found = F.when(gate, F.concat(services, GRPC_METHOD.all(text, 1)))
    return let(found, lambda names: grpc_rows(names))
