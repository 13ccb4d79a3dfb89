"""Interface rules for JavaScript and TypeScript."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.patterns import Rx
from codequarry.functions.text import join_paths, let, mentions, strings_if
from codequarry.rules.base import (
    Source,
    call,
    event_rows,
    http_rows,
    no_rows,
    routes,
    rows_if,
)

# --- fixed values: patterns --------------------------------------------------
EXPRESS_EVIDENCE = Rx(
    r"""(?:from\s*["'`]express["'`]|require\s*\(\s*["'`]express["'`]\s*\)|\bexpress\s*\(|\bRouter\s*\()""",
    ignore_case=True,
)
EXPRESS_ROUTE = Rx(
    r"""\b(app|router)\.(get|post|put|patch|delete|options|head)\s*\(\s*["'`]([^"'`]+)["'`]""",
    ignore_case=True,
)

FASTIFY_EVIDENCE = Rx(
    r"""(?:from\s*["'`]fastify["'`]|require\s*\(\s*["'`]fastify["'`]\s*\)|\bfastify\s*\(|\bFastify\s*\()""",
    ignore_case=True,
)
FASTIFY_ROUTE = Rx(
    r"""\b(fastify|app|server)\.(get|post|put|patch|delete|options|head)\s*\(\s*["'`]([^"'`]+)["'`]""",
    ignore_case=True,
)

SOCKET_ON = Rx(r"""\bsocket\.on\s*\(\s*["'`]([^"'`]+)["'`]""", ignore_case=True)
SOCKET_EMIT = Rx(r"""\bsocket\.emit\s*\(\s*["'`]([^"'`]+)["'`]""", ignore_case=True)
IO_EMIT = Rx(
    r"""\bio(?:\.[a-zA-Z_$][\w$]*)*\.emit\s*\(\s*["'`]([^"'`]+)["'`]""", ignore_case=True
)
SOCKETIO_CONNECTION = Rx(r"""\bio\.on\s*\(\s*["'`]connection["'`]\s*,""", ignore_case=True)
SOCKETIO_NEW_SERVER = Rx(r"""\bnew\s+Server\s*\(""", ignore_case=True)
SOCKETIO_SERVER_IMPORT = Rx(
    r"""(?:from\s*["'`]socket\.io["'`]|require\s*\(\s*["'`]socket\.io["'`]\s*\))""",
    ignore_case=True,
)
SOCKETIO_CLIENT_IMPORT = Rx(
    r"""(?:from\s*["'`]socket\.io-client["'`]|require\s*\(\s*["'`]socket\.io-client["'`]\s*\))""",
    ignore_case=True,
)
SOCKETIO_CLIENT_FACTORY = Rx(r"""\bio\s*\(""", ignore_case=True)

NEST_BLOCK = Rx(
    r"""@Controller\s*(?:\(([^)]*)\))?[\s\S]{0,500}?\bclass\s+\w+[\s\S]*?(?=@Controller\s*(?:\(|\s)|$)""",
    faster=r"""@Controller\s*(?:\(([^)]*)\))?[\s\S]{0,500}?\bclass\s+\w+(?:[^@]++|@(?!Controller\s*(?:\(|\s)))*+""",
)
# The start of a block, without the rest of it.
NEST_HEAD = Rx(r"""@Controller\s*(?:\(([^)]*)\))?[\s\S]{0,500}?\bclass\s+\w+""")
NEST_ROUTE = Rx(r"""@(Get|Post|Put|Patch|Delete|Options|Head)\s*(?:\(([^)]*)\))?""")
NEST_EVIDENCE = Rx(r"""@Controller\b""")
NEST_LOOSE_ROUTE = Rx(r"""@(?:Get|Post|Put|Patch|Delete|Options|Head)\b""")
QUOTED = Rx(r"""["'`]([^"'`]+)["'`]""")

WEBSOCKET_SERVER = Rx(
    r"""\bnew\s+(?:WebSocketServer|WebSocket\.Server)\s*\(|\bwss\.on\s*\(\s*["'`]connection["'`]""",
    ignore_case=True,
)
WEBSOCKET_CLIENT = Rx(r"""\bnew\s+WebSocket\s*\(\s*["'`]wss?:\/\/""", ignore_case=True)
WEBSOCKET_EVENT = Rx(
    r"""\b(?:wss|ws|socket|client)\.(?:on|addEventListener)\s*\(\s*["'`](connection|message|close|error|open)["'`]""",
    ignore_case=True,
)
WEBSOCKET_HANDLER = Rx(r"""\b(?:onmessage|onclose|onerror|onopen)\s*=""", ignore_case=True)
WEBSOCKET_HANDLER_NAME = Rx(r"""^on(\w+)""", ignore_case=True)

GRAPHQL_SERVER = Rx(r"""\b(?:graphqlHTTP|ApolloServer|GraphQLSchema|createYoga)\b""")
GRAPHQL_ENDPOINT = Rx(
    r"""\b(?:app|server|router)\.(?:use|post)\s*\(\s*["'`]([^"'`]+)["'`][\s\S]{0,200}?(?:graphqlHTTP|expressGraphQL|ApolloServer|createHandler|createYoga)""",
    ignore_case=True,
)
GRAPHQL_PATH_OPTION = Rx(r"""\b(?:path|endpoint)\s*:\s*["'`]([^"'`]+)["'`]""", ignore_case=True)
APOLLO = Rx(r"""\bApolloServer\b""")
# -----------------------------------------------------------------------------


def express(src: Source) -> Column:
    gate = mentions(src.lower, "express", "router") & EXPRESS_EVIDENCE.found_in(src.text)
    return routes("Express", gate, src.text, EXPRESS_ROUTE, method=2, path=3)


def fastify(src: Source) -> Column:
    gate = mentions(src.lower, "fastify") & FASTIFY_EVIDENCE.found_in(src.text)
    return routes("Fastify", gate, src.text, FASTIFY_ROUTE, method=2, path=3)


def socketio(src: Source) -> Column:
    """Events of Socket.IO servers and clients; a file may be both."""
    text, lower = src.text, src.lower
    server = (mentions(lower, "io.on") & SOCKETIO_CONNECTION.found_in(text)) | (
        mentions(lower, "socket.io")
        & SOCKETIO_SERVER_IMPORT.found_in(text)
        & SOCKETIO_NEW_SERVER.found_in(text)
    )
    client = (
        mentions(lower, "socket.io-client")
        & SOCKETIO_CLIENT_IMPORT.found_in(text)
        & SOCKETIO_CLIENT_FACTORY.found_in(text)
    )

    def side(role: str, first: Column, second: Column, directions: tuple[str, str]) -> Column:
        return let(
            first,
            lambda a: F.concat(
                event_rows("socketio", "Socket.IO", a, role, directions[0]),
                event_rows(
                    "socketio",
                    "Socket.IO",
                    F.array_except(second, a) if src.one_direction else second,
                    role,
                    directions[1],
                ),
            ),
        )

    heard = SOCKET_ON.all(text, 1)
    return F.concat(
        rows_if(server, side("server", heard, IO_EMIT.all(text, 1), ("incoming", "outgoing"))),
        rows_if(client, side("client", SOCKET_EMIT.all(text, 1), heard, ("outgoing", "incoming"))),
    )


def nestjs(src: Source) -> Column:
    """Routes of each controller under its prefix, else decorators anywhere."""

    def collect(block: Column, prefix: Column) -> Column:
        return F.transform(
            NEST_ROUTE.all(block),
            lambda m: call(
                F.upper(NEST_ROUTE.part(m, 1)),
                join_paths(prefix, QUOTED.part(NEST_ROUTE.part(m, 2), 1), strip_end=True),
            ),
        )

    in_blocks = F.flatten(
        F.transform(
            NEST_BLOCK.all(src.text),
            lambda b: let(
                QUOTED.part(NEST_HEAD.part(b, 1), 1), lambda prefix: collect(b, prefix)
            ),
        )
    )
    loose = strings_if(NEST_LOOSE_ROUTE.found_in(src.text), collect(src.text, F.lit("")))
    gate = mentions(src.text, "@nestjs/common") | (
        mentions(src.text, "@Controller") & NEST_EVIDENCE.found_in(src.text)
    )
    found = let(in_blocks, lambda c: F.when(F.size(c) > 0, c).otherwise(loose))
    return http_rows("NestJS", strings_if(gate, found))


def websocket(src: Source) -> Column:
    near = mentions(src.lower, "websocket", "wss.on")
    server = near & WEBSOCKET_SERVER.found_in(src.text)
    client = near & WEBSOCKET_CLIENT.found_in(src.text)
    named = F.concat(
        WEBSOCKET_EVENT.all(src.text, 1),
        F.transform(
            WEBSOCKET_HANDLER.all(src.text), lambda m: WEBSOCKET_HANDLER_NAME.part(m, 1)
        ),
    )

    def rows(is_server: Column, is_client: Column) -> Column:
        role = (
            F.when(is_server & is_client, "unknown").when(is_server, "server").otherwise("client")
        )
        events = let(
            named,
            lambda e: F.when(
                is_server & (F.size(e) == 0), F.array(F.lit("connection"))
            ).otherwise(e),
        )
        return event_rows("websocket", "WebSocket", strings_if(is_server | is_client, events), role)

    return F.when(
        near, let(F.struct(server.alias("s"), client.alias("c")), lambda x: rows(x["s"], x["c"]))
    ).otherwise(no_rows())


def graphql(src: Source) -> Column:
    text = src.text
    gate = mentions(text, "express-graphql") | (
        mentions(text, "graphqlHTTP", "ApolloServer", "GraphQLSchema", "createYoga")
        & GRAPHQL_SERVER.found_in(text)
    )
    paths = let(
        F.concat(GRAPHQL_ENDPOINT.all(text, 1), GRAPHQL_PATH_OPTION.all(text, 1)),
        lambda p: F.when(F.size(p) == 0, F.array(F.lit("/graphql"))).otherwise(p),
    )
    framework = F.when(APOLLO.found_in(text), "Apollo Server").otherwise("GraphQL")
    calls = F.transform(paths, lambda p: call(F.lit("POST"), p))
    return rows_if(gate, let(framework, lambda f: http_rows(f, calls, protocol="graphql")))
