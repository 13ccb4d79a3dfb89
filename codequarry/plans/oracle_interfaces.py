"""Interface rules restated in DuckDB SQL, to check the Spark results against.

Only the patterns are shared with the engine: they are fixed values. How their
matches become rows is written anew, over rows instead of arrays where it can.
"""

from __future__ import annotations

from codequarry.functions.patterns import Rx
from codequarry.rules import DETECTORS, csharp, dart, elixir, go, java, javascript, kotlin
from codequarry.rules import php, python, ruby, rust, scala, swift
from codequarry.plans.oracle_base import CODE, found, groups, literal, matches, one_of, quoted, rx

COLUMNS = "type, protocol, framework, role, method, path, event, direction"


def _http(source: str, framework: str, protocol: str = "'rest'") -> str:
    """Rows of (project, file, language, ord, method, path) as interfaces."""
    return f"""SELECT project, file, language, ord, 'http' AS type, {protocol} AS protocol,
  {framework} AS framework, 'server' AS role, method, path,
  CAST(NULL AS VARCHAR) AS event, CAST(NULL AS VARCHAR) AS direction FROM ({source})"""


def _event(
    source: str,
    protocol: str,
    framework: str,
    role: str = "'server'",
    direction: str = "CAST(NULL AS VARCHAR)",
) -> str:
    """Rows of (project, file, language, ord, event) as interfaces."""
    return f"""SELECT project, file, language, ord, 'realtime' AS type, '{protocol}' AS protocol,
  '{framework}' AS framework, {role} AS role, CAST(NULL AS VARCHAR) AS method,
  CAST(NULL AS VARCHAR) AS path, event, {direction} AS direction FROM ({source})"""


def _code(languages: str, gate: str) -> str:
    names = ", ".join(quoted(x) for x in languages.split())
    return f"SELECT * FROM code WHERE language IN ({names}) AND ({gate})"


def _routes(
    languages: str,
    gate: str,
    framework: str,
    pattern: Rx,
    method: int = 1,
    path: int = 2,
    any_verbs: str = "''",
) -> str:
    code = _code(languages, gate)
    return _http(
        f"""SELECT project, file, language, ord,
  CASE WHEN upper(verb) IN ({any_verbs}) THEN 'ANY' ELSE upper(verb) END AS method, path
  FROM (SELECT project, file, language, unnest({groups(pattern, method)}) AS verb,
    unnest({groups(pattern, path)}) AS path,
    generate_subscripts({groups(pattern, method)}, 1) AS ord FROM ({code}))""",
        quoted(framework),
    )


def _listed(languages: str, gate: str, values: str, column: str = "event", extra: str = "") -> str:
    """One row per element of a list expression over the code that passes the gate."""
    return f"""SELECT project, file, language, {extra} unnest(vs) AS {column},
  generate_subscripts(vs, 1) AS ord
  FROM (SELECT *, {values} AS vs FROM ({_code(languages, gate)}))"""


def _or_else(values: str, fallback: str) -> str:
    return f"CASE WHEN len({values}) = 0 THEN {fallback} ELSE {values} END"


_ANY = "'ANY' AS method,"
_JS = "javascript typescript"


def _joined(prefix: str, path: str, strip_end: bool) -> str:
    if not strip_end:
        return f"regexp_replace('/' || {prefix} || '/' || {path}, '/+', '/', 'g')"
    both = f"regexp_replace('/' || {prefix} || '/' || {path}, '/+', '/', 'g')"
    return f"coalesce(nullif(rtrim({both}, '/'), ''), '/')"


def _express() -> str:
    return _routes(
        _JS, found(javascript.EXPRESS_EVIDENCE), "Express", javascript.EXPRESS_ROUTE, 2, 3
    )


def _fastify() -> str:
    return _routes(
        _JS, found(javascript.FASTIFY_EVIDENCE), "Fastify", javascript.FASTIFY_ROUTE, 2, 3
    )


def _socketio() -> str:
    j = javascript
    server = (
        f"{found(j.SOCKETIO_CONNECTION)} OR "
        f"({found(j.SOCKETIO_NEW_SERVER)} AND {found(j.SOCKETIO_SERVER_IMPORT)})"
    )
    client = f"{found(j.SOCKETIO_CLIENT_IMPORT)} AND {found(j.SOCKETIO_CLIENT_FACTORY)}"
    parts = []
    for n, (gate, pattern, role, direction) in enumerate(
        (
            (server, j.SOCKET_ON, "server", "incoming"),
            (server, j.IO_EMIT, "server", "outgoing"),
            (client, j.SOCKET_EMIT, "client", "outgoing"),
            (client, j.SOCKET_ON, "client", "incoming"),
        )
    ):
        rows = _listed(_JS, gate, groups(pattern, 1))
        shifted = f"SELECT * REPLACE (ord + {n} * 1000000 AS ord) FROM ({rows})"
        parts.append(
            _event(shifted, "socketio", "Socket.IO", quoted(role), quoted(direction))
        )
    return " UNION ALL ".join(parts)


def _nestjs() -> str:
    j = javascript
    # Mark every place a block must end at, then let blocks run up to a mark.
    marked = r"regexp_replace(content, '(@Controller[(\s])', chr(1) || '\1', 'g')"
    block = Rx(
        r"@Controller\s*(?:\(([^)]*)\))?(?:\x01?[^\x01]){0,500}?\bclass\s+\w+[^\x01]*"
    )
    gate = f"contains(content, '@nestjs/common') OR {found(j.NEST_EVIDENCE)}"
    routes = f"""SELECT *, unnest({groups(j.NEST_ROUTE, 1, 'block')}) AS verb,
      unnest({groups(j.NEST_ROUTE, 2, 'block')}) AS args,
      block_ord * 10000 + generate_subscripts({groups(j.NEST_ROUTE, 1, 'block')}, 1) AS ord"""
    blocks = f"""{routes}, regexp_extract(coalesce(head, ''), {rx(j.QUOTED)}, 1)
      AS prefix FROM (SELECT project, file, language, unnest({groups(block, 0, marked)}) AS block,
        unnest({groups(block, 1, marked)}) AS head,
        generate_subscripts({groups(block, 0, marked)}, 1) AS block_ord
        FROM ({_code(_JS, gate)}))"""
    loose = f"""{routes}, '' AS prefix FROM (SELECT *, content AS block, 0 AS block_ord
      FROM ({_code(_JS, gate)}) WHERE {found(j.NEST_LOOSE_ROUTE)})"""
    keys = "project, file, language, ord, verb, args, prefix"
    path = _joined("prefix", f"regexp_extract(coalesce(args, ''), {rx(j.QUOTED)}, 1)", True)
    return _http(
        f"""SELECT project, file, language, ord, upper(verb) AS method, {path} AS path
  FROM (WITH b AS ({blocks})
    SELECT {keys} FROM b UNION ALL
    SELECT {keys} FROM ({loose}) AS l
    WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.project = l.project AND b.file = l.file))""",
        "'NestJS'",
    )


def _websocket() -> str:
    j = javascript
    s, c = found(j.WEBSOCKET_SERVER), found(j.WEBSOCKET_CLIENT)
    handlers = (
        f"[trim(replace(x[3:], '=', '')) FOR x IN {groups(j.WEBSOCKET_HANDLER, 0)}]"
    )
    named = f"list_concat({groups(j.WEBSOCKET_EVENT, 1)}, {handlers})"
    events = f"CASE WHEN len({named}) = 0 AND {s} THEN ['connection'] ELSE {named} END"
    role = f"CASE WHEN {s} AND {c} THEN 'unknown' WHEN {s} THEN 'server' ELSE 'client' END"
    rows = _listed(_JS, f"{s} OR {c}", events, extra=f"{role} AS side,")
    return _event(rows, "websocket", "WebSocket", role="side")


def _graphql() -> str:
    j = javascript
    gate = f"contains(content, 'express-graphql') OR {found(j.GRAPHQL_SERVER)}"
    paths = f"list_concat({groups(j.GRAPHQL_ENDPOINT, 1)}, {groups(j.GRAPHQL_PATH_OPTION, 1)})"
    kind = f"CASE WHEN {found(j.APOLLO)} THEN 'Apollo Server' ELSE 'GraphQL' END AS kind,"
    rows = _listed(
        _JS, gate, _or_else(paths, "['/graphql']"), "path", f"{kind} 'POST' AS method,"
    )
    return _http(rows, "kind", "'graphql'")


def _flask() -> str:
    p = python
    words = f"regexp_extract_all(regexp_extract(args, {rx(p.FLASK_METHODS)}, 1), {rx(p.QUOTED_WORD)}, 1)"
    own = "CASE WHEN lower(verb) = 'route' THEN 'GET' ELSE verb END"
    methods = _or_else(words, f"[{own}]")
    return _http(
        f"""SELECT project, file, language, i * 10000 + generate_subscripts(ms, 1) AS ord,
  upper(unnest(ms)) AS method, path
  FROM (SELECT *, {methods} AS ms, regexp_extract(args, {rx(p.FLASK_PATH)}, 1) AS path
    FROM (SELECT project, file, language, unnest({groups(p.FLASK_DECORATOR, 1)}) AS verb,
      unnest({groups(p.FLASK_DECORATOR, 2)}) AS args,
      generate_subscripts({groups(p.FLASK_DECORATOR, 1)}, 1) AS i
      FROM ({_code("python", found(p.FLASK_EVIDENCE))}))) WHERE path <> ''""",
        "'Flask'",
    )


def _fastapi() -> str:
    p = python
    code = _code("python", found(p.FASTAPI_EVIDENCE))
    names = f"""SELECT project, file, unnest(['app', 'router']) AS name, '' AS prefix, 0 AS n
      FROM ({code})
      UNION ALL SELECT project, file, unnest({groups(p.FASTAPI_APP, 1)}), '', 1 FROM ({code})
      UNION ALL SELECT project, file, unnest({groups(p.FASTAPI_ROUTER, 1)}),
        regexp_extract(unnest({groups(p.FASTAPI_ROUTER, 2)}), {rx(p.FASTAPI_PREFIX)}, 1),
        1 + generate_subscripts({groups(p.FASTAPI_ROUTER, 1)}, 1) FROM ({code})"""
    return _http(
        f"""SELECT r.project, r.file, language, ord, upper(verb) AS method,
  {_joined("d.prefix", "r.path", False)} AS path
  FROM (SELECT project, file, language, unnest({groups(p.FASTAPI_ROUTE, 1)}) AS name,
      unnest({groups(p.FASTAPI_ROUTE, 2)}) AS verb, unnest({groups(p.FASTAPI_ROUTE, 3)}) AS path,
      generate_subscripts({groups(p.FASTAPI_ROUTE, 1)}, 1) AS ord FROM ({code})) AS r
  JOIN (SELECT project, file, name, arg_max(prefix, n) AS prefix
    FROM ({names}) GROUP BY ALL) AS d
  ON r.project = d.project AND r.file = d.file AND r.name = d.name""",
        "'FastAPI'",
    )


def _django() -> str:
    paths = f"list_concat({groups(python.DJANGO_PATH, 1)}, {groups(python.DJANGO_RE_PATH, 1)})"
    return _http(
        _listed("python", found(python.DJANGO_EVIDENCE), paths, "path", _ANY), "'Django'"
    )


def _flask_socketio() -> str:
    p = python
    events = f"list_concat({groups(p.FLASK_SOCKETIO_ON, 2)}, {groups(p.FLASK_SOCKETIO_EMIT, 2)})"
    rows = _listed("python", found(p.FLASK_SOCKETIO_EVIDENCE), events)
    return _event(rows, "socketio", "Flask-SocketIO")


def _django_channels() -> str:
    rows = _listed("python", found(python.CHANNELS_EVIDENCE), "['websocket']")
    return _event(rows, "websocket", "Django Channels")


def _grpc(languages: str, gate: str, names: str, fallback: str = "true") -> str:
    stand_in = f"CASE WHEN {fallback} THEN ['grpc'] ELSE [] END"
    return _event(_listed(languages, gate, _or_else(names, stand_in)), "grpc", "gRPC")


def _spring() -> str:
    j = java
    mapping = Rx(
        r"""@(GetMapping|PostMapping|PutMapping|PatchMapping|DeleteMapping|RequestMapping)\s*(?:\(([^)]*)\))?"""
    )
    code = _code("java kotlin", found(j.SPRING_EVIDENCE))

    def path_of(args: str) -> str:
        return (
            f"coalesce(nullif(regexp_extract({args}, {rx(j.SPRING_NAMED_PATH)}, 1), ''), "
            f"regexp_extract({args}, {rx(j.QUOTED)}, 1))"
        )

    prefix = path_of(f"regexp_extract(content, {rx(j.SPRING_CLASS)}, 1)")
    listed = f"regexp_extract_all(args, {rx(j.SPRING_METHOD)}, 1)"
    methods = (
        f"CASE WHEN name <> 'RequestMapping' THEN [upper(replace(name, 'Mapping', ''))] "
        f"ELSE {_or_else(listed, '[' + quoted('ANY') + ']')} END"
    )
    ahead = "string_split(substr(content, start + 1, 300), '{')[1]"
    return _http(
        f"""SELECT project, file, language, i * 10000 + generate_subscripts(ms, 1) AS ord,
  unnest(ms) AS method, {_joined("prefix", "own", False)} AS path
  FROM (SELECT *, {methods} AS ms, {prefix} AS prefix, {path_of("args")} AS own
    FROM (SELECT *, regexp_extract("full", {rx(mapping)}, 1) AS name,
      regexp_extract("full", {rx(mapping)}, 2) AS args FROM ({matches(mapping, code)})))
  WHERE NOT (name = 'RequestMapping'
    AND regexp_matches({ahead}, {rx(j.SPRING_TYPE_WORD)}))""",
        "'Spring'",
    )


def _annotated(languages: str, gate: str, block: Rx, verb: Rx) -> str:
    """(…, block, ord, method) for every verb of every annotation block."""
    return f"""SELECT *, i * 10000 + generate_subscripts(ms, 1) AS ord, unnest(ms) AS method
  FROM (SELECT *, regexp_extract_all(block, {rx(verb)}, 1) AS ms
    FROM (SELECT *, unnest({groups(block, 1)}) AS block,
      generate_subscripts({groups(block, 1)}, 1) AS i FROM ({_code(languages, gate)})))"""


def _jax_rs() -> str:
    j = java
    gate = f"{found(j.JAXRS_PATH_ANNOTATION)} AND ({found(j.JAXRS_PACKAGE, j.JAXRS_ANNOTATION)})"
    rows = _annotated("java", gate, j.JAXRS_METHOD_BLOCK, j.JAXRS_VERB)
    own = f"coalesce(regexp_extract_all(block, {rx(j.JAXRS_PATH)}, 1)[-1], '')"
    prefix = f"regexp_extract(content, {rx(j.JAXRS_CLASS_PATH)}, 1)"
    return _http(
        f"SELECT *, {_joined(prefix, own, True)} AS path FROM ({rows})",
        "CASE WHEN contains(content, 'jakarta.ws.rs') THEN 'Jakarta REST' ELSE 'JAX-RS' END",
    )


def _spring_websocket() -> str:
    j = java
    pattern = j.SPRING_WEBSOCKET_EVENT
    code = _code("java kotlin", found(j.SPRING_WEBSOCKET_EVIDENCE))
    return _event(
        f"""SELECT project, file, language, ord, CASE WHEN name <> '' THEN name
    WHEN kind = 'SendTo' THEN 'send' ELSE 'message' END AS event
  FROM (SELECT project, file, language, unnest({groups(pattern, 1)}) AS kind,
    unnest({groups(pattern, 2)}) AS name,
    generate_subscripts({groups(pattern, 1)}, 1) AS ord FROM ({code}))""",
        "websocket",
        "Spring WebSocket",
    )


def _grpc_java() -> str:
    services = (
        rf"[regexp_replace(regexp_replace(x, '.*\.', ''), 'ImplBase$', '') "
        rf"FOR x IN {groups(java.GRPC_BASE, 1)}]"
    )
    names = f"list_concat({services}, {groups(java.GRPC_METHOD, 1)})"
    return _grpc("java", found(java.GRPC_EVIDENCE), names)


def _aspnet_core() -> str:
    c = csharp
    gate = found(c.ASPNET_EVIDENCE)
    mapped = f"""SELECT project, file, language, upper(unnest({groups(c.ASPNET_MAP, 1)})) AS method,
      unnest({groups(c.ASPNET_MAP, 2)}) AS path,
      generate_subscripts({groups(c.ASPNET_MAP, 1)}, 1) AS ord FROM ({_code("csharp", gate)})"""
    args = f"regexp_extract(coalesce(args, ''), {rx(c.STRING)}, 1)"
    attributed = f"""SELECT project, file, language, upper(replace(name, 'Http', '')) AS method,
      {_joined("prefix", args, True)} AS path, ord + 1000000 AS ord
      FROM (SELECT *, regexp_extract(content, {rx(c.ASPNET_CLASS_ROUTE)}, 1) AS prefix,
        unnest({groups(c.ASPNET_ATTRIBUTE, 1)}) AS name,
        unnest({groups(c.ASPNET_ATTRIBUTE, 2)}) AS args,
        generate_subscripts({groups(c.ASPNET_ATTRIBUTE, 1)}, 1) AS ord
        FROM ({_code("csharp", gate)}))"""
    return _http(f"({mapped}) UNION ALL ({attributed})", "'ASP.NET Core'")


def _signalr() -> str:
    c = csharp
    gate = found(c.SIGNALR_EVIDENCE)
    lifecycle = ", ".join(quoted(x) for x in c.SIGNALR_LIFECYCLE)
    methods = f"[x FOR x IN {groups(c.SIGNALR_METHOD, 1)} IF x NOT IN ({lifecycle})]"
    served = _listed("csharp", gate, f"list_concat({groups(c.SIGNALR_SEND, 1)}, {methods})")
    heard = _listed("csharp", gate, groups(c.SIGNALR_CLIENT_ON, 1))
    later = f"SELECT * REPLACE (ord + 1000000 AS ord) FROM ({heard})"
    return (
        _event(served, "signalr", "SignalR")
        + " UNION ALL "
        + _event(later, "signalr", "SignalR", "'client'")
    )


def _grpc_csharp() -> str:
    names = f"list_concat({groups(csharp.GRPC_BASE, 1)}, {groups(csharp.GRPC_OVERRIDE, 1)})"
    return _grpc("csharp", found(csharp.GRPC_EVIDENCE), names)


def _net_http() -> str:
    paths = f"list_concat({groups(go.NET_HTTP_HANDLE_FUNC, 1)}, {groups(go.NET_HTTP_HANDLE, 1)})"
    return _http(_listed("go", found(go.NET_HTTP_EVIDENCE), paths, "path", _ANY), "'net/http'")


def _go_router(framework: str, package: str, new: Rx, pattern: Rx) -> str:
    return _routes("go", f"{literal(package)} OR {found(new)}", framework, pattern)


def _grpc_go() -> str:
    gate = f"{literal(go.GRPC_IMPORT)} OR {found(go.GRPC_NEW, go.GRPC_REGISTER)}"
    return _grpc("go", gate, groups(go.GRPC_REGISTER, 1))


def _websocket_go() -> str:
    gate = f"{one_of(go.WEBSOCKET_IMPORTS)} OR {found(go.WEBSOCKET_USE)}"
    event = f"[CASE WHEN {found(go.WEBSOCKET_READ)} THEN 'message' ELSE 'websocket' END]"
    return _event(_listed("go", gate, event), "websocket", "WebSocket")


def _laravel() -> str:
    gate = f"{literal(php.LARAVEL_FACADE)} OR {found(php.LARAVEL_CALL)}"
    return _routes("php", gate, "Laravel", php.LARAVEL_ROUTE, any_verbs="'ANY', 'MATCH'")


def _symfony() -> str:
    p = php
    args = f"list_concat({groups(p.SYMFONY_ATTRIBUTE, 1)}, {groups(p.SYMFONY_ANNOTATION, 1)})"
    words = f"regexp_extract_all(regexp_extract(args, {rx(p.SYMFONY_METHODS)}, 1), {rx(p.QUOTED_WORD)}, 1)"
    return _http(
        f"""SELECT project, file, language, i * 10000 + generate_subscripts(ms, 1) AS ord,
  upper(unnest(ms)) AS method, path
  FROM (SELECT *, {_or_else(words, "['ANY']")} AS ms, regexp_extract(args, {rx(p.QUOTED)}, 1) AS path
    FROM (SELECT project, file, language, unnest({args}) AS args,
      generate_subscripts({args}, 1) AS i FROM ({_code("php", found(p.SYMFONY_EVIDENCE))})))
  WHERE path <> ''""",
        "'Symfony'",
    )


def _axum() -> str:
    r = rust
    ms = f"[upper(x) FOR x IN regexp_extract_all(rest, {rx(r.AXUM_METHOD)}, 1)]"
    return _http(
        f"""SELECT project, file, language, i * 10000 + generate_subscripts(ms, 1) AS ord,
  unnest(ms) AS method, path
  FROM (SELECT *, {ms} AS ms
    FROM (SELECT project, file, language, unnest({groups(r.AXUM_ROUTE, 1)}) AS path,
      unnest({groups(r.AXUM_ROUTE, 2)}) AS rest,
      generate_subscripts({groups(r.AXUM_ROUTE, 1)}, 1) AS i
      FROM ({_code("rust", found(r.AXUM_EVIDENCE))})))""",
        "'Axum'",
    )


def _windowed(
    languages: str, gate: str, framework: str, pattern: Rx, method: Rx, before: int
) -> str:
    window = (
        f"substr(content, greatest(start - {before}, 0) + 1, "
        f"start + 300 - greatest(start - {before}, 0))"
    )
    ms = f"[upper(x) FOR x IN regexp_extract_all({window}, {rx(method)}, 1)]"
    own = f"regexp_extract(\"full\", {rx(pattern)}, 1)"
    return _http(
        f"""SELECT project, file, language, i * 10000 + generate_subscripts(ms, 1) AS ord,
  unnest(ms) AS method, CASE WHEN own LIKE '/%' THEN own ELSE '/' || own END AS path
  FROM (SELECT *, {_or_else(ms, "['ANY']")} AS ms, {own} AS own
    FROM ({matches(pattern, _code(languages, gate))}))""",
        quoted(framework),
    )


def _warp() -> str:
    gate = literal(rust.WARP_EVIDENCE)
    return _windowed("rust", gate, "Warp", rust.WARP_PATH, rust.WARP_METHOD, rust.WARP_WINDOW[0])


def _akka_http() -> str:
    gate = literal(scala.AKKA_EVIDENCE)
    before = scala.AKKA_WINDOW[0]
    return _windowed("scala", gate, "Akka HTTP", scala.AKKA_PATH, scala.AKKA_METHOD, before)


def _vapor() -> str:
    s = swift
    segments = f"array_to_string(regexp_extract_all(args, {rx(s.QUOTED)}, 1), '/')"
    return _http(
        f"""SELECT project, file, language, ord, CASE WHEN upper(verb) <> 'ON' THEN upper(verb)
    ELSE coalesce(nullif(upper(regexp_extract(args, {rx(s.VAPOR_METHOD)}, 1)), ''), 'ANY') END
    AS method, regexp_replace('/' || coalesce({segments}, ''), '/+', '/', 'g') AS path
  FROM (SELECT project, file, language, unnest({groups(s.VAPOR_ROUTE, 1)}) AS verb,
    unnest({groups(s.VAPOR_ROUTE, 2)}) AS args,
    generate_subscripts({groups(s.VAPOR_ROUTE, 1)}, 1) AS ord
    FROM ({_code("swift", found(s.VAPOR_EVIDENCE))}))""",
        "'Vapor'",
    )


def _dart_frog() -> str:
    d = dart
    gate = (
        f"({literal(d.DART_FROG_PACKAGE)} OR {found(d.DART_FROG_HANDLER)}) "
        "AND contains('/' || file, '/routes/')"
    )
    place = "regexp_replace(string_split('/' || file, '/routes/')[-1], '(?i)\\.dart$', '')"
    names = (
        rf"[regexp_replace(s, '^\[(.+)\]$', ':\1') FOR s IN string_split({place}, '/') "
        "IF s NOT IN ('', 'index')]"
    )
    route = f"'/' || coalesce(array_to_string({names}, '/'), '') AS path,"
    methods = f"[upper(x) FOR x IN {groups(d.DART_FROG_METHOD, 1)}]"
    return _http(
        _listed("dart", gate, _or_else(methods, "['ANY']"), "method", route), "'Dart Frog'"
    )


def _play() -> str:
    s = scala
    rows = _annotated("scala", one_of(s.PLAY_EVIDENCE), s.PLAY_BLOCK, s.PLAY_VERB)
    path = f"regexp_extract(block, {rx(s.PLAY_PATH)}, 1)"
    return _http(
        f"SELECT *, {path} AS path FROM ({rows}) WHERE {path} <> ''", "'Play Framework'"
    )


DETECTOR_SQL = {
    "express": _express(),
    "socketio-js": _socketio(),
    "fastify": _fastify(),
    "nestjs": _nestjs(),
    "websocket-js": _websocket(),
    "graphql-js": _graphql(),
    "flask": _flask(),
    "fastapi": _fastapi(),
    "django": _django(),
    "flask-socketio": _flask_socketio(),
    "django-channels": _django_channels(),
    "grpc-python": _grpc(
        "python",
        found(python.GRPC_EVIDENCE),
        f"list_concat({groups(python.GRPC_ADD_SERVICER, 1)}, {groups(python.GRPC_CLASS, 1)})",
        found(python.GRPC_SERVER),
    ),
    "spring": _spring(),
    "jax-rs": _jax_rs(),
    "spring-websocket": _spring_websocket(),
    "grpc-java": _grpc_java(),
    "aspnet-core": _aspnet_core(),
    "signalr": _signalr(),
    "grpc-csharp": _grpc_csharp(),
    "go-net-http": _net_http(),
    "gin": _go_router("Gin", go.GIN_IMPORT, go.GIN_NEW, go.UPPER_ROUTE),
    "echo": _go_router("Echo", go.ECHO_IMPORT, go.ECHO_NEW, go.UPPER_ROUTE),
    "fiber": _go_router("Fiber", go.FIBER_IMPORT, go.FIBER_NEW, go.TITLE_ROUTE),
    "chi": _go_router("Chi", go.CHI_IMPORT, go.CHI_NEW, go.TITLE_ROUTE),
    "grpc-go": _grpc_go(),
    "websocket-go": _websocket_go(),
    "laravel": _laravel(),
    "symfony": _symfony(),
    "slim": _routes(
        "php", found(php.SLIM_EVIDENCE), "Slim", php.SLIM_ROUTE, any_verbs="'ANY', 'MAP'"
    ),
    "rails": _routes("ruby", found(ruby.RAILS_EVIDENCE), "Rails", ruby.RAILS_ROUTE),
    "sinatra": _routes("ruby", found(ruby.SINATRA_EVIDENCE), "Sinatra", ruby.SINATRA_ROUTE),
    "actix-web": _routes("rust", found(rust.ACTIX_EVIDENCE), "Actix Web", rust.ATTRIBUTE_ROUTE),
    "axum": _axum(),
    "rocket": _routes("rust", found(rust.ROCKET_EVIDENCE), "Rocket", rust.ATTRIBUTE_ROUTE),
    "warp": _warp(),
    "grpc-rust": _grpc("rust", found(rust.GRPC_EVIDENCE), groups(rust.GRPC_SERVICE, 1)),
    "ktor": _routes("kotlin", found(kotlin.KTOR_EVIDENCE), "Ktor", kotlin.KTOR_ROUTE),
    "vapor": _vapor(),
    "shelf": _routes("dart", found(dart.SHELF_EVIDENCE), "Shelf", dart.SHELF_ROUTE),
    "dart-frog": _dart_frog(),
    "play-framework": _play(),
    "akka-http": _akka_http(),
    "phoenix": _routes("elixir", found(elixir.PHOENIX_EVIDENCE), "Phoenix", elixir.PHOENIX_ROUTE),
}


def _kept_first(rows: str, with_direction: bool) -> str:
    """Distinct rows per file, renumbered in rule order then text order."""
    key = "project, file, language, type, protocol, framework, role, method, path, event"
    key += ", direction" if with_direction else ""
    return f"""SELECT project, file, language, {COLUMNS},
  CAST(row_number() OVER (PARTITION BY project, file ORDER BY d, ord) - 1 AS INTEGER) AS ord
FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY d, ord) AS seen FROM ({rows}))
WHERE seen = 1"""


def _numbered(name: str, d: int) -> str:
    columns = f"project, file, language, ord, {COLUMNS}"
    return f"SELECT {d} AS d, {columns} FROM ({DETECTOR_SQL[name]})"


def _all() -> str:
    return " UNION ALL ".join(_numbered(det.name, d) for d, det in enumerate(DETECTORS))


def detector_rows(name: str) -> str:
    return f"{CODE} {_kept_first(_numbered(name, 0), with_direction=False)}"


def discovered() -> str:
    """Body of a query for all discovered interfaces, to follow the CODE tables."""
    return _kept_first(_all(), with_direction=False)


def full() -> str:
    return _kept_first(_all(), with_direction=True)
