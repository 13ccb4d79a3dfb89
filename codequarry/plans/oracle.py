"""The registered queries restated in DuckDB SQL."""

from __future__ import annotations

from codequarry.functions.patterns import Rx
from codequarry.operators import facts, flows, mapping
from codequarry.plans.oracle_base import (
    CODE,
    CORPUS,
    DISPLAY_LANGUAGE,
    EXTENSION,
    groups,
    matches,
    newlines,
    quoted,
    rx,
)
from codequarry.plans.oracle_interfaces import COLUMNS, detector_rows, discovered, full
from codequarry.rules import DETECTORS
from codequarry.rules.javascript import EXPRESS_ROUTE
from codequarry.rules.technologies import (
    BACKEND_RUNTIME,
    ENTRY_POINTS,
    MANAGERS,
    MANIFESTS,
    RUNTIMES,
    TECHNOLOGIES,
)

_BASENAME = "regexp_extract(path, '[^/]*$')"


def _joined(values: str) -> str:
    """A list as one sorted string."""
    return f"coalesce(array_to_string(list_sort({values}), '|'), '')"


def _occurrences(text: str, query: str) -> str:
    n = f"(length(lower({text})) - length(replace(lower({text}), '{query}', ''))) // {len(query)}"
    return f"CAST({n} AS INTEGER)"


def _in(values: list[str]) -> str:
    return ", ".join(quoted(v) for v in values).join("()")


def _inventory() -> dict[str, str]:
    scanned = "SELECT project, path FROM files"
    sizes = "octet_length(encode(content)) AS size"
    prefixes = """SELECT DISTINCT project, array_to_string(parts[1:n], '/') AS directory
  FROM (SELECT project, parts, unnest(range(1, len(parts))) AS n
    FROM (SELECT project, string_split(path, '/') AS parts FROM {source}))"""
    info = f"SELECT project, path, 'file' AS type, {sizes}, {EXTENSION} AS extension FROM corpus"
    entry = f"SELECT project, path FROM files WHERE {_BASENAME} IN {_in(ENTRY_POINTS)}"
    names = """SELECT DISTINCT project, parts[{d}] AS name,
  CASE WHEN len(parts) > {d} THEN 'directory' ELSE 'file' END AS type
  FROM (SELECT project, string_split(path, '/') AS parts FROM corpus WHERE {where})"""
    return {
        "scan_files": f"{CORPUS} SELECT project, path, {sizes}, md5(content) AS digest FROM files",
        "file_inventory": f"{CORPUS} {scanned}",
        "directory_inventory": f"{CORPUS} {prefixes.format(source='files')}",
        "directory_info": f"""{CORPUS} SELECT project, directory AS path, 'directory' AS type
  FROM ({prefixes.format(source='corpus')})""",
        "list_root": f"{CORPUS} {names.format(d=1, where='true')}",
        "list_directory": f"""{CORPUS} {names.format(d=2, where="path LIKE 'apps/%'")}""",
        "file_info": f"{CORPUS} {info}",
        "read_files": f"""{CORPUS} SELECT project, path, content FROM corpus
  WHERE (project, path) IN ({entry})""",
        "scoped_scan": f"{CORPUS} SELECT project, path FROM corpus WHERE path LIKE 'docs/dist/%'",
        "decode_text": """SELECT page_id, md5(chr(65533) || left(html, length(html) // 2) || chr(65533)
  || substr(html, length(html) // 2 + 1) || repeat(chr(65533), 3) || 'A' || chr(65533)) AS digest
  FROM pages""",
        "json_rows": f"""{CORPUS} SELECT '{{"project":' || to_json(project) || ',"path":' ||
  to_json(path) || ',"type":"file","size":' || size || ',"extension":' || to_json(extension)
  || '}}' AS json FROM ({info})""",
        "search_files": f"""{CORPUS} SELECT project, path, matches FROM (
  SELECT project, path, {_occurrences("content", "order")} AS matches FROM files)
  WHERE matches > 0""",
        "search_subtree": f"""{CORPUS} SELECT project, path, matches FROM (
  SELECT project, path, {_occurrences("content", "await")} AS matches FROM files
  WHERE path LIKE 'api/src/%') WHERE matches > 0""",
        "search_documents": f"""SELECT doc_id, matches FROM (
  SELECT doc_id, {_occurrences("text", "tion")} AS matches FROM documents) WHERE matches > 0""",
        "search_pages": f"""SELECT page_id, matches FROM (
  SELECT page_id, {_occurrences("html", "</p>")} AS matches FROM pages) WHERE matches > 0""",
        "file_languages": f"""{CODE} SELECT c.project, c.file, c.language AS interface_language,
  f.language AS flow_language, f.display_language
  FROM code AS c LEFT JOIN (SELECT *, {DISPLAY_LANGUAGE.replace("path,", "file,")}
    AS display_language FROM flow) AS f
  ON c.project = f.project AND c.file = f.file""",
    }


def _interfaces() -> dict[str, str]:
    routes = f"""SELECT project, path AS file,
  upper(unnest({groups(EXPRESS_ROUTE, 2)})) AS method,
  unnest({groups(EXPRESS_ROUTE, 3)}) AS route,
  CAST(generate_subscripts({groups(EXPRESS_ROUTE, 2)}, 1) - 1 AS INTEGER) AS ord
  FROM files WHERE regexp_matches(path, '[.](js|mjs|cjs)$')"""
    named = {f"iface_{d.name.replace('-', '_')}": detector_rows(d.name) for d in DETECTORS}
    return {
        **named,
        "discover_interfaces": f"{CODE} {discovered()}",
        "interfaces_full": f"{CODE} {full()}",
        "interface_count": f"""{CODE}, found AS ({discovered()})
  SELECT project, coalesce(n, 0) AS count
  FROM (SELECT DISTINCT project FROM code WHERE language IS NOT NULL)
  LEFT JOIN (SELECT project, count(*) AS n FROM found GROUP BY project) USING (project)""",
        "detect_routes": f"{CORPUS} {routes}",
    }


def _functions() -> str:
    """(project, file, language, name, line), distinct."""
    return " UNION ".join(
        f"""SELECT project, file, language, regexp_extract("full", {rx(p)}, 1) AS name, line
  FROM ({matches(p, f"SELECT * FROM flow WHERE language = '{language}'")})"""
        for language, patterns in facts.FUNCTIONS.items()
        for p in patterns
    )


def _imports() -> str:
    rows = " UNION ".join(
        f"""SELECT project, file, regexp_extract("full", {rx(p)}, 1) AS source, line
  FROM ({matches(p, "SELECT * FROM flow")})"""
        for p in facts.IMPORTS
    )
    kinds = " ".join(
        f"WHEN {' OR '.join(f'contains(lower(source), {quoted(w)})' for w in words)} THEN '{kind}'"
        for kind, words in facts.IMPORT_KINDS
    )
    return f"""SELECT project, file, source, CASE {kinds}
  ELSE '{facts.OTHER_IMPORT_KIND}' END AS kind, line FROM ({rows})"""


def _db_operations() -> str:
    def rows(pattern: Rx, kind: str, target: str, group: int) -> str:
        return f"""SELECT project, file, '{kind}' AS kind, {target} AS target,
  regexp_extract("full", {rx(pattern)}, {group}) AS operation, line
  FROM ({matches(pattern, "SELECT * FROM flow")})"""

    def first(pattern: Rx) -> str:
        return f'regexp_extract("full", {rx(pattern)}, 1)'

    return " UNION ".join(
        (
            rows(facts.ORM_CALL, "orm", first(facts.ORM_CALL), 2),
            rows(facts.QUERY_CALL, "database", first(facts.QUERY_CALL), 2),
            rows(facts.CONNECTION_CALL, "database", "'database'", 1),
        )
    )


def _external_apis() -> str:
    def rows(client: str, pattern: Rx, method: str, target: int) -> str:
        return f"""SELECT project, file, '{client}' AS client, {method} AS method,
  regexp_extract("full", {rx(pattern)}, {target}) AS target, line
  FROM ({matches(pattern, "SELECT * FROM flow")})"""

    return " UNION ".join(
        [rows("fetch", facts.FETCH_CALL, "'fetch'", 1)]
        + [
            rows(client, p, f'regexp_extract("full", {rx(p)}, 1)', 2)
            for client, p in facts.CLIENT_CALLS
        ]
    )


def _listed(rows: str, item: str, name: str) -> str:
    """Per file, the items as one sorted string."""
    return f"""SELECT project, file, {_joined(f"list({item})")} AS {name}
  FROM ({rows}) GROUP BY project, file"""


_FACTS = f"""{CODE},
functions AS MATERIALIZED ({_functions()}),
imports AS MATERIALIZED ({_imports()}),
db_operations AS MATERIALIZED ({_db_operations()}),
external_apis AS MATERIALIZED ({_external_apis()})"""

_FACT_STRINGS = {
    "functions": ("functions", "name || ':' || line", "true"),
    **{
        field: ("imports", "source || ':' || line", f"kind = '{kind}'")
        for field, kind in facts.DEPENDENCY_FIELDS.items()
    },
    "database": (
        "db_operations",
        "kind || ':' || target || ':' || operation || ':' || line",
        "true",
    ),
    "externalApis": (
        "external_apis",
        "client || ':' || method || ':' || target || ':' || line",
        "true",
    ),
}


def _per_file(names: list[str]) -> str:
    """project, file, language and the named facts as strings, for every flow file."""
    columns = ", ".join(f"coalesce({n}_of.{n}, '') AS {n}" for n in names)
    joins = "\n".join(
        f"""  LEFT JOIN ({_listed(f"SELECT * FROM {table} WHERE {where}", item, name)}) AS {name}_of
  ON {name}_of.project = flow.project AND {name}_of.file = flow.file"""
        for name in names
        for table, item, where in [_FACT_STRINGS[name]]
    )
    return f"SELECT flow.project, flow.file, flow.language, {columns} FROM flow\n{joins}"


# Pieces of text between the braces of a block, for an engine without lookahead.
_PIECES = Rx(
    r"""//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|/\*[\s\S]*|'(?:[^'\\]|\\[\s\S])*'|'[\s\S]*|"(?:[^"\\]|\\[\s\S])*"|"[\s\S]*|`(?:[^`\\]|\\[\s\S])*`|`[\s\S]*|[^{}/'"`]+|[\s\S]"""
)


def _calls(text: str) -> str:
    def named(pattern: Rx) -> str:
        pairs = f"list_zip({groups(pattern, 1, text)}, {groups(pattern, 2, text)})"
        return f"[x[1] || '.' || x[2] FOR x IN {pairs}]"

    return f"list_distinct(list_concat({named(facts.ORM_CALL)}, {named(facts.QUERY_CALL)}))"


def _emits(text: str) -> str:
    both = f"list_concat({groups(mapping.EMIT, 1, text)}, {groups(mapping.EMIT_TO, 1, text)})"
    return f"list_distinct({both})"


def _named_functions() -> str:
    rows = " UNION ALL ".join(
        f"""SELECT project, file, regexp_extract("full", {rx(p)}, 1) AS name, line, {n} AS p, i
  FROM ({matches(p, "SELECT * FROM code WHERE language IS NOT NULL")})"""
        for n, (_, p) in enumerate(mapping.NAMED_FUNCTIONS)
    )
    return f"""SELECT project, file, name, line FROM (SELECT *,
  row_number() OVER (PARTITION BY project, file, name ORDER BY p, i) AS seen FROM ({rows}))
  WHERE seen = 1"""


_HEADS = matches(
    mapping.HANDLER_START,
    "SELECT project, file, content FROM code "
    "WHERE language IS NOT NULL AND contains(lower(content), 'socket.on')",
)
# Every start with its arrow, brace and block; blocks are found by summing depths.
_HANDLERS = f"""
heads AS MATERIALIZED (SELECT project, file, content, start, line, length("full") AS n,
    regexp_extract("full", {rx(mapping.HANDLER_START)}, 1) AS event FROM ({_HEADS})),
arrows AS (SELECT *, strpos(substr(content, start + n + 1), '=>') AS arrow FROM heads),
braces AS (SELECT *, start + n + arrow - 1
    + strpos(substr(content, start + n + arrow), '{{') - 1 AS opens,
    strpos(substr(content, start + n + arrow), '{{') AS brace FROM arrows WHERE arrow > 0),
pieces AS (SELECT project, file, start, unnest(ps) AS piece, generate_subscripts(ps, 1) AS j
  FROM (SELECT *, regexp_extract_all(substr(content, opens + 1), {rx(_PIECES)}, 0) AS ps
    FROM braces WHERE brace > 0)),
depths AS (SELECT *,
    sum(CASE piece WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER upto AS depth,
    sum(length(piece)) OVER upto AS taken
  FROM pieces WINDOW upto AS (PARTITION BY project, file, start ORDER BY j ROWS
    UNBOUNDED PRECEDING)),
ends AS (SELECT project, file, start, min(taken) AS taken FROM depths
  WHERE piece = '}}' AND depth = 0 GROUP BY ALL),
blocks AS MATERIALIZED (SELECT b.project, b.file, b.event, b.start, b.line,
    substr(content, opens + 1, CAST(taken AS BIGINT)) AS body,
    opens + taken - 1 AS closes, substr(content, 1, CAST(opens + taken AS BIGINT)) AS upto
  FROM braces AS b JOIN ends AS e
  ON b.project = e.project AND b.file = e.file AND b.start = e.start),
followers AS (SELECT a.project, a.file, a.start, min(b.start) AS next
  FROM blocks AS a JOIN blocks AS b
  ON a.project = b.project AND a.file = b.file AND b.start > a.closes GROUP BY ALL),
chain AS (SELECT project, file, min(start) AS start FROM blocks GROUP BY project, file
  UNION ALL
  SELECT f.project, f.file, f.next FROM chain AS c JOIN followers AS f
  ON c.project = f.project AND c.file = f.file AND c.start = f.start),
handlers AS MATERIALIZED (SELECT b.project, b.file, event, body, CAST(b.start AS INTEGER) AS start,
    line, CAST(1 + {newlines("upto")} AS INTEGER) AS end_line,
    {_joined(_calls("body"))} AS calls, {_emits("body")} AS emits
  FROM blocks AS b JOIN chain AS c
  ON b.project = c.project AND b.file = c.file AND b.start = c.start)"""

_RECURSIVE_CODE = CODE.replace("WITH ", "WITH RECURSIVE ", 1)

_MAPPED = f"""
found AS MATERIALIZED ({full()}),
own AS (SELECT DISTINCT ON (project, file, event) * FROM handlers
  ORDER BY project, file, event, start),
emitter AS (SELECT DISTINCT ON (project, file, emitted) *
  FROM (SELECT *, unnest(emits) AS emitted FROM handlers)
  ORDER BY project, file, emitted, start),
file_emits AS (SELECT DISTINCT project, file, unnest(list_concat(
    {groups(mapping.SOCKET_EMIT, 1)}, {groups(mapping.SOCKET_EMIT_TO, 1)})) AS emitted
  FROM code WHERE language IS NOT NULL),
whole AS (SELECT project, file, {_joined(_calls("content"))} AS calls,
    {_joined(_emits("content"))} AS emits FROM code WHERE language IS NOT NULL),
named AS ({_listed(_named_functions(), "name || ':' || line", "functions")}),
mapped AS MATERIALIZED (SELECT i.project, i.file, i.language, {", ".join("i." + c for c in COLUMNS.split(", "))}, i.ord,
    CASE WHEN o.event IS NOT NULL THEN 'socket.on("' || o.event || '")' END AS handler,
    o.line AS line, o.end_line AS end_line,
    CASE WHEN o.event IS NULL AND fe.emitted IS NOT NULL AND e.event IS NOT NULL
      THEN 'socket.on("' || e.event || '")' END AS "sourceHandler",
    CASE WHEN o.event IS NULL AND fe.emitted IS NOT NULL THEN e.line END AS "sourceLine",
    CASE WHEN o.event IS NULL AND fe.emitted IS NOT NULL THEN e.end_line END AS source_end_line,
    CASE WHEN NOT i.socket THEN w.calls WHEN o.event IS NOT NULL THEN o.calls
      WHEN fe.emitted IS NOT NULL THEN coalesce(e.calls, '') ELSE '' END AS calls,
    CASE WHEN NOT i.socket THEN w.emits WHEN o.event IS NOT NULL THEN {_joined("o.emits")}
      WHEN fe.emitted IS NOT NULL THEN i.event ELSE '' END AS emits,
    CASE WHEN NOT i.socket THEN coalesce(n.functions, '') END AS named_functions
  FROM (SELECT *, type = 'realtime' AND protocol = 'socketio' AS socket FROM found) AS i
  LEFT JOIN own AS o ON i.socket AND i.project = o.project AND i.file = o.file
    AND i.event = o.event
  LEFT JOIN emitter AS e ON i.socket AND i.project = e.project AND i.file = e.file
    AND i.event = e.emitted
  LEFT JOIN file_emits AS fe ON i.socket AND i.project = fe.project AND i.file = fe.file
    AND i.event = fe.emitted
  LEFT JOIN whole AS w ON i.project = w.project AND i.file = w.file
  LEFT JOIN named AS n ON i.project = n.project AND i.file = n.file)"""


def _model_name(value: str) -> str:
    bare = f"regexp_replace({value}, {rx(flows.DIRECTORIES)}, '')"
    return f"nullif(trim(regexp_replace({bare}, {rx(flows.CODE_EXTENSION)}, '')), '')"


def _json_list(name: str, values: str) -> str:
    return f"""',"{name}":' || coalesce(CAST(to_json({values}) AS VARCHAR), '[]')"""


# Fields of a fact as JSON, with what orders them.
_JSON_ITEMS = {
    "functions": ("functions", ("name",), "true"),
    "services": ("imports", ("source",), "kind = 'service'"),
    "repositories": ("imports", ("source",), "kind = 'repository'"),
    "externalApis": ("external_apis", ("client", "method", "target"), "true"),
}


def _json_item(texts: tuple[str, ...]) -> str:
    shown = " || ',' || ".join(f"""'"{t}":' || to_json({t})""" for t in texts)
    return f"""'{{' || {shown} || ',"line":' || line || '}}'"""


def _json_grouped(rows: str, texts: tuple[str, ...], keys: str) -> str:
    order = " || ':' || ".join([*texts, "line"])
    return f"""SELECT {keys}, '[' || string_agg({_json_item(texts)}, ',' ORDER BY {order}) || ']' AS json
  FROM ({rows}) GROUP BY {keys}"""


def _json_facts(used: str) -> str:
    """The lists of a flow as JSON, by file, and its models by interface."""
    lists = [
        f"json_{n} AS ({_json_grouped(f'SELECT * FROM {t} WHERE {where}', texts, 'project, file')})"
        for n, (t, texts, where) in _JSON_ITEMS.items()
    ]
    models = f"""SELECT DISTINCT u.project, u.file, u.ord, source, line FROM ({used}) AS u
    JOIN imports AS i ON u.project = i.project AND u.file = i.file AND i.kind = 'model'
    AND lower({_model_name("i.source")}) = u.model"""
    lists.append(f"json_models AS ({_json_grouped(models, ('source',), 'project, file, ord')})")
    return ",\n".join(lists)


_JSON_JOINS = "\n".join(
    f'LEFT JOIN json_{n} AS "{n}" ON m.project = "{n}".project AND m.file = "{n}".file'
    for n in _JSON_ITEMS
)


def _json_object(fields: list[tuple[str, str]]) -> str:
    """Text of an object from the JSON of its fields; those that are null are left out."""
    shown = ", ".join(f"""'"{name}":' || {json}""" for name, json in fields)
    return f"'{{' || concat_ws(',', {shown}) || '}}'"


def _json_scope(present: str, first: str, last: str) -> str:
    return f"""CASE WHEN {present} IS NOT NULL THEN
    '{{"name":"<anonymous>","type":"callback","startLine":' || {first} || ',"endLine":' || {last} || '}}' END"""


_JSON_FLOW = [
    ("project", "to_json(m.project)"),
    ("ord", "m.ord"),
    (
        "interface",
        _json_object(
            [
                *((c, f"to_json(m.{c})") for c in COLUMNS.split(", ") if c != "direction"),
                ("language", "to_json(flow.language)"),
                ("file", "to_json(m.file)"),
            ]
        ),
    ),
    ("handler", "to_json(m.handler)"),
    ("scope", _json_scope("m.handler", "m.line", "m.end_line")),
    ("sourceScope", _json_scope('m."sourceHandler"', 'm."sourceLine"', "m.source_end_line")),
    ("sourceHandler", 'to_json(m."sourceHandler")'),
    ("sourceLine", 'm."sourceLine"'),
    ("services", "coalesce(services.json, '[]')"),
    ("repositories", "coalesce(repositories.json, '[]')"),
    ("models", "coalesce(models.json, '[]')"),
    (
        "database",
        """'[' || CASE WHEN calls = '' THEN '' ELSE array_to_string(['{"model":' ||
    to_json(string_split(c, '.')[1]) || ',"operation":' || to_json(string_split(c, '.')[2]) || '}'
    FOR c IN string_split(calls, '|')], ',') END || ']'""",
    ),
    ("externalApis", "coalesce(\"externalApis\".json, '[]')"),
    (
        "outputs",
        """CASE WHEN emits = '' THEN '[]' ELSE CAST(to_json(string_split(emits, '|')) AS VARCHAR) END""",
    ),
    ("functions", "coalesce(functions.json, '[]')"),
]


def _flows() -> dict[str, str]:
    listed = ["functions", "services", "repositories", "externalApis"]
    used = f"""SELECT DISTINCT project, file, ord,
    lower({_model_name("string_split(unnest(string_split(calls, '|')), '.')[1]")}) AS model
    FROM mapped WHERE calls <> ''"""
    models = f"""SELECT m.project, m.file, m.ord, {_joined("list(source || ':' || line)")} AS models
  FROM (SELECT DISTINCT u.project, u.file, u.ord, source, line FROM ({used}) AS u
    JOIN imports AS i ON u.project = i.project AND u.file = i.file AND i.kind = 'model'
    AND lower({_model_name("i.source")}) = u.model) AS m GROUP BY ALL"""
    interface = ", ".join("m." + c for c in COLUMNS.split(", ") if c != "direction")
    facts_of = _per_file(listed)
    own = [f"CASE WHEN socket THEN {c} ELSE '' END" for c in ("models", "calls", "emits")]
    scope = """CASE WHEN {0} IS NOT NULL
    THEN '<anonymous>/callback/' || {1} || '/' || {2} END"""
    fields = [
        *(c for c in COLUMNS.split(", ") if c != "direction"),
        "language",
        "file",
        "handler",
        scope.format("handler", "line", "end_line"),
        scope.format('"sourceHandler"', '"sourceLine"', "source_end_line"),
        '"sourceHandler"',
        '"sourceLine"',
        *own,
    ]
    nested = " || '~' || ".join(["ord", *(f"coalesce(CAST({x} AS VARCHAR), '')" for x in fields)])
    recursive_facts = _FACTS.replace("WITH ", "WITH RECURSIVE ", 1)
    return {
        "interface_flows": f"""{recursive_facts}, {_HANDLERS}, {_MAPPED}
  SELECT m.project, m.file, m.language, {interface}, m.ord, m.handler, m.line AS scope_start,
    m.end_line AS scope_end, m."sourceHandler", m."sourceLine",
    m.source_end_line AS source_scope_end, f.services, f.repositories,
    coalesce(x.models, '') AS models, m.calls AS database, f."externalApis",
    m.emits AS outputs, f.functions
  FROM mapped AS m JOIN ({facts_of}) AS f ON m.project = f.project AND m.file = f.file
  LEFT JOIN ({models}) AS x
  ON m.project = x.project AND m.file = x.file AND m.ord = x.ord""",
        "file_flows": f"""{recursive_facts}, {_HANDLERS}, {_MAPPED},
whole_rows AS (SELECT m.*, type = 'realtime' AND protocol = 'socketio' AS socket,
    coalesce(x.models, '') AS models FROM mapped AS m LEFT JOIN ({models}) AS x
    ON m.project = x.project AND m.file = x.file AND m.ord = x.ord)
  SELECT f.*, coalesce(i.interfaces, '') AS interfaces,
    CASE WHEN s.file IS NOT NULL THEN s.models END AS interface_models,
    CASE WHEN s.file IS NOT NULL THEN s.calls END AS interface_database,
    CASE WHEN s.file IS NOT NULL THEN s.emits END AS interface_outputs
  FROM ({_per_file([*listed, "models", "database"])}) AS f
  LEFT JOIN ({_listed("SELECT * FROM whole_rows", nested, "interfaces")}) AS i
  ON f.project = i.project AND f.file = i.file
  LEFT JOIN (SELECT DISTINCT project, file, models, calls, emits FROM whole_rows
    WHERE NOT socket) AS s ON f.project = s.project AND f.file = s.file""",
        "json_flows": f"""{recursive_facts}, {_HANDLERS}, {_MAPPED}, {_json_facts(used)}
  SELECT {_json_object(_JSON_FLOW)} AS json
  FROM mapped AS m JOIN flow ON m.project = flow.project AND m.file = flow.file
  {_JSON_JOINS} LEFT JOIN json_models AS models
  ON m.project = models.project AND m.file = models.file AND m.ord = models.ord""",
        "flow_counts": f"""{CODE}, found AS ({full()})
  SELECT project, coalesce(i.n, 0) AS "interfacesAnalyzed", f.n AS "filesAnalyzed"
  FROM (SELECT project, count(*) AS n FROM flow GROUP BY project) AS f
  LEFT JOIN (SELECT project, count(*) AS n FROM found GROUP BY project) AS i USING (project)""",
        "model_names": f"""{_FACTS} SELECT DISTINCT project, file, source,
  {_model_name("source")} AS model FROM imports""",
        "interface_models": f"""{recursive_facts}, {_HANDLERS}, {_MAPPED}
  SELECT project, file, ord, unnest(string_split(models, '|')) AS model FROM ({models})""",
    }


def _facts() -> dict[str, str]:
    return {
        "functions": f"{CODE} {_functions()}",
        "imports": f"{CODE} {_imports()}",
        "db_operations": f"{CODE} {_db_operations()}",
        "external_apis": f"{CODE} {_external_apis()}",
        "dependencies": f"""{_FACTS} SELECT * EXCLUDE (language)
  FROM ({_per_file(list(facts.DEPENDENCY_FIELDS))})""",
        "analyze_files": f"{_FACTS} {_per_file(list(_FACT_STRINGS))}",
    }


def _mapping() -> dict[str, str]:
    scanned = "SELECT * FROM code WHERE language IS NOT NULL"
    return {
        "socket_handlers": f"""{_RECURSIVE_CODE}, {_HANDLERS}
  SELECT project, file, event, body, start, line, end_line FROM handlers""",
        "socket_emits": f"""{CODE} SELECT project, file, unnest({_emits("content")}) AS event
  FROM ({scanned})""",
        "db_calls": f"""{CODE} SELECT project, file, string_split(c, '.')[1] AS model,
  string_split(c, '.')[2] AS operation
  FROM (SELECT project, file, unnest({_calls("content")}) AS c FROM ({scanned}))""",
        "functions_by_name": f"{CODE} {_named_functions()}",
        "map_interfaces": f"{_RECURSIVE_CODE}, {_HANDLERS}, {_MAPPED} SELECT * FROM mapped",
        "mapping_count": f"""{CODE}, found AS ({full()})
  SELECT project, coalesce(n, 0) AS count
  FROM (SELECT DISTINCT project FROM code WHERE language IS NOT NULL)
  LEFT JOIN (SELECT project, count(*) AS n FROM found GROUP BY project) USING (project)""",
    }


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join(f"({', '.join(quoted(x) for x in row)})" for row in rows)


_TECH = _values(
    [(c, t, n) for c, ts in TECHNOLOGIES.items() for t, ns in ts.items() for n in ns]
)
# No sample package has JSON other than objects, null and a list.
_PROJECT = f"""{CORPUS},
tech(category, technology, package) AS (VALUES {_TECH}),
named AS (SELECT project, path, {_BASENAME} AS name, {DISPLAY_LANGUAGE} AS language FROM files),
packages AS MATERIALIZED (SELECT project, path, json_extract_string(j, '$.name') AS name, j,
    list_concat(list_concat(coalesce(json_keys(j, '$.dependencies'), []),
      coalesce(json_keys(j, '$.devDependencies'), [])),
      coalesce(json_keys(j, '$.peerDependencies'), [])) AS dependencies
  FROM (SELECT project, path, CAST(content AS JSON) AS j FROM files
    WHERE {_BASENAME} = 'package.json' AND json_valid(content) AND trim(content) <> 'null')),
used AS MATERIALIZED (SELECT DISTINCT p.project, p.path, t.category, t.technology
  FROM (SELECT project, path, unnest(dependencies) AS dependency FROM packages) AS p
  JOIN tech AS t ON lower(p.dependency) = lower(t.package)),
roles AS MATERIALIZED (SELECT p.project, p.path,
    CASE WHEN regexp_matches(lower(p.path), '/(client|frontend)/') THEN 'frontend'
      WHEN regexp_matches(lower(p.path), '/(server|backend)/') THEN 'backend'
      WHEN coalesce(f, 0) > 0 AND coalesce(b, 0) = 0 THEN 'frontend'
      WHEN coalesce(b, 0) > 0 AND coalesce(f, 0) = 0 THEN 'backend'
      WHEN coalesce(b, 0) > 0 AND coalesce(json_extract_string(j, '$.scripts.start'), '') <> ''
        THEN 'backend' ELSE 'unknown' END AS role
  FROM packages AS p LEFT JOIN (SELECT project, path,
      count(*) FILTER (category = 'frontend') AS f, count(*) FILTER (category = 'backend') AS b
    FROM used GROUP BY project, path) AS u ON p.project = u.project AND p.path = u.path),
project_tech AS MATERIALIZED (SELECT DISTINCT u.project,
    CASE WHEN category IN ('frontend', 'backend') AND role <> 'unknown' THEN role
      ELSE category END AS category, technology
  FROM used AS u JOIN roles AS r ON u.project = r.project AND u.path = r.path),
managers(manager, file) AS (VALUES {_values([(m, f) for m, fs in MANAGERS.items() for f in fs])}),
runs(runtime, language) AS (VALUES {_values([(r, x) for r, xs in RUNTIMES.items() for x in xs])}),
runtimes AS (SELECT DISTINCT project, runtime FROM named JOIN runs USING (language)
  UNION SELECT project, '{BACKEND_RUNTIME[1]}' FROM project_tech
  WHERE category = 'backend' AND technology = '{BACKEND_RUNTIME[0]}'),
profile AS MATERIALIZED (
  SELECT DISTINCT project, 'languages' AS section, language AS value,
    CAST(NULL AS VARCHAR) AS detail FROM named WHERE language IS NOT NULL
  UNION ALL SELECT project, 'runtimes', runtime, NULL FROM runtimes
  UNION ALL SELECT DISTINCT project, 'packageManagers', manager, NULL
    FROM named JOIN managers ON name = managers.file
  UNION ALL SELECT project, 'entryPoints', path, NULL FROM named WHERE name IN {_in(ENTRY_POINTS)}
  UNION ALL SELECT project, 'manifests', path, name FROM named WHERE name IN {_in(MANIFESTS)}
  UNION ALL SELECT project, CASE category WHEN 'frontend' THEN 'frameworks'
    WHEN 'backend' THEN 'frameworks' WHEN 'database' THEN 'databases' WHEN 'orm' THEN 'orms'
    ELSE category END, technology,
    CASE WHEN category IN ('frontend', 'backend') THEN category END FROM project_tech
  UNION ALL SELECT DISTINCT project, 'dependencies', unnest(dependencies), NULL FROM packages)"""


def _project() -> dict[str, str]:
    categories = {
        "frameworks": "'frontend', 'backend'",
        "databases": "'database'",
        "orms": "'orm'",
        "realtime": "'realtime'",
        "ai": "'ai'",
        "testing": "'testing'",
    }
    technologies = ", ".join(
        f"{_joined(f'list(technology) FILTER (category IN ({c}))')} AS {n}"
        for n, c in categories.items()
    )
    technology_lists = ", ".join(
        f"list_sort(list(technology) FILTER (category IN ({c}))) AS {n}" for n, c in categories.items()
    )
    sections = ["languages", *categories, "runtimes", "packageManagers"]
    listed = ", ".join(
        f"""{_joined(f"list(DISTINCT value) FILTER (section = '{s}')")} AS "{s}\""""
        for s in sections
    )
    counted = ", ".join(
        f"""count(*) FILTER (section = '{s}') AS "{s}\""""
        for s in ("dependencies", "entryPoints", "manifests")
    )
    return {
        "packages": f"""{_PROJECT} SELECT project, path, name,
  array_to_string(dependencies, '|') AS dependencies FROM packages""",
        "package_dependencies": f"""{_PROJECT} SELECT project, path,
  CAST(generate_subscripts(dependencies, 1) - 1 AS INTEGER) AS ord,
  unnest(dependencies) AS dependency FROM packages""",
        "package_technologies": f"{_PROJECT} SELECT * FROM used",
        "package_profiles": f"""{_PROJECT} SELECT p.project, p.path, p.name, r.role,
  {", ".join(f"coalesce(t.{n}, '') AS {n}" for n in categories)},
  coalesce(array_to_string(p.dependencies, '|'), '') AS dependencies
  FROM packages AS p JOIN roles AS r ON p.project = r.project AND p.path = r.path
  LEFT JOIN (SELECT project, path, {technologies} FROM used GROUP BY ALL) AS t
  ON p.project = t.project AND p.path = t.path""",
        "json_packages": f"""{_PROJECT} SELECT '{{"project":' || to_json(p.project) || ',"path":'
  || to_json(p.path) || CASE WHEN p.name IS NULL THEN '' ELSE ',"name":' || to_json(p.name) END
  || ',"role":' || to_json(r.role)
  || {" || ".join(_json_list(n, f"t.{n}") for n in categories)}
  || ',"dependencies":' || to_json(p.dependencies) || '}}' AS json
  FROM packages AS p JOIN roles AS r ON p.project = r.project AND p.path = r.path
  LEFT JOIN (SELECT project, path, {technology_lists} FROM used GROUP BY ALL) AS t
  ON p.project = t.project AND p.path = t.path""",
        "project_technologies": f"{_PROJECT} SELECT * FROM project_tech",
        "project_languages": f"""{_PROJECT} SELECT DISTINCT project, language FROM named
  WHERE language IS NOT NULL""",
        "package_managers": f"""{_PROJECT} SELECT DISTINCT project, manager
  FROM named JOIN managers ON name = managers.file""",
        "runtimes": f"{_PROJECT} SELECT * FROM runtimes",
        "entry_points": f"""{_PROJECT} SELECT project, path AS file FROM named
  WHERE name IN {_in(ENTRY_POINTS)}""",
        "manifests": f"""{_PROJECT} SELECT project, path AS file, name AS type FROM named
  WHERE name IN {_in(MANIFESTS)}""",
        "project_dependencies": f"""{_PROJECT} SELECT DISTINCT project,
  unnest(dependencies) AS dependency FROM packages""",
        "project_profiles": f"{_PROJECT} SELECT * FROM profile",
        "project_summary": f"{_PROJECT} SELECT project, {listed}, {counted} FROM profile GROUP BY project",
    }


# Stored tables, indexes, refreshed facts and pages must give what the files themselves give.
STORED = {
    "project_pages": "project_profiles",
    "search_index": "search_files",
    "read_stored_files": "read_files",
    "discover_stored": "discover_interfaces",
    "refreshed_facts": "map_interfaces",
}


def oracle_sql() -> dict[str, str]:
    plain = {
        **_inventory(),
        **_interfaces(),
        **_facts(),
        **_mapping(),
        **_flows(),
        **_project(),
    }
    return plain | {name: plain[same] for name, same in STORED.items()}
