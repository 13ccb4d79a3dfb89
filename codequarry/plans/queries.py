"""Every operator as a query over the driver's tables.

Each query runs its operator over all sample files derived from the tables (or
over a table itself) and flattens nested columns to sorted strings, so that rows
can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.languages import (
    display_language,
    flow_language,
    interface_language,
)
from codequarry.operators import facts, flows, inventory, mapping, project, search
from codequarry.operators import interfaces as ifaces
from codequarry.operators.search_index import search_indexed, write_search_index
from codequarry.operators.stored import read_facts, refresh_facts, write_facts
from codequarry.rules import DETECTORS
from codequarry.rules.base import FIELDS
from codequarry.sources.corpus import (
    as_source_files,
    read_corpus,
    scan,
    to_json_rows,
    write_corpus,
)
from codequarry.sources.sample import sample_files, table
from codequarry.sources.scratch import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def _listed(values: Column, *fields: str) -> Column:
    """An array as one sorted string, structs as their fields joined."""
    shown = (
        F.transform(values, lambda v: F.concat_ws(":", *[v[f] for f in fields]))
        if fields
        else values
    )
    return F.array_join(F.array_sort(shown), "|")


def _search_index(spark: SparkSession, tables: str) -> DataFrame:
    """The search of `search_files`, over a stored corpus by its index."""
    folder = shared_folder(spark, "search")
    write_corpus(sample_files(spark, tables), f"{folder}/files")
    write_search_index(spark, f"{folder}/files", f"{folder}/index")
    return search_indexed(spark, f"{folder}/files", f"{folder}/index", "Order")


def _stored_corpus(spark: SparkSession, tables: str) -> DataFrame:
    folder = shared_folder(spark, "corpus")
    write_corpus(sample_files(spark, tables), folder)
    return read_corpus(spark, folder)


def _read_stored(spark: SparkSession, tables: str) -> DataFrame:
    return _read_files(_stored_corpus(spark, tables))


def _discover_stored(spark: SparkSession, tables: str) -> DataFrame:
    """The interfaces of `discover_interfaces`, from files that hold evidence only."""
    return ifaces.discover_interfaces(_stored_corpus(spark, tables))


def _refreshed_facts(spark: SparkSession, tables: str) -> DataFrame:
    """The mappings of `map_interfaces`, from facts that were written of older files, some of
    them missing, changed or since deleted, and then refreshed."""
    files = sample_files(spark, tables)
    h = F.pmod(F.xxhash64("project", "path"), F.lit(9))
    text = F.when(h == 1, F.concat(F.lit("Gone.find();\n"), "content")).otherwise(F.col("content"))
    gone = files.where(h == 2).withColumn("path", F.concat(F.lit("old/"), "path"))
    older = files.where(h != 0).withColumn("content", text).unionByName(gone)
    folder = shared_folder(spark, "facts")
    write_facts(older, folder)
    refresh_facts(files, folder)
    return _map_interfaces(read_facts(spark, folder))


def _over(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, tables: operator(sample_files(spark, tables))


def _scan_files(files: DataFrame) -> DataFrame:
    return scan(files).select("project", "path", "size", F.md5("content").alias("digest"))


def _read_files(files: DataFrame) -> DataFrame:
    wanted = project.entry_points(files).withColumnRenamed("file", "path")
    return inventory.read_files(files, wanted)


def _file_languages(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return scan(files).select(
        "project",
        path.alias("file"),
        interface_language(path).alias("interface_language"),
        flow_language(path).alias("flow_language"),
        display_language(path).alias("display_language"),
    )


def _decode_text(spark: SparkSession, tables: str) -> DataFrame:
    half = F.floor(F.length("html") / 2).cast("int")
    # A byte that is none, a cut sequence, a surrogate, and a sequence cut by the end.
    raw = F.concat(
        F.unhex(F.lit("FF")),
        F.substr("html", F.lit(1), half).cast("binary"),
        F.unhex(F.lit("E282")),
        F.substr("html", half + 1).cast("binary"),
        F.unhex(F.lit("EDA08041C3")),
    )
    pages = table(spark, tables, "pages").select(
        F.col("page_id").alias("project"), F.col("url").alias("path"), raw.alias("content")
    )
    return as_source_files(pages).select(
        F.col("project").alias("page_id"), F.md5("content").alias("digest")
    )


def _json_rows(files: DataFrame) -> DataFrame:
    return to_json_rows(inventory.file_info(files))


def _ordered(values: Column, *fields: str) -> Column:
    """An array of structs in the order of their fields joined."""
    keyed = F.transform(
        values, lambda v: F.struct(F.concat_ws(":", *[v[f] for f in fields]).alias("k"), v.alias("v"))
    )
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def _json_flows(files: DataFrame) -> DataFrame:
    orders = {
        **{f: ("source", "line") for f in ("services", "repositories", "models")},
        "database": ("model", "operation"),
        "externalApis": ("client", "method", "target", "line"),
        "functions": ("name", "line"),
    }
    rows = flows.interface_flows(files)
    return to_json_rows(
        rows.withColumns(
            {n: _ordered(F.col(n), *f) for n, f in orders.items()}
            | {"outputs": F.array_sort("outputs")}
        )
    )


def _json_packages(files: DataFrame) -> DataFrame:
    rows = project.package_profiles(files)
    lists = ("frameworks", "databases", "orms", "realtime", "ai", "testing")
    return to_json_rows(
        rows.select("project", "path", "name", "role", *[F.array_sort(c).alias(c) for c in lists], "dependencies")
    )


def _search_documents(spark: SparkSession, tables: str) -> DataFrame:
    return search.search_text(table(spark, tables, "documents"), "tion", "doc_id", "text")


def _search_pages(spark: SparkSession, tables: str) -> DataFrame:
    return search.search_text(table(spark, tables, "pages"), "</P>", "page_id", "html")


_FACT_FIELDS = {
    "functions": ("name", "line"),
    **{field: ("source", "line") for field in facts.DEPENDENCY_FIELDS},
    "database": ("kind", "target", "operation", "line"),
    "externalApis": ("client", "method", "target", "line"),
}


def _fact_strings(*names: str) -> list[Column]:
    return [_listed(F.col(n), *_FACT_FIELDS[n]).alias(n) for n in names]


def _dependencies(files: DataFrame) -> DataFrame:
    return facts.dependencies(files).select(
        "project", "file", *_fact_strings(*facts.DEPENDENCY_FIELDS)
    )


def _analyze_files(files: DataFrame) -> DataFrame:
    nested = facts.analyze_files(files)
    return nested.select(
        "project",
        "file",
        "language",
        "functions",
        "dependencies.*",
        F.col("databaseOperations").alias("database"),
        "externalApis",
    ).select("project", "file", "language", *_fact_strings(*_FACT_FIELDS))


def _map_interfaces(files: DataFrame) -> DataFrame:
    return mapping.map_interfaces(files).select(
        "project",
        "file",
        "language",
        *FIELDS,
        "ord",
        "handler",
        "line",
        F.col("scope.endLine").alias("end_line"),
        "sourceHandler",
        "sourceLine",
        F.col("sourceScope.endLine").alias("source_end_line"),
        _listed(F.col("databaseOperations"), "model", "operation").alias("c"),
        _listed(F.col("emittedEvents")).alias("emits"),
        _listed(F.col("functions"), "name", "line").alias("named_functions"),
    ).withColumn("calls", F.replace("c", F.lit(":"), F.lit("."))).drop("c")


def _interface_flows(files: DataFrame) -> DataFrame:
    return flows.interface_flows(files).select(
        "project",
        "interface.*",
        "ord",
        "handler",
        F.col("scope.startLine").alias("scope_start"),
        F.col("scope.endLine").alias("scope_end"),
        "sourceHandler",
        "sourceLine",
        F.col("sourceScope.endLine").alias("source_scope_end"),
        *_fact_strings("services", "repositories", "models", "externalApis", "functions"),
        F.replace(
            _listed(F.col("database"), "model", "operation"), F.lit(":"), F.lit(".")
        ).alias("database"),
        _listed(F.col("outputs")).alias("outputs"),
    )


def _file_flows(files: DataFrame) -> DataFrame:
    nested = flows.file_flows(files)

    def dotted(calls: Column) -> Column:
        return _listed(F.transform(calls, lambda c: F.concat_ws(".", c["model"], c["operation"])))

    def shown(f: Column) -> Column:
        fields = [f["interface"][n] for n in (*flows.INTERFACE_FIELDS, "language", "file")]
        for n in flows.PLACE_FIELDS:
            scope = n in ("scope", "sourceScope")
            parts = [f[n][x] for x in ("name", "type", "startLine", "endLine")]
            fields.append(F.when(f[n].isNotNull(), F.concat_ws("/", *parts)) if scope else f[n])
        fields += [_listed(f["models"], "source", "line"), dotted(f["database"]), _listed(f["outputs"])]
        return F.concat_ws("~", f["ord"], *[F.coalesce(x.cast("string"), F.lit("")) for x in fields])

    names = (
        "functions",
        "services",
        "repositories",
        "externalApis",
        "models",
        "database",
    )
    return nested.select(
        "project",
        "file",
        "language",
        *_fact_strings(*names),
        _listed(F.col("interfaceModels"), "source", "line").alias("interface_models"),
        dotted(F.col("interfaceDatabase")).alias("interface_database"),
        _listed(F.col("interfaceOutputs")).alias("interface_outputs"),
        _listed(F.transform("interfaces", shown)).alias("interfaces"),
    )


def _model_names(files: DataFrame) -> DataFrame:
    name = flows.model_name(F.col("source"))
    return (
        facts.imports(files)
        .select("project", "file", "source", F.when(name != "", name).alias("model"))
        .distinct()
    )


def _interface_models(files: DataFrame) -> DataFrame:
    return flows.interface_flows(files).select(
        "project",
        "interface.file",
        "ord",
        F.explode(
            F.transform("models", lambda m: F.concat_ws(":", m["source"], m["line"]))
        ).alias("model"),
    )


def _packages(files: DataFrame) -> DataFrame:
    return project.packages(files).select(
        "project", "path", "name", F.array_join("dependencies", "|").alias("dependencies")
    )


def _package_profiles(files: DataFrame) -> DataFrame:
    lists = ("frameworks", "databases", "orms", "realtime", "ai", "testing")
    return project.package_profiles(files).select(
        "project",
        "path",
        "name",
        "role",
        *[_listed(F.col(c)).alias(c) for c in lists],
        F.array_join("dependencies", "|").alias("dependencies"),
    )


def _project_summary(files: DataFrame) -> DataFrame:
    rows = project.project_summary(files)
    return rows.select(
        *[
            _listed(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "array" else f.name
            for f in rows.schema
        ]
    )


def _detector(name: str) -> Query:
    only = ifaces.detectors_named(name)
    return _over(lambda files: ifaces.discover_interfaces(files, detectors=only))


def queries() -> dict[str, Query]:
    return {
        "scan_files": _over(_scan_files),
        "file_inventory": _over(inventory.file_inventory),
        "directory_inventory": _over(inventory.directory_inventory),
        "directory_info": _over(inventory.directory_info),
        "list_root": _over(lambda f: inventory.list_directory(f, ".")),
        "list_directory": _over(lambda f: inventory.list_directory(f, "apps")),
        "file_info": _over(inventory.file_info),
        "read_files": _over(_read_files),
        "scoped_scan": _over(lambda f: inventory.file_inventory(f, "docs/dist")),
        "decode_text": _decode_text,
        "json_rows": _over(_json_rows),
        "json_flows": _over(_json_flows),
        "json_packages": _over(_json_packages),
        "search_files": _over(lambda f: search.search_files(f, "Order")),
        "search_subtree": _over(lambda f: search.search_files(f, "await", "api/src")),
        "search_documents": _search_documents,
        "search_pages": _search_pages,
        "file_languages": _over(_file_languages),
        **{f"iface_{d.name.replace('-', '_')}": _detector(d.name) for d in DETECTORS},
        "discover_interfaces": _over(ifaces.discover_interfaces),
        "interfaces_full": _over(ifaces.interfaces_full),
        "interface_count": _over(ifaces.interface_count),
        "detect_routes": _over(ifaces.detect_routes),
        "functions": _over(facts.functions),
        "imports": _over(facts.imports),
        "db_operations": _over(facts.db_operations),
        "external_apis": _over(facts.external_apis),
        "dependencies": _over(_dependencies),
        "analyze_files": _over(_analyze_files),
        "socket_handlers": _over(mapping.socket_handlers),
        "socket_emits": _over(mapping.socket_emits),
        "db_calls": _over(mapping.db_calls),
        "functions_by_name": _over(mapping.functions_by_name),
        "map_interfaces": _over(_map_interfaces),
        "mapping_count": _over(mapping.mapping_count),
        "interface_flows": _over(_interface_flows),
        "file_flows": _over(_file_flows),
        "flow_counts": _over(flows.flow_counts),
        "model_names": _over(_model_names),
        "interface_models": _over(_interface_models),
        "packages": _over(_packages),
        "package_dependencies": _over(project.package_dependencies),
        "package_technologies": _over(project.package_technologies),
        "package_profiles": _over(_package_profiles),
        "project_technologies": _over(project.project_technologies),
        "project_languages": _over(project.project_languages),
        "package_managers": _over(project.package_managers),
        "runtimes": _over(project.runtimes),
        "entry_points": _over(project.entry_points),
        "manifests": _over(project.manifests),
        "project_dependencies": _over(project.project_dependencies),
        "project_profiles": _over(project.project_profiles),
        "project_summary": _over(_project_summary),
        "project_pages": _over(lambda f: project.profile_rows(project.project_pages(f, entries=50))),
        "search_index": _search_index,
        "read_stored_files": _read_stored,
        "discover_stored": _discover_stored,
        "refreshed_facts": _refreshed_facts,
    }
