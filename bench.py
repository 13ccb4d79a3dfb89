"""Time the headline queries and print one JSON line.

The sample files are derived from the tables once and written as Parquet; every
query then reads that table and runs to the end without collecting anything.

    BENCH_SF_DIR  directory of tables (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
    BENCH_WORK    folder that all executors share, for the corpus and stored facts
                  (default: a temporary one, for local runs)
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import facts, flows, interfaces, inventory, mapping, project, search
from codequarry.operators.stored import read_facts, write_facts
from codequarry.sources.corpus import read_corpus, write_corpus
from codequarry.sources.sample import sample_files
from codequarry.workers import importable

QUERIES = {
    "file_inventory": inventory.file_inventory,
    "directory_inventory": inventory.directory_inventory,
    "search_files": lambda f: search.search_files(f, "order"),
    "detect_routes": interfaces.detect_routes,
    "discover_interfaces": interfaces.discover_interfaces,
    "functions": facts.functions,
    "imports": facts.imports,
    "db_operations": facts.db_operations,
    "external_apis": facts.external_apis,
    "analyze_files": facts.analyze_files,
    "socket_handlers": mapping.socket_handlers,
    "map_interfaces": mapping.map_interfaces,
    "interface_flows": flows.interface_flows,
    "file_flows": flows.file_flows,
    "flow_counts": flows.flow_counts,
    "package_profiles": project.package_profiles,
    "project_profiles": project.project_profiles,
    "project_summary": project.project_summary,
}

# These start from stored facts as well as from source files.
FROM_FACTS = ("map_interfaces", "interface_flows", "file_flows", "flow_counts")


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    tables = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Scans are bound by CPU: many small splits keep all cores busy to the end.
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "256k")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    importable(spark).sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    from_facts: dict[str, float] = {}
    shared = os.environ.get("BENCH_WORK")
    with tempfile.TemporaryDirectory(prefix="bench-", dir=shared) as folder:
        corpus = os.path.join(folder, "corpus")
        began = time.perf_counter()
        write_corpus(sample_files(spark, tables), corpus, row_group_bytes=4 << 20)
        seconds["write_corpus"] = time.perf_counter() - began
        files = read_corpus(spark, corpus)
        count, size = files.agg(F.count("*"), F.sum("size")).first()
        for name, query in QUERIES.items():
            began = time.perf_counter()
            run(query(files))
            seconds[name] = time.perf_counter() - began
        stored = os.path.join(folder, "facts")
        began = time.perf_counter()
        write_facts(files, stored)
        from_facts["write_facts"] = time.perf_counter() - began
        known = read_facts(spark, stored)
        for name in FROM_FACTS:
            began = time.perf_counter()
            run(QUERIES[name](known))
            from_facts[name] = time.perf_counter() - began
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries over sample source files",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "from_stored_facts": {k: round(v, 3) for k, v in from_facts.items()},
                "sf": os.path.basename(tables.rstrip("/")).removeprefix("sf"),
                "files": count,
                "megabytes": round(size / 1e6, 1),
                "discover_files_per_second": round(count / seconds["discover_interfaces"]),
            }
        )
    )


if __name__ == "__main__":
    main()
