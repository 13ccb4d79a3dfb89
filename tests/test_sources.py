from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from codequarry.operators import facts, flows, interfaces, inventory, mapping, project, search
from codequarry.sources.corpus import (
    as_source_files,
    from_binary_files,
    read_corpus,
    scan,
    to_json_rows,
    write_corpus,
)
from codequarry.sources.tree import SourceTree, read_trees


def paths(df, column="path"):
    return sorted(r[column] for r in df.collect())


def test_scan_prunes_below_the_start(source_files):
    files = source_files(
        ("a.js", ""), ("x/dist/b.js", ""), ("dist/c/build/d.js", ""), ("dist/e.js", ""),
        ("distribution/f.js", ""), ("node_modules", ""),
    )
    assert paths(scan(files)) == ["a.js", "distribution/f.js", "node_modules"]
    assert paths(scan(files, "dist")) == ["dist/e.js"]
    assert paths(scan(files, "./x/")) == []


def test_inventories(source_files):
    files = source_files(("a/b/c.js", "é"), ("a/d", ""), ("e.tar.gz", "x"), ("build/x", ""))
    assert paths(inventory.directory_inventory(files), "directory") == ["a", "a/b"]
    assert paths(inventory.directory_inventory(files, "a"), "directory") == ["a/b"]
    listed = {(r.name, r.type) for r in inventory.list_directory(files, ".").collect()}
    assert listed == {("a", "directory"), ("e.tar.gz", "file"), ("build", "directory")}
    listed = {(r.name, r.type) for r in inventory.list_directory(files, "a").collect()}
    assert listed == {("b", "directory"), ("d", "file")}
    info = {r.path: (r.size, r.extension) for r in inventory.file_info(files).collect()}
    assert info["a/b/c.js"] == (2, ".js") and info["a/d"] == (0, "")
    wanted = files.sparkSession.createDataFrame([("p", "a/d"), ("p", "no")], "project string, path string")
    assert paths(inventory.read_files(files, wanted)) == ["a/d"]


def test_search(source_files):
    files = source_files(("a.md", "aaaAa"), ("b", "x"), ("dist/c", "aa"))
    rows = search.search_files(files, "aA").collect()
    assert [(r.path, r.matches) for r in rows] == [("a.md", 2)]
    with pytest.raises(ValueError):
        search.search_files(files, "")


def test_decoding_replaces_bad_bytes(spark):
    df = spark.createDataFrame([("p", "a", b"x\xffy")], "project string, path string, content binary")
    (row,) = as_source_files(df).collect()
    assert (row.content, row.size) == ("x�y", 3)


@pytest.mark.parametrize(
    "raw",
    [
        b"a\xffb\xfe", b"a\xe2\x82b", b"x\xe2\x82", b"\xed\xa0\x80y", b"\xf0\x9f\x98z\xc3", b"\xc0\xaf.",
        b"\xf4\x90\x80\x80", b"\xe2\x28\xa1", b"\x80\xbf", "\U0001f600é".encode(), b"\x00\xc3\xa9",
    ],
)
def test_decoding_as_the_web_does(spark, raw):
    df = spark.createDataFrame([("p", "a", raw)], "project string, path string, content binary")
    (row,) = as_source_files(df).collect()
    assert row.content == raw.decode("utf-8", errors="replace") and row.size == len(raw)


def test_json_rows(source_files):
    (row,) = to_json_rows(source_files(("a", 'x"')).select("path", "content")).collect()
    assert row.json == '{"path":"a","content":"x\\""}'


@pytest.fixture
def tree(tmp_path):
    for name, data in {
        "a.js": b"1", "src/__init__.py": b"\xff", ".github/w.yml": b"w", "src/deep/er/x.go": b"go",
        "node_modules/n.js": b"n", "src/dist/y.js": b"y",
    }.items():
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    os.symlink(tmp_path / "a.js", tmp_path / "link.js")
    return tmp_path


@pytest.mark.parametrize("splits", ["1", "3", "50"])
def test_source_tree(spark, tree, splits):
    spark.dataSource.register(SourceTree)
    df = spark.read.format("source_tree").option("splits", splits).option("project", "q")
    rows = {r.path: r for r in df.load(str(tree)).collect()}
    assert sorted(rows) == [".github/w.yml", "a.js", "src/__init__.py", "src/deep/er/x.go"]
    assert rows["src/__init__.py"].content == "�"
    assert {r.project for r in rows.values()} == {"q"}
    below = paths(df.option("start", "src/dist").load(str(tree)))
    assert below == ["src/dist/y.js"]


def test_many_trees_in_two_stages(spark, tree, tmp_path_factory):
    other = tmp_path_factory.mktemp("other")
    deep = other
    for k in range(12):
        deep = deep / f"d{k}"
        deep.mkdir()
        (deep / f"f{k}.js").write_text(f"x{k}")
    roots = {"q": str(tree), "r": str(other), "gone": str(other / "none")}
    rows = {(r.project, r.path): r for r in read_trees(spark, roots, partitions=5).collect()}
    own = {p for project, p in rows if project == "q"}
    assert own == {".github/w.yml", "a.js", "src/__init__.py", "src/deep/er/x.go"}
    assert rows["q", "src/__init__.py"].content == "\ufffd"
    assert sum(project == "r" for project, _ in rows) == 12
    below = read_trees(spark, {"q": str(tree)}, start="src/dist").collect()
    assert [(r.path, r.content, r.size) for r in below] == [("src/dist/y.js", "y", 1)]


def test_a_large_directory_and_a_deep_subtree_are_spread(spark, tmp_path):
    deep = tmp_path / "/".join("abcdefgh")
    deep.mkdir(parents=True)
    for k in range(10_000):
        (tmp_path / f"f{k}.js").touch()
    for k in range(400):
        (deep / f"g{k}.js").write_text("g")
    files = read_trees(spark, {"p": str(tmp_path)}, partitions=8)
    by_task = files.withColumn("task", F.spark_partition_id()).groupBy("task")
    counts = [(r.n, r.deep) for r in by_task.agg(
        F.count("*").alias("n"), F.count_if(F.col("path").startswith("a/")).alias("deep")
    ).collect()]
    assert sum(n for n, _ in counts) == 10_400 and len(counts) == 8
    assert max(n for n, _ in counts) < 2000 and max(d for _, d in counts) < 120


def test_files_of_the_binary_format(spark, tmp_path):
    for name, data in {"shop/a.js": b"1", "shop/x/b.js": b"\xff", "blog/c.py": b"2", "loose": b""}.items():
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    rows = {(r.project, r.path): (r.content, r.size) for r in from_binary_files(raw, str(tmp_path)).collect()}
    assert rows == {("shop", "a.js"): ("1", 1), ("shop", "x/b.js"): ("\ufffd", 1), ("blog", "c.py"): ("2", 1)}
    one = from_binary_files(raw, f"{tmp_path}/shop/", project="s").collect()
    assert sorted((r.project, r.path) for r in one) == [("s", "a.js"), ("s", "x/b.js")]


def test_a_subtree_filter_skips_row_groups(spark, source_files, tmp_path):
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    names = [(f"p{k % 3}", f"{'abcdef'[k % 6]}/f{k:05}.js", "x" * 500) for k in range(6000)]
    write_corpus(source_files(*names).repartition(4), str(tmp_path / "c"), row_group_bytes=64 << 10)
    groups = wanted = 0
    for file in ds.dataset(tmp_path / "c", format="parquet").files:
        meta = pq.ParquetFile(file).metadata
        rows = pq.read_table(file, columns=["project", "path"]).to_pylist()
        keys = [(r["project"], r["path"]) for r in rows]
        assert keys == sorted(keys)
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at["path"]).statistics
            owner = meta.row_group(g).column(at["project"]).statistics
            groups += 1
            wanted += owner.min <= "p1" <= owner.max and stats.min < "c0" and stats.max >= "c/"
    assert groups > 20 and wanted < groups / 3


def test_stored_facts_give_the_same(spark, tmp_path):
    from codequarry.operators.stored import read_facts, write_facts
    from codequarry.sources.sample import sample_files

    files = sample_files(spark, "/root/testdata/sf0.001")
    write_facts(files, str(tmp_path / "facts"))
    known = read_facts(spark, str(tmp_path / "facts"))
    operators = [
        mapping.map_interfaces, mapping.mapping_count, flows.interface_flows, flows.file_flows, flows.flow_counts,
    ]
    for operator in operators:
        for path in (".", "api/src"):
            fresh = sorted(r.json for r in to_json_rows(operator(files, path)).collect())
            stored = sorted(r.json for r in to_json_rows(operator(known, path)).collect())
            assert fresh == stored and fresh, (operator, path)
    assert "content" not in known.columns


@pytest.fixture(scope="module")
def corpus(spark, source_files, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("corpus") / "files")
    write_corpus(
        source_files(
            ("a.js", "express()\napp.get('/a')"), ("b.md", "text"), ("c/package.json", "{}"),
            ("d.py", "import grpc"),
        ),
        target,
    )
    return read_corpus(spark, target)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_layout_by_kind(corpus):
    assert {r.kind for r in corpus.select("kind").collect()} == {
        "javascript", "other", "package", "python",
    }
    assert len(interfaces.discover_interfaces(corpus).collect()) == 1
    assert [r.path for r in project.packages(corpus).collect()] == ["c/package.json"]


@pytest.mark.parametrize(
    "operator",
    [
        interfaces.discover_interfaces, interfaces.interfaces_full, interfaces.detect_routes,
        facts.functions, facts.imports, facts.db_operations, facts.external_apis,
        facts.analyze_files, mapping.map_interfaces, mapping.socket_handlers,
        flows.interface_flows, flows.file_flows, project.package_profiles,
    ],
)
def test_file_work_neither_joins_nor_shuffles(corpus, operator):
    physical = plan(operator(corpus))
    assert "Exchange" not in physical and "Join" not in physical
    assert physical.count("FileScan") == 1
    if operator in (mapping.socket_handlers, mapping.map_interfaces):
        assert "PartitionFilters: [isnotnull(kind" in physical or "kind#" in physical.split("PartitionFilters")[1]


def test_scans_read_what_they_need(corpus):
    names = plan(project.project_languages(corpus))
    assert "content" not in names.split("ReadSchema")[1]
    packages = plan(project.packages(corpus))
    assert "PartitionFilters: [isnotnull(kind" in packages and "package" in packages
    subtree = plan(inventory.file_inventory(corpus, "c"))
    assert "StringStartsWith(path,c/)" in subtree


def test_profiles_shuffle_once_and_combine_first(corpus):
    physical = plan(project.project_profiles(corpus))
    assert physical.count("Exchange hashpartitioning") == 1 and physical.count("FileScan") == 3
    assert physical.count("HashAggregate") == 2


def test_each_task_writes_the_texts_it_holds(spark, source_files, tmp_path):
    """Texts go from where they are to their files, without a shuffle, and are packed well."""
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    files = source_files(*[(f"d{k % 3}/f{k:03}.md", f"text {k} " * 9) for k in range(200)]).repartition(4)
    held = files.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    target = str(tmp_path / "c")
    write_corpus(files, target)
    written = [pq.ParquetFile(f).metadata for f in ds.dataset(target, format="parquet").files]
    assert sorted(m.num_rows for m in written) == sorted(r["count"] for r in held) and len(held) == 4
    names = [m.row_group(0).column(i).path_in_schema for m in written[:1] for i in range(m.num_columns)]
    assert {m.row_group(0).column(names.index("content")).compression for m in written} == {"ZSTD"}
    stored = read_corpus(spark, target).select("project", "path", "content", "size")
    assert sorted(stored.collect()) == sorted(files.select(stored.columns).collect())
    write_corpus(files, str(tmp_path / "few"), rebalance=True)
    assert len(ds.dataset(tmp_path / "few", format="parquet").files) == 1


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_sample_files_are_made_in_tasks_of_bounded_text(spark, tmp_path, monkeypatch, threshold):
    """The text grows out of small shuffled rows, so their size must not decide on the tasks."""
    from codequarry.sources import sample

    documents = [(k, "x" * 1000, None if k == 5 else 1000) for k in range(200)]
    spark.createDataFrame(documents, "doc_id long, text string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    orders = [(k, k % 7) for k in range(2000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(sample, "TASK_CHARS", 50_000, raising=False)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        files = sample.sample_files(spark, str(tmp_path))
        by_task = files.withColumn("task", F.spark_partition_id()).groupBy("task")
        sizes = [r.size for r in by_task.agg(F.sum("size").alias("size")).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert files.count() == 2000
    assert len(sizes) > 30 and max(sizes) < sum(sizes) / 8
