"""Evidence stored with the corpus: no rule loses a row, and files without it are not opened."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codequarry.operators import flows, interfaces, mapping
from codequarry.rules import DETECTORS, evidence
from codequarry.sources.corpus import SCHEMA, read_corpus, to_json_rows, write_corpus
from codequarry.sources.sample import sample_files


def test_every_rule_has_words():
    assert {*evidence.WORDS, *evidence.LOWER_WORDS} == {d.name for d in DETECTORS}
    assert all(w == w.lower() for words in evidence.LOWER_WORDS.values() for w in words)
    assert max(sum(rules.values()) for rules in evidence.BITS.values()) < 128


@pytest.fixture(scope="module")
def files(spark):
    return sample_files(spark, "/root/testdata/sf0.001").cache()


@pytest.fixture(scope="module")
def corpus(spark, files, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("evidence") / "files")
    write_corpus(files, target)
    return read_corpus(spark, target)


def rows(df) -> list[str]:
    return sorted(r.json for r in to_json_rows(df).collect())


def test_no_rows_without_evidence(files):
    """A rule that finds rows in a file has its bit set there."""
    marked = files.withColumn("bits", evidence.evidence(F.col("path"), F.col("content")))
    found = interfaces.discover_interfaces(files).select("project", F.col("file").alias("path"), "framework", "language")
    held = found.join(marked, ["project", "path"]).select("language", "framework", "bits").distinct().collect()
    assert len({r.framework for r in held}) >= 35
    assert all(r.bits for r in held)


@pytest.mark.parametrize("name", [d.name for d in DETECTORS])
def test_rules_give_the_same(files, corpus, name):
    one = interfaces.detectors_named(name)
    fresh = rows(interfaces.discover_interfaces(files, detectors=one))
    assert rows(interfaces.discover_interfaces(corpus, detectors=one)) == fresh and fresh


@pytest.mark.parametrize(
    "operator",
    [
        interfaces.discover_interfaces, interfaces.interfaces_full, interfaces.interface_count,
        mapping.map_interfaces, mapping.mapping_count, flows.interface_flows, flows.file_flows, flows.flow_counts,
    ],
)
def test_operators_give_the_same(files, corpus, operator):
    for path in (".", "api/src"):
        assert rows(operator(corpus, path)) == rows(operator(files, path))


def scanned(df) -> dict[str, int]:
    """What the scan of a query read."""
    df.write.format("noop").mode("overwrite").save()
    query = df._jdf.queryExecution()
    query.executedPlan().executeCollect()
    nodes, found = [query.executedPlan()], {}
    while nodes:
        node = nodes.pop()
        metrics = node.metrics()
        for name in ("numFiles", "numOutputRows"):
            if node.nodeName().startswith("Scan parquet") and metrics.contains(name):
                found[name] = metrics.apply(name).value()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return found


def test_files_without_evidence_are_not_opened(corpus):
    read = scanned(interfaces.discover_interfaces(corpus, detectors=interfaces.detectors_named("warp")))
    rust = corpus.where("kind = 'rust'")
    holding = rust.where(F.col("content").contains("warp::")).count()
    assert 0 < read["numOutputRows"] == holding < rust.count() / 2
    everything = corpus.where("kind not in ('other', 'package')").count()
    assert scanned(interfaces.discover_interfaces(corpus))["numOutputRows"] < everything


def test_other_corpora_are_read_whole(spark, files, tmp_path):
    """A table without the numbers, or with those of other words, has all its files read."""
    other = files.withColumns({"kind": F.lit("rust"), "evidence_00000000": F.lit(0)})
    found = interfaces.discover_interfaces(other, detectors=interfaces.detectors_named("warp"))
    assert rows(found) == rows(
        interfaces.discover_interfaces(files, detectors=interfaces.detectors_named("warp"))
    )


def test_few_paths_skip_pages_of_a_stored_corpus(spark, tmp_path):
    """Wanted files are compared one by one, so most row groups are not read."""
    from codequarry.operators.inventory import read_files

    rows_ = [(f"p{k % 5}", f"d{k % 11}/f{k:05}.md", f"text {k} " * 60, 1) for k in range(6000)]
    files = spark.createDataFrame(rows_, SCHEMA)
    target = str(tmp_path / "files")
    write_corpus(files, target, row_group_bytes=1 << 15)
    stored = read_corpus(spark, target)
    wanted = spark.createDataFrame(
        [r[:2] for r in rows_[::1500]] + [("p0", "none.md"), (None, "x"), ("p1", "a.py")], "project string, path string"
    )
    found = read_files(stored, wanted)
    assert sorted((r.project, r.path, r.content) for r in found.collect()) == sorted(r[:3] for r in rows_[::1500])
    assert scanned(found)["numOutputRows"] < 6000 / 4
    many = read_files(stored, wanted, listed=2)
    assert sorted(r.path for r in many.collect()) == sorted(r.path for r in found.collect())
    assert read_files(stored, wanted.limit(0)).count() == 0
