"""Stored facts after edits are those written from scratch, and only changed files are read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codequarry.operators import flows, mapping, stored
from codequarry.operators.stored import Refreshed, read_facts, refresh_facts, write_facts
from codequarry.sources.corpus import SCHEMA, read_corpus, to_json_rows, write_corpus


def text(k: int, change: int = 0) -> str:
    return f"const express = require('express')\napp.get('/a{k}/{change}', f)\nUser.find()\n"


def rows(df) -> list[str]:
    return sorted(r.json for r in to_json_rows(df).collect())


def table(spark, known: dict[tuple, str | None]):
    files = [(p, f, t, len(t or "")) for (p, f), t in known.items()]
    return spark.createDataFrame(files, SCHEMA)


def everything(facts) -> list[str]:
    return rows(facts) + rows(flows.file_flows(facts)) + rows(mapping.map_interfaces(facts))


@pytest.fixture
def analysed(monkeypatch):
    """How many texts each analysis was given."""
    counts = []
    plain = stored.analyse

    def counting(files, *args, **how):
        counts.append(files.count())
        return plain(files, *args, **how)

    monkeypatch.setattr(stored, "analyse", counting)
    return counts


def edits():
    start = {(p, f"src/f{k}.js"): text(k) for p in ("a", "b") for k in range(40)}
    start |= {("a", "m.py"): "import os\n", ("a", "x.go"): "package x", ("a", "dist/y.js"): text(1)}
    start |= {("a", "README.md"): "text", ("b", "null.js"): None}
    same = dict(start)
    changed = {**same, ("a", "src/f1.js"): text(1, 1), ("b", "null.js"): text(7)}
    added = {**changed, ("a", "new.rs"): "use warp::Filter;", ("c", "src/f1.js"): text(1), ("c", "n.md"): ""}
    deleted = {k: v for k, v in added.items() if k not in {("b", "src/f3.js"), ("a", "x.go")}}
    moved = {**{k: v for k, v in deleted.items() if k != ("a", "src/f5.js")}, ("a", "src/g5.js"): text(5)}
    return [
        (start, None),
        (same, Refreshed(0, 0, 0, 83, 0)),
        (changed, Refreshed(0, 2, 0, 81, 2)),
        (added, Refreshed(2, 0, 0, 83, 2)),
        (deleted, Refreshed(0, 0, 2, 83, 2)),
        (moved, Refreshed(1, 0, 1, 82, 2)),
        ({}, Refreshed(0, 0, 83, 0, None)),
        (start, Refreshed(83, 0, 0, 0, None)),
    ]


def test_edits_give_what_writing_anew_gives(spark, tmp_path, analysed):
    target = str(tmp_path / "facts")
    for step, (known, done) in enumerate(edits()):
        files = table(spark, known)
        if done is None:
            write_facts(files, target)
        else:
            found = refresh_facts(files, target)
            wanted = (done.added, done.changed, done.deleted, done.unchanged)
            assert (found.added, found.changed, found.deleted, found.unchanged) == wanted
            assert done.rewritten is None or found.rewritten <= done.rewritten
            assert analysed.pop() == done.added + done.changed if done.added + done.changed else not analysed
        analysed.clear()
        if known:
            anew = str(tmp_path / f"anew{step}")
            write_facts(files, anew)
            shown = everything if step == len(edits()) - 1 else rows
            assert shown(read_facts(spark, target)) == shown(read_facts(spark, anew))
        else:
            assert rows(read_facts(spark, target)) == []
        analysed.clear()


def test_texts_are_not_read_to_compare(spark, tmp_path, analysed):
    """With a corpus, digests are read and no contents; of changed files alone the contents."""
    target, corpus = str(tmp_path / "facts"), str(tmp_path / "corpus")
    known = edits()[0][0]
    write_corpus(table(spark, known), corpus)
    write_facts(read_corpus(spark, corpus), target)
    known[("a", "src/f9.js")] = text(9, 9)
    write_corpus(table(spark, known), corpus, mode="overwrite")
    files = read_corpus(spark, corpus)
    plan = stored._keys(files, ".", 16)._jdf.queryExecution().executedPlan().toString()
    assert "digest" in plan.split("ReadSchema")[1] and "content" not in plan.split("ReadSchema")[1]
    analysed.clear()
    assert refresh_facts(files, target) == Refreshed(0, 1, 0, 82, 1)
    assert analysed == [1]
    assert any("/a9/9" in r for r in rows(mapping.map_interfaces(read_facts(spark, target))))


def test_half_a_refresh_is_put_right_by_the_next(spark, tmp_path):
    """A directory lost on the way counts as files to add."""
    import shutil

    target = tmp_path / "facts"
    files = table(spark, edits()[0][0])
    write_facts(files, str(target))
    before = rows(read_facts(spark, str(target)))
    gone = sorted((target / "kind=javascript").glob("bucket=*"))[0]
    shutil.move(gone, tmp_path / "gone")
    found = refresh_facts(files, str(target))
    assert found.added > 0 and found.rewritten == 1
    assert rows(read_facts(spark, str(target))) == before


def test_many_changes_and_a_subtree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "LISTED", 1)
    target = str(tmp_path / "facts")
    files = table(spark, edits()[0][0])
    write_facts(files, target, "src", buckets=3)
    other = files.withColumn("content", F.concat("content", F.lit("\nOther.find()\n")))
    found = refresh_facts(other, target, "src")
    assert (found.changed, found.added, found.deleted) == (80, 0, 0) and found.rewritten <= 3
    write_facts(other, str(tmp_path / "anew"), "src")
    assert rows(read_facts(spark, target)) == rows(read_facts(spark, str(tmp_path / "anew")))
