"""Search by the index gives the rows of search by scan, and reads less."""

from __future__ import annotations

import random

import pytest
from codequarry.operators import search_index
from codequarry.operators.search import search_files
from codequarry.operators.search_index import candidates, search_indexed, write_search_index
from codequarry.sources.corpus import SCHEMA, read_corpus, write_corpus
from codequarry.sources.sample import sample_files


def rows(df) -> list[tuple]:
    return sorted((r.project, r.path, r.matches) for r in df.collect())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("search")
    corpus, index = str(folder / "files"), str(folder / "index")
    write_corpus(sample_files(spark, "/root/testdata/sf0.001"), corpus)
    write_search_index(spark, corpus, index, block_bytes=4096)
    return corpus, index


def test_random_queries(spark, stored):
    draw = random.Random(3)
    files = read_corpus(spark, stored[0])
    texts = [r.content for r in files.where("length(content) > 20").select("content").limit(60).collect()]
    queries = ["order", "ORDER", "zz-nowhere", "x", "ab", "(", "İ", "ß", "é", "app.get("]
    for _ in range(12):
        text = draw.choice(texts)
        at = draw.randrange(len(text) - 12)
        queries.append(text[at : at + draw.choice((1, 2, 3, 4, 6, 12))])
    for q in queries:
        if q:
            wanted = rows(search_files(files, q))
            assert rows(search_indexed(spark, *stored, q)) == wanted, q
    assert rows(search_indexed(spark, *stored, "await", "api/src")) == rows(search_files(files, "await", "api/src"))


def table(spark, n: int, first: int = 0):
    files = [(f"p{k % 3}", f"d{k % 7}/f{k:05}.md", f"text of file number {k} " * 20, 1) for k in range(first, first + n)]
    return spark.createDataFrame(files, SCHEMA)


def test_files_and_pages_are_skipped(spark, tmp_path, monkeypatch):
    corpus, index = str(tmp_path / "files"), str(tmp_path / "index")
    files = table(spark, 3000)
    write_corpus(files.repartition(4), corpus, rebalance=False, row_group_bytes=1 << 16)
    write_search_index(spark, corpus, index, block_bytes=8192)
    read = candidates(spark, corpus, index, "number 2741 ")
    assert 0 < read.count() < 3000 / 10
    assert rows(search_indexed(spark, corpus, index, "number 2741 ")) == [("p2", "d4/f02741.md", 20)]
    assert candidates(spark, corpus, index, "nowhere at all").count() == 0
    # Too many blocks to list: their files, or all.
    monkeypatch.setattr(search_index, "MOST_BLOCKS", 2)
    assert rows(search_indexed(spark, corpus, index, "number 27")) == rows(search_files(files, "number 27"))
    size = sum(f.stat().st_size for f in (tmp_path / "index").glob("*.parquet"))
    assert size > 0


def test_an_index_that_is_behind_loses_nothing(spark, tmp_path):
    corpus, index = str(tmp_path / "files"), str(tmp_path / "index")
    write_corpus(table(spark, 50), corpus)
    write_search_index(spark, corpus, index)
    write_corpus(table(spark, 50, 1000), corpus, mode="append")
    both = read_corpus(spark, corpus)
    assert rows(search_indexed(spark, corpus, index, "number 10")) == rows(search_files(both, "number 10"))
    known = search_index._parts(spark, index)
    write_search_index(spark, corpus, index, mode="append")
    assert known < search_index._parts(spark, index) == search_index._listed(both)
    write_search_index(spark, corpus, index, mode="append")
    assert rows(search_indexed(spark, corpus, index, "number 10")) == rows(search_files(both, "number 10"))
    write_corpus(table(spark, 20), corpus, mode="overwrite")
    left = read_corpus(spark, corpus)
    assert rows(search_indexed(spark, corpus, index, "number 1")) == rows(search_files(left, "number 1"))
    none = str(tmp_path / "none")
    assert rows(search_indexed(spark, corpus, none, "number 1")) == rows(search_files(left, "number 1"))


def test_nulls_and_short_texts(spark, tmp_path):
    corpus, index = str(tmp_path / "files"), str(tmp_path / "index")
    files = spark.createDataFrame(
        [("p", "a", None, 0), ("p", "b", "", 0), ("p", "c", "xY", 2), ("p", "d", "xYz", 3), ("q", "a", "Éxyz", 5)], SCHEMA
    )
    write_corpus(files, corpus)
    write_search_index(spark, corpus, index)
    for q in ("xyz", "XY", "y", "éxY", "none"):
        assert rows(search_indexed(spark, corpus, index, q)) == rows(search_files(files, q))
    with pytest.raises(ValueError):
        search_indexed(spark, corpus, index, "")
