"""Language ID, quality and PII, and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from codequarry.llm import language, linear, pii, quality, queries
from codequarry.llm.common import table
from tests.llm.helpers import awkward, clashing, frame, words

TABLES = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(TABLES).exists(), reason="no test tables")


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    spans = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append((3, *m.span()))
    return spans


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("@.+-%_ ()ab01259é\n"), max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_by_hand():
    text = "é a.b@c-d.co.uk, 1.2.3.256 10.0.0.1.5.6.7.8 4465 7588-8243 8937 +1 (743) 555-3824 x@y"
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in pii.base_spans(text)] == [
        (pii.KINDS[k], text[s:e]) for k, s, e in plain_spans(text)
    ]
    assert pii.base_spans("9" * 50_000 + "." * 50_000 + "@" * 50_000) == []


def test_terms_that_give_an_entity_away(spark):
    draw = random.Random(2)
    rows = []
    for k in range(200):
        text = words(40, k)
        if k < 8:  # the same entity in eight different contexts, a tell-tale word in each
            text += f" {words(3, 1000 + k)} zephyr mail joe@example.com {words(5, 2000 + k)} {words(20, k + 50)} Zephyr"
        elif k < 80:
            text += f" mail me{draw.random()}@example.com now"
        rows.append((k, text, "en", "a", len(text)))
    found = {r.doc_id: r for r in pii.find(clashing(frame(spark, rows))).collect()}
    for k, text, *_ in rows:
        base = ",".join(f"{pii.KINDS[a]}:{s}:{e}" for a, s, e in plain_spans(text))
        assert found[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert found[k].spans.startswith(base) and found[k].n_email == base.count("email")
        told = [x.split(":")[1:] for x in found[k].spans.split(",") if x.startswith("term")]
        shown = [text[int(s) : int(e)] for s, e in told]
        assert shown == (["zephyr", "Zephyr"] if k < 8 else [])
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert "phyr" not in clean[0] and "joe@" not in clean[0] and "[email]" in clean[0]
    assert all(clean[k] == text for k, text, *_ in rows if k >= 80)


def test_copies_of_one_context_prove_nothing(spark):
    text = "call zephyr " + words(30, 5) + " mail joe@example.com " + words(30, 6)
    rows = [(k, text, "en", "a", 0) for k in range(30)] + [(100 + k, words(30, k), "en", "a", 0) for k in range(60)]
    assert not any("term" in r.spans for r in pii.find(frame(spark, rows)).collect())


def test_pii_awkward_and_empty(spark):
    found = pii.find(clashing(frame(spark, awkward()))).collect()
    assert len(found) == len(awkward())
    assert {r.spans for r in found if r.doc_id == 4} == {"email:14:20,ip:4:11"}
    assert {r.spans for r in found if r.doc_id != 4} == {""}
    clean = pii.sanitise(clashing(frame(spark, awkward())))
    assert clean.columns == [c for c in clashing(frame(spark, awkward())).columns if c != "TEXT"]
    texts = sorted((r.text or "" for r in clean.collect()), key=len)
    wanted = sorted((r[1] or "" for r in awkward() if r[0] != 4), key=len)
    assert [t for t in texts if "[ip]" in t] == ["Ünï [ip] \U0001f600 [email]"]
    assert [t for t in texts if "[ip]" not in t] == wanted
    assert pii.find(frame(spark, [])).collect() == []
    assert pii.sanitise(frame(spark, [])).collect() == []


@needs_tables
def test_language_on_held_out_documents(spark):
    docs = table(spark, TABLES, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    found = queries.op6_language_id(spark, TABLES).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) / len(held) > 0.95


def test_language_awkward_and_empty(spark):
    found = language.language_id(clashing(frame(spark, awkward()))).collect()
    assert len(found) == len(awkward())
    by = {(r.doc_id, r.lang_pred) for r in found}
    assert {(1, "und"), (2, "und"), (3, "und")} <= by
    assert {r.lang_pred for r in found} <= {"en", "de", "und"}
    assert language.language_id(frame(spark, [])).collect() == []
    unknown = language.language_id(frame(spark, [(5, "abc", None, None, None)])).collect()
    assert unknown[0].lang_pred == "und"


def test_document_frequencies_by_hand(spark):
    texts = ["ab", "ab ab", "b"]
    counts, total = language.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert total == 3
    wanted = np.zeros(1 << language.BITS, int)
    for t in texts:
        wanted[list(set(np.concatenate(list(language.grams(t))).tolist()))] += 1
    assert (counts == wanted).all()


def test_ftrl_is_sparse_and_calibrated():
    draw = np.random.default_rng(1)
    rows, labels = [], []
    for k in range(600):
        y = k % 3
        noise = draw.integers(10, 1000, 20)
        rows.append((np.unique(np.append(noise, [y, y + 3][k % 2])), None))
        rows[-1] = (rows[-1][0], np.ones(len(rows[-1][0])))
        labels.append(y)
    model = linear.Ftrl(1000, 3, l1=2.0).fit(rows[:400], labels[:400])
    scores = model.scores(rows[400:])
    assert (scores.argmax(1) == labels[400:]).mean() > 0.95
    weights, _ = model.parameters()
    assert (weights == 0).all(axis=1).mean() > 0.3
    noisy = np.array([(y + (k % 10 == 0)) % 3 for k, y in enumerate(labels[400:])])
    heat = linear.temperature(scores, noisy)
    assert linear.temperature(scores * 5, noisy) == pytest.approx(5 * heat, rel=0.01)
    sure = linear.softmax(scores / heat).max(axis=1).mean()
    assert sure == pytest.approx((scores.argmax(1) == noisy).mean(), abs=0.05)


@needs_tables
def test_quality_against_labels(spark):
    tables = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality == 1 and r.toxic != 1 for r in table(spark, tables, "labels").collect()}
    found = {r.doc_id: r for r in queries.op7_quality_classifier(spark, tables).collect()}
    assert len(found) == table(spark, tables, "documents").count()
    good = [found[k].accepted for k, v in labels.items() if v]
    bad = [found[k].accepted for k, v in labels.items() if not v]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.15


def test_quality_awkward_and_empty(spark):
    docs = frame(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality.classify(clashing(docs), none).collect()
    assert len(found) == len(awkward()) and all(r.accepted for r in found)
    rows = [(k, ("good " if k % 2 else "bad ") * 5 + words(20, k), "en", "a", 10) for k in range(60)]
    labels = [(k, k % 2, None) for k in range(60)] + [(None, 1, 1), (7, None, 1), (3, 1, 0), (7, 7, 7)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    both = frame(spark, [*rows, *awkward()])
    scored = quality.classify(both.withColumn("accepted", both["n_chars"]), labels).collect()
    assert len(scored) == 60 + len(awkward()) and all(0 <= r.quality_score <= 1 for r in scored)
    assert quality.classify(frame(spark, []), labels).collect() == []


def test_co_training_teaches_across_views():
    draw = np.random.default_rng(5)

    def rows(n):
        truth = draw.integers(0, 2, n)
        content = [np.unique(np.append(draw.integers(100, 4000, 10), y)).astype(np.int32) for y in truth]
        metadata = [np.unique(np.append(draw.integers(100, 200, 4), 10 + y)).astype(np.int32) for y in truth]
        return truth.tolist(), content, metadata

    truth, content, metadata = rows(80)
    _, pool_content, pool_metadata = rows(300)
    model = quality.co_train((content, metadata), truth, (pool_content, pool_metadata))
    truth, content, metadata = rows(300)
    right = [(model.score(c, m) >= 0.5) == y for y, c, m in zip(truth, content, metadata, strict=True)]
    assert np.mean(right) > 0.95


@needs_tables
def test_pipeline_stages_by_hand(spark):
    docs = table(spark, TABLES, "documents")
    columns = docs.columns
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        made[name] = (docs.toPandas(), stage(spark, docs, TABLES))
        docs = made[name][1].cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == list(made)
    for name, (_, out) in list(made.items())[:-1]:
        assert out.columns == columns, name
    after = {n: out.toPandas() for n, (_, out) in made.items()}
    scores = queries.op7_quality_classifier(spark, TABLES).toPandas()
    assert set(after["quality_classifier"].doc_id) == set(scores.doc_id[scores.accepted])
    before = made["simhash_near_dedup"][0]
    from codequarry.llm.simhash import fingerprint
    from tests.llm.helpers import groups

    prints = {r.doc_id: fingerprint(r.text) for r in before.itertuples()}
    roots = groups(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    assert set(after["simhash_near_dedup"].doc_id) == set(roots.values())
    clean = after["pii_removal"]
    assert all(not plain_spans(t) for t in clean.text) and (clean.text.str.len() == clean.n_chars).all()
    assert set(after["mix_sources"].doc_id) <= set(clean.doc_id)
    pieces = after["best_fit_packing"]
    assert len(pieces[pieces.piece == 0]) == len(after["mix_sources"])
    docs.unpersist()
