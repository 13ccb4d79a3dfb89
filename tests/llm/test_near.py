"""SimHash, embedding and edit-embedding near-duplicates, and substring dedup."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codequarry.llm import embeddings, fingerprints, simhash, substrings
from codequarry.llm.common import Scratch, components, rank_within, word_hashes
from tests.llm.helpers import WORD, awkward, clashing, frame, groups, prose, words


def plain_simhash(text: str | None) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = WORD.findall(lowered)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for text in [r[1] for r in prose()[:12]] + [None, "", " ", "A", "a B", "É a\x0bB\x1fc d", "a " * 50]:
        assert simhash.fingerprint(text) == plain_simhash(text)


def test_fingerprint_of_many_shingles_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "_SHINGLES_AT_ONCE", 7)
    assert simhash.fingerprint(words(100, 5)) == plain_simhash(words(100, 5))


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_ball_links_connect_what_is_within_the_radius(spark, radius):
    draw = random.Random(radius)
    seeds = [draw.getrandbits(64) for _ in range(4)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(12):
            for _ in range(draw.randrange(1, 6)):
                s ^= 1 << draw.randrange(64)
            prints.add(s)
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(b,) for b in signed], "bits long")
    pairs = {(r.a, r.b) for r in simhash.near_links(table, radius).collect()}

    def bits(a: int, b: int) -> int:
        return bin((a ^ b) & (2**64 - 1)).count("1")

    assert all(bits(a, b) <= radius and a != b for a, b in pairs)
    wanted = groups(signed, lambda a, b: bits(a, b) <= radius)
    assert groups(signed, lambda a, b: (a, b) in pairs or (b, a) in pairs) == wanted


def test_simhash_groups_by_brute_force(spark):
    rows = prose() + [(90, None, "x", "y", 0), (91, " ", None, None, None)]
    found = simhash.near_duplicates(clashing(frame(spark, rows))).collect()
    prints = {r[0]: plain_simhash(r[1]) for r in rows}
    wanted = groups(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    assert {r.doc_id: r.component_id for r in found} == wanted
    assert {r.doc_id: r.kept for r in found} == {k: k == v for k, v in wanted.items()}
    assert wanted[91] == 90 and len(set(wanted.values())) < len(wanted)


def test_simhash_awkward_and_empty(spark):
    found = simhash.near_duplicates(frame(spark, awkward())).collect()
    assert len(found) == len(awkward())
    assert {r.component_id for r in found if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


def test_components_of_chains_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 30)]
    edges += [(200, 201), (201, 202), (202, 200), (7, 7), (300, 300)]
    scratch = Scratch(spark)
    found = components(spark.createDataFrame(edges, "a long, b long"), scratch, "c").collect()
    roots = {r.node: r.root for r in found}
    assert {k: roots.get(k, k) for k in range(100, 161)} == dict.fromkeys(range(100, 161), 100)
    assert {roots[k] for k in range(6, 30)} == {5} and roots[202] == roots[201] == 200


def test_ranks_have_no_gaps_within_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 7).cast("long").alias("k"))
    ranked = rank_within(rows.repartition(5), "k", Scratch(spark), "r").toPandas()
    assert all(sorted(g) == list(range(len(g))) for _, g in ranked.groupby("k")["rank"])
    assert len(ranked) == 5000


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def plain_links(rows):
    fine = {}
    for k, e, label in rows:
        ok = e and label is not None and all(x is not None and math.isfinite(x) for x in e) and any(e)
        if ok:
            fine[k] = (np.array(e, np.float32).astype(float), label)

    def linked(a, b):
        if a not in fine or b not in fine or fine[a][1] != fine[b][1] or len(fine[a][0]) != len(fine[b][0]):
            return False
        x, y = fine[a][0], fine[b][0]
        return x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.98

    return linked


def test_embedding_links_by_brute_force(spark):
    draw = np.random.default_rng(3)
    rows = []
    for k in range(30):
        centre = draw.normal(size=12)
        for j in range(10):
            noise = draw.normal(size=12) * draw.choice([0, 0.05, 0.12, 0.2])
            rows.append((10 * k + j, ((centre + noise) * draw.choice([1, 3])).tolist(), int(k % 3)))
    rows += [(1000 + k, rows[5][1], rows[5][2]) for k in range(40)]
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [0.0] * 12, [None] + [1.0] * 11, [inf] + [1.0] * 11, [nan] * 12, [1.0, 2.0], [1.0, 2.0]]
    rows += [(2000 + k, e, 0) for k, e in enumerate(odd)] + [(3000, rows[0][1], None)]
    linked = plain_links(rows)
    ids = sorted(r[0] for r in rows)
    found = embeddings.near_duplicates(clashing(vectors(spark, rows)), block_rows=16).collect()
    assert {r.vec_id: r.n_links for r in found} == {a: sum(a != b and linked(a, b) for b in ids) for a in ids}
    wanted = groups(ids, linked)
    assert {r.vec_id: r.component_id for r in found} == wanted
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_embeddings_without_any_usable(spark):
    assert embeddings.near_duplicates(vectors(spark, [])).collect() == []
    found = embeddings.near_duplicates(vectors(spark, [(1, None, 1), (None, [0.0], 1)])).collect()
    assert [r.n_links for r in found] == [0, 0]


def plain_removal(rows: list[tuple], window: int) -> list[tuple]:
    """In the order of rows: kept words of each."""
    seen, gone = set(), []
    for k, (_, text) in enumerate(rows):
        found = WORD.findall(text or "")
        for i in range(len(found) - window + 1):
            key = tuple(found[i : i + window])
            if key in seen:
                gone.append((k, i))
            seen.add(key)
    out = []
    for k, (doc_id, text) in enumerate(rows):
        found = WORD.findall(text or "")
        lost = {i + j for d, i in gone if d == k for j in range(window)}
        out.append((doc_id, len(found), len(lost), " ".join(w for i, w in enumerate(found) if i not in lost)))
    return out


@pytest.mark.parametrize("window", [4, 20])
def test_repeats_by_brute_force(spark, window):
    rows = prose()
    rows.append((50, " ".join([words(25, 77)] * 3) + " tail", "en", "a", 0))
    rows.append((51, "a " * 70 + words(19, 78), "en", "a", 0))
    rows.append((52, None, None, None, None))
    found = substrings.remove_repeats(clashing(frame(spark, rows)), window).collect()
    wanted = plain_removal([r[:2] for r in sorted(rows)], window)
    assert sorted(tuple(r) for r in found) == wanted
    assert sum(r[2] for r in wanted) > 300


def test_repeats_settled_in_small_batches(spark, monkeypatch):
    text = words(300, 8)
    rows = [(k, f"{words(k + 1, 900 + k)} {text}", "en", "a", 0) for k in range(30)]
    found = substrings.remove_repeats(frame(spark, rows), 20).collect()
    assert sorted(tuple(r) for r in found) == plain_removal([r[:2] for r in rows], 20)


def test_repeats_awkward_and_empty(spark):
    found = substrings.remove_repeats(frame(spark, awkward()), 20, digest=True).collect()
    assert len(found) == len(awkward())
    gone = {(r.doc_id, r.n_words): r.n_removed for r in found}
    assert gone[6, 30_000] == 30_000 and gone[5, 30_000] < 30_000
    assert {r.kept for r in found if r.doc_id in (1, 2, 3)} == {hashlib.sha256(b"").hexdigest()}
    both = sorted(r.n_removed for r in found if r.doc_id == 8)
    assert both == [0, 50]
    assert substrings.remove_repeats(frame(spark, []), 20).collect() == []


def test_every_alignment_shares_an_anchor():
    for window in (1, 2, 5, 12, 20, 50):
        period, cover, length = substrings.cover_for(window)
        for i in range(period):
            for j in range(period):
                assert any(
                    (i + d) % period in cover and (j + d) % period in cover
                    for d in range(window - length + 1)
                )


def test_word_hashes_by_blocks(monkeypatch):
    from codequarry.llm import common

    data = (words(5000, 6) + " \n\t" + "y" * 900 + " é\x1c z").encode()
    whole = word_hashes(data)
    monkeypatch.setattr(common, "_BLOCK", 64)
    parts = word_hashes(data)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert [data[s:e] for s, e in zip(whole[1], whole[2], strict=True)] == data.split()
    known = dict(zip(data.split(), whole[0].tolist(), strict=True))
    assert len(set(known.values())) == len(known)
    assert all(known[w] == h for w, h in zip(data.split(), whole[0].tolist(), strict=True))


def test_likeness_follows_edits():
    draw = random.Random(4)
    text = "".join(draw.choice("abcdefghij ") for _ in range(3000))
    other = "".join(draw.choice("abcdefghij ") for _ in range(3000))
    little = text[:1000] + "X" + text[1001:2000] + text[2003:]
    half = text[:1500] + other[:1500]
    a, b, c, d, e, none = fingerprints.embed([text, little, half, other, text, ""])
    n = len(text)
    near = [
        fingerprints.likeness(n, a, len(t), x)
        for t, x in ((text, e), (little, b), (half, c), (other, d))
    ]
    assert near[0] == 1 and near[1] > near[2] > near[3] and near[1] > 0.7 and near[3] < 0.2
    assert fingerprints.from_string(fingerprints.to_string(n, a))[0] == n
    assert fingerprints.likeness(0, none, n, a) == 0 and fingerprints.likeness(0, none, 0, none) == 1
    alone = fingerprints.embed([text])[0]
    assert (alone == a).all()


def plain_next(rows: list[tuple[int, str | None]]) -> dict:
    order = sorted(rows, reverse=True)
    out = {}
    for (k, text), (_, other) in zip(order, order[1:] + order[:1], strict=True):
        text, other = text or "", other or ""
        n = len(text)
        edited = text[: n - n // 2] + other[: n // 2]
        out[k] = (n, hashlib.sha256(edited.encode()).hexdigest())
    return out


def test_edited_texts_by_brute_force(spark):
    rows = prose() + [(77, None, "x", "y", 0), (5000, "\U0001f600 short", "x", "y", 0)]
    found = fingerprints.compare_with_next(clashing(frame(spark, rows))).collect()
    wanted = plain_next([r[:2] for r in rows])
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in found} == wanted and len(found) == len(rows)
    by_text: dict = {}
    for r in found:
        by_text.setdefault(dict((x[0], x[1]) for x in rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len(by_text) < len(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def test_edited_texts_awkward_and_empty(spark):
    found = fingerprints.compare_with_next(frame(spark, awkward())).collect()
    assert len(found) == len(awkward())
    assert fingerprints.compare_with_next(frame(spark, [])).collect() == []
    alone = fingerprints.compare_with_next(frame(spark, [(3, "abcd", None, None, None)])).collect()
    assert alone[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone[0].near_next == 1


def test_edit_near_duplicates(spark):
    base = [words(150, 40 + k) for k in range(6)]
    rows = [(k, t, "en", "a", 0) for k, t in enumerate(base)]
    rows += [(10 + k, t[:300] + "!" + t[300:], "en", "a", 0) for k, t in enumerate(base)]
    rows += [(20 + k, base[0], "en", "a", 0) for k in range(5)] + [(40, None, None, None, None)]
    found = fingerprints.near_duplicates(frame(spark, rows), least=0.5, block_rows=2).collect()
    root = {r.doc_id: r.component_id for r in found}
    assert all(root[20 + k] == 0 for k in range(5)) and root[40] == 40
    assert [root[k] for k in range(6)] == list(range(6))
    prints = {r.doc_id: fingerprints.from_string(r.fingerprint) for r in found}
    for k in range(6):
        near = fingerprints.likeness(*prints[k], *prints[10 + k]) >= 0.5
        assert (root[10 + k] == k) == near
    assert sum(root[10 + k] == k for k in range(6)) >= 4
