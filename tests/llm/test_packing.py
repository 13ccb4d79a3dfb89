"""Packing, sharding and mixing."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codequarry.llm import mixing, packing, sharding
from codequarry.llm.queries import tokenizer
from tests.llm.helpers import awkward, clashing, frame, prose, words


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer())


@settings(max_examples=300, deadline=None)
@given(
    st.text(
        st.sampled_from("aB1é'ß́Å \n\t\r  \x1c\x85<|>endoftextΣσİ.,\U0001f600") | st.characters(),
        max_size=40,
    )
)
def test_ids_by_stretches_are_those_of_the_whole_text(plain, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    ids = np.frombuffer(packing.encoder(tokenizer())(text), "<u4").tolist()
    assert ids == plain.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_a_text(plain):
    text = "a<|endoftext|> <|startoftext|>b  'S don't\tIT'LL"
    ids = np.frombuffer(packing.encoder(tokenizer())(text), "<u4").tolist()
    assert ids == plain.encode(text, add_special_tokens=False).ids


def best_fit(lengths: list[int], capacity: int) -> int:
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room[room.index(min(fits))] -= n
        else:
            room.append(capacity - n)
    return len(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_by_falling_length(lengths):
    counts = Counter(lengths)
    plan, opened = packing.plan_best_fit(counts, 40)
    assert opened == best_fit(lengths, 40)
    used: dict[int, list] = {}
    for (length, first, each, sequence, offset), after in zip(plan, [*plan[1:], None], strict=False):
        last = after[1] if after and after[0] == length else counts[length]
        for rank in range(first, last):
            k = rank - first
            used.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
    assert sum(map(len, used.values())) == len(lengths)
    for items in used.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 40


def test_plan_size_does_not_follow_the_number_of_documents():
    few, _ = packing.plan_best_fit({n: 3 + n % 7 for n in range(1, 4097)}, 4096)
    many, _ = packing.plan_best_fit({n: (3 + n % 7) * 10**6 for n in range(1, 4097)}, 4096)
    assert max(len(few), len(many)) < 2 * 4096 * 12


def check_packed(rows, expected, capacity):
    pieces = sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert pieces == expected
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by_sequence.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by_sequence) == best_fit([r.length for r in rows], capacity)


@pytest.mark.parametrize("rows", [prose(), awkward(), []])
def test_packing_by_brute_force(spark, plain, rows):
    capacity = 128
    expected = []
    for doc_id, text, *_ in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            expected.append((doc_id is None, doc_id or 0, k, at, len(part), zlib.crc32(part.tobytes())))
    found = packing.pack(clashing(frame(spark, rows)), tokenizer(), capacity, 1).collect()
    check_packed(found, sorted(expected), capacity)


def test_packing_with_ids_round_trip(spark, plain):
    rows = prose()[:10]
    found = packing.pack(frame(spark, rows), tokenizer(), 64, 1, with_ids=True).collect()
    for doc_id, text, *_ in rows:
        parts = sorted((r.piece, bytes(r.ids)) for r in found if r.doc_id == doc_id)
        ids = np.frombuffer(b"".join(p for _, p in parts), "<u4").tolist()
        assert ids == [*plain.encode(text, add_special_tokens=False).ids, 1]


def by_heap(loads: list[float], size: int, count: int) -> list[float]:
    loads = list(loads)
    for _ in range(count):
        loads[loads.index(min(loads))] += size
    return sorted(loads)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=8), st.integers(1, 60), st.integers(0, 400))
def test_items_of_one_size_go_to_the_least_loaded(loads, size, count):
    taken = sharding.spread([float(x) for x in loads], size, count)
    assert sum(taken) == count and min(taken) >= 0
    assert sorted(a + t * size for a, t in zip(loads, taken, strict=True)) == by_heap(loads, size, count)


@pytest.mark.parametrize("rows", [prose() + [(500 + k, "same text", None, None, None) for k in range(60)], awkward(), []])
def test_shards(spark, rows):
    found = sharding.shard_documents(clashing(frame(spark, rows)), 4).collect()
    texts = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in found) == texts
    loads, groups = [0] * 4, {}
    for shard in range(4):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    for r in found:
        loads[r.shard] += r.size
        groups.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in groups.values())
    sizes = Counter()
    for r in found:
        sizes[r.size, r.text_crc32] += r.size
    wanted = [0] * 4
    for n in sorted(sizes.values(), reverse=True):
        wanted[wanted.index(min(wanted))] += n
    # Sizes of one class count as their mean.
    assert all(abs(a - b) <= 0.01 * max(wanted, default=0) + 8 for a, b in zip(sorted(loads), sorted(wanted), strict=True))


def plain_copies(rate: float, u: float) -> int:
    p = c = np.exp(-rate)
    n = 0
    while c <= u:
        n += 1
        p *= rate / n
        c += p
    return n


def test_mixing_by_brute_force(spark):
    rows = prose() + [(900 + k, words(20, k), "en", None, 0) for k in range(30)]
    found = mixing.mix_sources(clashing(frame(spark, rows)), epochs=2.0).collect()
    rates = {r.source or "": r.rate for r in found}
    sizes = Counter()
    for r in rows:
        sizes[r[3] or ""] += len(r[1].encode()) + 1
    weight = {s: n**0.7 for s, n in sizes.items()}
    for s, rate in rates.items():
        assert rate == pytest.approx(2 * weight[s] / sum(weight.values()) * sum(sizes.values()) / sizes[s], abs=1e-6)
    seen = Counter()
    for r in found:
        assert 1 <= r["copy"] <= r.n_copies
        seen[r.doc_id] += 1
    for doc_id, _, _, source, _ in rows:
        digits = hashlib.md5(f"42|copies|{doc_id}".encode()).hexdigest()[:13]
        if (source or "") in rates:
            assert seen[doc_id] == plain_copies(rates[source or ""], int(digits, 16) / 2**52)
    assert len({r.shuffle_key for r in found}) == len(found)


def test_mixing_meets_the_target_weights(spark):
    draw = random.Random(1)
    rows = [(k, "x" * draw.randrange(50, 60), "en", "hot" if k % 3 else "rare", 0) for k in range(6000)]
    found = mixing.mix_sources(frame(spark, rows), weights={"hot": 1, "rare": 3}).collect()
    shares = Counter()
    for r in found:
        shares[r.source] += len(r.text) + 1
    total = sum(len(r[1]) + 1 for r in rows)
    assert shares["rare"] / sum(shares.values()) == pytest.approx(0.75, abs=0.02)
    assert sum(shares.values()) == pytest.approx(total, rel=0.05)


def test_mixing_high_rates_keep_their_mean(spark):
    rows = [(k, "x", "en", "a", 0) for k in range(300)] + [(1000, "x" * 100_000, "en", "b", 0)]
    found = mixing.mix_sources(frame(spark, rows), weights={"a": 1}).collect()
    assert {r.source for r in found} == {"a"}
    assert len(found) / 300 == pytest.approx((100_001 + 600) / 600, rel=0.03)


def test_mixing_awkward_and_empty(spark):
    docs = frame(spark, awkward())
    found = mixing.mix_sources(clashing(docs), epochs=4.0)
    assert {"doc_id", "text", "lang", "source", "n_chars", "spans", "rate", "copy"} <= set(found.columns)
    counts = Counter(r.doc_id for r in found.collect())
    assert counts[7] % 2 == 0
    assert mixing.mix_sources(frame(spark, [])).collect() == []
