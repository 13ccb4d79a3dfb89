"""Terms that give rare entities away."""

from __future__ import annotations

import math
import random
import time

import pytest

from codequarry.llm import pii
from tests.llm.helpers import frame, words


def shown(found, rows) -> dict:
    texts = {r[0]: r[1] for r in rows}
    out = {}
    for r in found:
        told = [x.split(":")[1:] for x in r.spans.split(",") if x.startswith("term")]
        out[r.doc_id] = [texts[r.doc_id][int(s) : int(e)] for s, e in told]
    return out


def test_rare_entities_are_given_away_too(spark):
    rows = []
    for k in range(400):
        text = words(40, k)
        if k == 0:  # one context only
            text += " zephyr mail ann@one.example now"
        elif k < 21:  # a signature copied into twenty documents
            text += f" {words(8, 3)} signed quixote bob@two.example {words(8, 4)}"
        elif k < 31:  # one context each, a word that all entities of the class share
            text += f" acme mail user{k}@acme.example now"
        elif k < 300:
            text += f" mail me{k}@common.example now"
        rows.append((k, text, "en", "a", len(text)))
    found = shown(pii.find(frame(spark, rows)).collect(), rows)
    assert found[0] == ["zephyr"]
    assert all({"signed", "quixote"} <= set(found[k]) for k in range(1, 21))
    assert all(found[k] == ["acme"] for k in range(21, 31))
    assert all(found[k] == [] for k in range(31, 400))
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert "zephyr" not in clean[0] and "quixote" not in clean[5] and "acme" not in clean[25]


def test_work_in_proportion_to_entities_of_one_text():
    """Twice the entities beside one word make twice the rows, in about twice the time."""
    sizes, spent = [], []
    for n in (10_000, 20_000):
        text = " ".join(f"from u{k}@x.com" for k in range(n))
        began = time.perf_counter()
        near, places = pii.contexts(text, pii.base_spans(text))
        spent.append(time.perf_counter() - began)
        sizes.append(sum(len(t) for _, _, t in near) + sum(len(p) for p in places.values()))
        assert len(near) == n and len(places) == 1
    assert sizes[1] == 2 * sizes[0] and spent[1] < 3 * spent[0] + 0.5


def test_a_text_of_many_entities(spark):
    text = " ".join(f"from u{k}@x.com" for k in range(60_000))
    rows = [(0, text, "en", "a", len(text)), (1, "from here", "en", "a", 9)]
    began = time.perf_counter()
    found = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    assert found[0].n_email == 60_000 and time.perf_counter() - began < 60


def test_letters_that_change_length_in_lower_case(spark):
    """`İstanbul` is one word, before a text is in lower case and after."""
    rows = [(k, words(40, k), "en", "a", 0) for k in range(300)]
    rows += [(300 + k, f"{words(20, k)} İstanbul ann@one.example x", "en", "a", 0) for k in range(12)]
    found = shown(pii.find(frame(spark, rows)).collect(), rows)
    assert all("İstanbul" in found[300 + k] for k in range(12))


def plain_class(name: str) -> str:
    kind, value = name.split(":")
    return {
        "email": "email:" + value.rsplit("@", 1)[-1],
        "ip": "ip:" + ".".join(value.split(".")[:2]),
        "card": "card:" + value[:6],
        "phone": "phone:" + value[:4],
    }[kind]


def plain_revealing(docs: dict[int, str], disclosure: float, prior: float) -> set[tuple[str, str]]:
    """The definition over sets of contexts, one pair at a time."""
    spoken = {k: {w.lower() for w in pii._WORD.findall(t)} for k, t in docs.items()}
    seen: dict[str, set] = {}
    held: dict[str, set] = {}
    for k, text in docs.items():
        spans = pii.base_spans(text)
        free = [
            m for m in pii._WORD.finditer(text)
            if not any(s < m.end() and m.start() < e for _, s, e in spans)
        ]
        for kind, s, e in spans:
            before = [m[0].lower() for m in free if m.start() < s][-pii.REACH :]
            behind = [m[0].lower() for m in free if m.start() >= e][: pii.REACH]
            around = tuple(before + behind)
            if any(not w.isdigit() for w in around):
                name = pii.entity(kind, text[s:e])
                seen.setdefault(name, set()).add(around)
                held.setdefault(name, set()).add(k)
    out = set()
    for name, around in seen.items():
        alike = [n for n in seen if plain_class(n) == plain_class(name)]
        for word in {w for c in around for w in c if not w.isdigit()}:
            base = sum(word in s for s in spoken.values()) / len(docs)
            of_all = sum(word in c for n in alike for c in seen[n])
            together = sum(word in c for c in around)
            others = sum(len(seen[n]) for n in alike) - len(around)
            of_class = (of_all - together + prior * base) / (others + prior)
            share = (together + prior * of_class) / (len(around) + prior)
            needed = disclosure * math.log2(len(docs) / len(held[name]))
            told = math.log2(share / base)
            if abs(told - needed) > 1e-9 and needed > 0 and -math.log2(base) >= needed and told >= needed:
                out.add((name, word))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_flagged_terms_by_brute_force(spark, seed):
    draw = random.Random(seed)
    people = ["ann@one.example", "bob@one.example", "cy@two.example", "10.1.2.3", "10.1.9.9", "+1 555 123 4567"]
    docs = {}
    for k in range(120):
        said = [f"w{draw.randrange(60)}" for _ in range(draw.randrange(0, 25))]
        for p in draw.sample(people, draw.choice((0, 0, 1, 1, 2))):
            tell = [f"tell{people.index(p)}"] * draw.randrange(2) + ["12"] * draw.randrange(2)
            said[len(said) // 2 : len(said) // 2] = [*tell, p]
        docs[k] = " ".join(said)
    rows = [(k, t, "en", "a", 0) for k, t in docs.items()]
    want = plain_revealing(docs, pii.DISCLOSURE, pii.PRIOR)
    found = shown(pii.find(frame(spark, rows)).collect(), rows)
    for k, text in docs.items():
        here = {pii.entity(kind, text[s:e]) for kind, s, e in pii.base_spans(text)}
        near = {w for n, w in want if n in here}
        ours = {w.lower() for w in found[k]}
        # A flagged word goes everywhere in a text that has it near the entity.
        assert ours <= near
        assert {w for n, w in want if n in here and _beside(text, n, w)} == ours
    assert any(found.values())


def _beside(text: str, name: str, word: str) -> bool:
    spans = pii.base_spans(text)
    free = [m for m in pii._WORD.finditer(text) if not any(s < m.end() and m.start() < e for _, s, e in spans)]
    for kind, s, e in spans:
        if pii.entity(kind, text[s:e]) == name:
            before = [m[0].lower() for m in free if m.start() < s][-pii.REACH :]
            behind = [m[0].lower() for m in free if m.start() >= e][: pii.REACH]
            if word in before + behind:
                return True
    return False
