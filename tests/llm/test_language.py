"""Language ID on awkward rows, and against a plain restatement of training and prediction."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np

from codequarry.llm import language
from tests.llm.helpers import frame

MASK = (1 << 64) - 1


def tongue(k: int, seed: int, n: int = 12) -> str:
    """Words of the k-th invented language."""
    letters = random.Random(k).sample("abcdefghijklmnopqrstuvwxyzäéßñøž", 7)
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(letters, k=draw.randrange(2, 7))) for _ in range(n))


def plain_mix(h: int, salt: int) -> int:
    h = (h + 0x9E3779B97F4A7C15 * (salt + 1)) & MASK
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 31)


def plain_counts(text: str, bits: int = language.BITS) -> Counter:
    plain = [ord(c) if ord(c) >= 128 or c.isalpha() else 32 for c in f" {text.lower()} "]
    found = Counter()
    for n in language.LENGTHS:
        for i in range(len(plain) - n + 1):
            h = plain[i]
            for c in plain[i + 1 : i + n]:
                h = (h * 0x100000001B3 + c) & MASK
            found[plain_mix(h, n) >> (64 - bits)] += 1
    return found


def test_n_grams_across_stretches(monkeypatch):
    monkeypatch.setattr(language, "STRETCH", 7)
    for n in (0, 1, 4, 5, 6, 7, 12, 13, 40, 101):
        text = tongue(1, n, 30)[:n]
        at, counts = language.gram_counts(text)
        assert dict(zip(at.tolist(), counts.tolist(), strict=True)) == plain_counts(text)


def test_a_long_text_has_the_n_grams_of_its_letters():
    text = tongue(2, 5, 70_000)
    assert len(text) > 300_000
    at, counts = language.gram_counts(text)
    assert dict(zip(at.tolist(), counts.tolist(), strict=True)) == plain_counts(text)


def test_learns_without_useful_ids(spark):
    """All ids null, or one id for all: texts tell rows apart."""
    learned = next(k for k in range(9) if zlib.crc32(str(k).encode()) % 3 != 1)
    for doc_id in (None, learned):
        rows = [(doc_id, tongue(k % 2, k), ("aa", "bb")[k % 2], "s", 1) for k in range(6000)]
        found = language.language_id(frame(spark, rows), rows_by_language=300).collect()
        assert len(found) == 6000 and {r.lang_pred for r in found} == {"aa", "bb"}
        assert all(r.score > 0.9 for r in found)


def test_repeated_rows_count_once_in_the_sample(spark):
    rows = [(1, "same text", "aa", "s", 1)] * 3000 + [(k, tongue(1, k), "bb", "s", 1) for k in range(2, 40)]
    docs = frame(spark, rows)
    sample = language.labelled_sample(docs, "lang", 30, "doc_id", "text").collect()
    assert Counter(r["lang"] for r in sample) == {"aa": 1, "bb": 30}


def test_many_languages_within_bounds(spark, monkeypatch):
    rows = [(k, tongue(k % 500, k), f"l{k % 500:03}", "s", 1) for k in range(6000)]
    monkeypatch.setattr(language, "ROWS_IN_ALL", 1500)
    model = language.train(frame(spark, rows).filter(language.learnable()))
    assert len(model.names) == 500 and model.table.size <= language.WEIGHTS
    assert sum(model.predict(r[1])[0] == r[2] for r in rows[:200]) > 150
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    docs = frame(spark, rows[:40] + rows[:3])
    assert language.train(docs).names == ["l000", "l001", "l002"]


def test_sample_is_bounded_in_bytes(spark):
    rows = spark.createDataFrame(
        [(by, k, b"x" * n) for by in "ab" for k, n in enumerate((5, 5, 100, 1))], "by string, sample_draw long, v binary"
    )
    from pyspark.sql import functions as F

    kept = language.bounded(rows, "by", F.octet_length("v"), 20).collect()
    assert sorted((r["by"], r["sample_draw"]) for r in kept) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


class Plain:
    """Follow-the-regularised-leader over dictionaries, one weight at a time."""

    def __init__(self, classes: int, alpha=0.3, l1=0.2, l2=0.2):
        self.classes, self.alpha, self.l1, self.l2 = classes, alpha, l1, l2
        self.z, self.n = Counter(), Counter()

    def weight(self, f, c) -> float:
        z, n = self.z[f, c], self.n[f, c]
        if f == "bias":
            return -z * self.alpha / (1 + math.sqrt(n))
        step = (1 + math.sqrt(n)) / self.alpha + self.l2
        return -math.copysign(max(abs(z) - self.l1, 0.0), z) / step

    def scores(self, row: dict) -> list[float]:
        return [
            self.weight("bias", c) + sum(v * self.weight(f, c) for f, v in row.items())
            for c in range(self.classes)
        ]

    def learn(self, row: dict, label: int) -> None:
        s = self.scores(row)
        e = [math.exp(x - max(s)) for x in s]
        wanted = [x / sum(e) - (c == label) for c, x in enumerate(e)]
        old = {(f, c): self.weight(f, c) for f in (*row, "bias") for c in range(self.classes)}
        for f, v in (*row.items(), ("bias", 1.0)):
            for c, d in enumerate(wanted):
                g = d * v
                sigma = (math.sqrt(self.n[f, c] + g * g) - math.sqrt(self.n[f, c])) / self.alpha
                self.z[f, c] += g - sigma * old[f, c]
                self.n[f, c] += g * g


def test_training_and_prediction_by_brute_force(spark):
    rows = [(k, tongue(k % 3, k, 4 + k % 5), f"t{k % 3}", "s", 1) for k in range(60)]
    rows += [(100 + k, t, None, "s", 1) for k, t in enumerate(["", "12", None, tongue(1, 7), "é " * 30])]
    docs = frame(spark, rows)
    learn = [r.doc_id for r in docs.filter(language.learnable()).collect()]
    held = {r.doc_id for r in docs.filter(language.held_out()).collect()}
    known = {r[0]: r for r in rows}
    counts = {i: plain_counts(known[i][1]) for i in learn}
    df = Counter(f for c in counts.values() for f in c)
    idf = Counter({f: math.log((1 + len(learn)) / (1 + n)) + 1 for f, n in df.items()})

    def vector(c: Counter) -> dict:
        total = sum(c.values())
        unseen = math.log(1 + len(learn)) + 1
        return {f: language.SCALE * n / total * (idf[f] if f in df else unseen) for f, n in sorted(c.items())}

    drawn = language.labelled_sample(docs.filter(language.learnable()), "lang", 10**6, "doc_id", "text")
    order = sorted((r["lang"], r["sample_draw"], r["doc_id"]) for r in drawn.collect())
    data = [(vector(counts[i]), int(lang[1:])) for lang, _, i in order]
    kept = [x for k, x in enumerate(data) if k % language.HELD_BACK]
    back = [x for k, x in enumerate(data) if k % language.HELD_BACK == 0]
    model, turns = Plain(3), np.random.default_rng(7)
    for _ in range(3):
        for k in turns.permutation(len(kept)).tolist():
            model.learn(*kept[k])
    scores = [model.scores(v) for v, _ in back]

    def loss(t: float) -> float:
        total = 0.0
        for s, (_, y) in zip(scores, back, strict=True):
            e = [math.exp((x - max(s)) / t) for x in s]
            total -= math.log(max(e[y] / sum(e), 1e-12))
        return total / len(back)

    heat = min((math.exp(math.log(0.05) + k * math.log(400) / 2000) for k in range(2001)), key=loss)
    for r in language.language_id(docs).collect():
        text = known[r.doc_id][1]
        assert r.held_out == (r.doc_id in held)
        if not any(map(str.isalpha, text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        s = model.scores(vector(plain_counts(text)))
        best = max(range(3), key=lambda c: s[c])
        e = [math.exp((x - s[best]) / heat) for x in s]
        assert r.lang_pred == f"t{best}"
        assert abs(r.score - 1 / sum(e)) < 0.01
