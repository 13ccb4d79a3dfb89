"""The quality classifier's strata, threshold and scores, against plain restatements."""

from __future__ import annotations

import math

import numpy as np
import pytest

from codequarry.llm import quality
from tests.llm.helpers import WORD, awkward, frame, words

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1


def plain_mix(h: int, salt: int = 0) -> int:
    h = (h + 0x9E3779B97F4A7C15 * (salt + 1)) & MASK
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 31)


def plain_word(word: bytes) -> int:
    h = sum((c + 1) * pow(BASE, k, 1 << 64) for k, c in enumerate(word)) & MASK
    return plain_mix(h ^ (len(word) << 40 & MASK))


def plain_content(text: str | None) -> set[int]:
    """Words as written and in plain letters, each hashed by itself."""
    text = text or ""
    letters = "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) >= 128 else " " for c in text
    )
    found = {plain_mix(plain_word(w.encode()), 11) >> 46 for w in WORD.findall(text)}
    return found | {plain_mix(plain_word(w.encode()), 12) >> 46 for w in WORD.findall(letters)}


def test_scores_by_brute_force(spark):
    said = ["awful ", "vile ", "fine ", "awful ", "fine ", "fine "]
    rows = [(k, said[k % 6] * 3 + words(20, k), "en", f"s{k % 2}", 10) for k in range(90)]
    rows += [r for r in awkward() if len(r[1] or "") < 1000]
    labels = spark.createDataFrame(
        [(k, int(k % 3 > 0), int(k % 6 == 1)) for k in range(80)], "doc_id long, quality int, toxic int"
    )
    docs = frame(spark, rows)
    model = quality.train(docs, labels)
    u, v, w = model.mixing
    found = quality.classify(docs, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        _, layout = quality.features(r.text, r.lang, r.source, r.n_chars)
        a = model.biases[0] + sum(float(model.content[f]) for f in plain_content(r.text))
        b = model.biases[1] + sum(float(model.metadata[f]) for f in layout.tolist())
        score = 1 / (1 + math.exp(-min(30, max(-30, u * a + v * b + w))))
        assert r.quality_score == pytest.approx(score, abs=1e-6)
        assert r.accepted == (r.quality_score >= model.threshold)
    right = [r.accepted == (r.doc_id % 3 > 0 and r.doc_id % 6 != 1) for r in found[:80]]
    assert np.mean(right) > 0.8


def plain_threshold(fine, bad) -> tuple[float, float]:
    """The least part of a bad stratum that passes, and what may be lost, by trying all scores."""
    tried = []
    for t in sorted({*fine, *(x for b in bad for x in b)}):
        if sum(x < t for x in fine) / len(fine) <= quality.LOST:
            tried.append(max(sum(x >= t for x in b) / len(b) for b in bad))
    return min(tried)


@pytest.mark.parametrize("seed", range(8))
def test_threshold_weighs_both_errors(seed):
    draw = np.random.default_rng(seed)
    fine, poor, toxic = draw.beta(6, 2, 300), draw.beta(2, 6, 80), draw.beta(2, 3, 20)
    t = quality.choose_threshold(fine, [poor, toxic])
    assert (fine < t).mean() <= quality.LOST
    passed = max((poor >= t).mean(), (toxic >= t).mean())
    assert passed == pytest.approx(plain_threshold(fine, [poor, toxic]))


def test_thresholds_of_few_rows():
    assert quality.choose_threshold(np.zeros(0), [np.ones(3)]) == 0.5
    assert quality.choose_threshold(np.array([0.9, 0.8]), []) < 0.8
    assert 0.3 < quality.choose_threshold(np.array([0.9, 0.8]), [np.array([0.3])]) < 0.8


def test_each_stratum_is_held_back_and_drawn():
    kinds = np.array([quality.GOOD] * 40 + [quality.TOXIC] * 3 + [quality.POOR] * 9)
    back = quality.held_back(kinds)
    assert [int(back[kinds == k].sum()) for k in (quality.GOOD, quality.TOXIC, quality.POOR)] == [10, 1, 3]


def test_pool_of_ids_that_say_nothing(spark):
    """Null and repeated ids: texts tell the pool's rows apart, and no labelled row is in it."""
    rows = [(None, words(12, k), "en", "a", 1) for k in range(50)] + [(5, "five " * 9, "en", "a", 1)] * 3
    rows += [(100 + k, ("fine " if k % 2 else "awful ") + words(9, k), "en", "a", 1) for k in range(40)]
    labels = spark.createDataFrame([(100 + k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    found = quality.classify(frame(spark, rows), labels, pool_rows=20).collect()
    assert len(found) == len(rows) and all(0 <= r.quality_score <= 1 for r in found)
