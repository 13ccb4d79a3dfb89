"""Counts of copies at high rates."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from codequarry.llm import mixing
from tests.llm.helpers import frame


def counts_at(spark, rate: int, n: int) -> Counter:
    rows = [(k, "x", "en", "a", 0) for k in range(n)]
    found = mixing.mix_sources(frame(spark, rows), epochs=float(rate)).select("doc_id", "rate", "copy").collect()
    assert {r.rate for r in found} == {float(rate)}
    assert len({(r.doc_id, r.copy) for r in found}) == len(found)
    return Counter(r.doc_id for r in found)


@pytest.mark.parametrize("rate", [65, 300])
def test_counts_are_those_of_plain_inversion(spark, rate):
    counts = counts_at(spark, rate, 300)
    for k in range(300):
        u = int(hashlib.md5(f"42|copies|{k}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate)
        n = 0
        while c <= u:
            n += 1
            p = p * rate / n
            c += p
        assert counts[k] == n


@pytest.mark.parametrize("rate", [300, 2000])
def test_mean_and_variance_are_the_rate(spark, rate):
    counts = list(counts_at(spark, rate, 400).values())
    assert len(counts) == 400
    assert np.mean(counts) == pytest.approx(rate, abs=5 * math.sqrt(rate / 400))
    assert np.var(counts, ddof=1) == pytest.approx(rate, rel=5 * math.sqrt(2 / 399))
