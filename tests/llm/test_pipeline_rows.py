"""The near-dedup stage on rows whose doc_ids repeat or are null."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from codequarry.llm.simhash import fingerprint
from tests.llm.helpers import awkward, clashing, frame, groups, words


def kept(spark, rows):
    out = corpus_pipeline.simhash_near_dedup(spark, clashing(frame(spark, rows)), "")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    return [(r.doc_id, r.text) for r in out.collect()]


def test_one_row_of_each_group(spark):
    a, b, c = (words(60, k) for k in (1, 2, 3))
    rows = [(5, a), (1, a), (5, b), (None, a), (None, c), (None, c), (9, b), (1, a)]
    rows = [(k, t, "en", "a", 0) for k, t in rows]
    assert Counter(kept(spark, rows)) == Counter([(1, a), (5, b), (None, c)])


def test_one_row_of_each_group_of_awkward_rows(spark):
    rows = awkward() + awkward()
    prints = [fingerprint(r[1]) for r in rows]
    roots = groups(list(range(len(rows))), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 2)
    of_text = {r[1]: roots[i] for i, r in enumerate(rows)}
    found = kept(spark, rows)
    assert Counter(of_text[t] for _, t in found) == Counter(set(roots.values()))
    for k, t in found:
        ids = [rows[i][0] for i in roots if roots[i] == of_text[t]]
        assert k == min((i for i in ids if i is not None), default=None)
    assert kept(spark, []) == []
