"""Exact duplicates against grouping in plain Python."""

from __future__ import annotations

import hashlib
import string

import pytest
from pyspark.sql import functions as F

from codequarry.llm import exact
from tests.llm.helpers import awkward, clashing, frame, prose

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows: list[tuple], largest: bool) -> list[tuple]:
    groups: dict[str, list] = {}
    for doc_id, text, *_ in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(doc_id)
    found = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        left = 1
        digest = hashlib.sha256(text.encode()).hexdigest()
        for i in ids:
            stays = i == keep and left > 0
            left -= stays
            found.append((i, keep, len(ids), stays, digest))
    return sorted(found, key=repr)


def result(docs, **how) -> list[tuple]:
    return sorted((tuple(r) for r in exact.duplicates(docs, **how).collect()), key=repr)


def mixed() -> list[tuple]:
    cases = ["Straße", "STRASSE", "straße", "ÉTÉ x", "Été x", "été X", "É", "é", "İ", "i", "a\u0000b"]
    rows = [(100 + k, t, None, None, None) for k, t in enumerate(cases + [t.upper() for t in cases])]
    return rows + prose() + [(200 + k, "one and the same", None, None, None) for k in range(300)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("rows", [mixed(), awkward(), [], [(None, None, None, None, None)] * 3])
def test_as_grouped_by_text(spark, rows, keep):
    assert result(frame(spark, rows), keep=keep) == brute(rows, keep == "largest")


@pytest.mark.parametrize("content_hash", [lambda t: F.length(t) % 3, lambda t: F.lit(0)])
def test_collisions_are_told_apart_by_bytes(spark, content_hash):
    rows = mixed() + awkward()
    assert result(frame(spark, rows), keep="largest", content_hash=content_hash) == brute(rows, True)


def test_hot_groups(spark):
    # 2,400 rows, so groups above two are hot.
    rows = [(k, f"Text {k % 800 if k % 3 else 0}", None, None, None) for k in range(2400)]
    assert result(frame(spark, rows)) == brute(rows, False)


def test_extreme_ids_and_clashing_columns(spark):
    rows = [(i, "same", None, None, None) for i in (-(2**63), 2**63 - 1, 0, None)]
    for keep in ("smallest", "largest"):
        assert result(frame(spark, rows), keep=keep) == brute(rows, keep == "largest")
    assert result(clashing(frame(spark, mixed()))) == brute(mixed(), False)
    names = frame(spark, mixed()).withColumns({n: F.lit(1) for n in ("hash", "digest", "whole", "keep_id")})
    assert result(names) == brute(mixed(), False)


def test_plan_is_native(spark, capsys):
    exact.duplicates(frame(spark, mixed())).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_refuses_other_rules(spark):
    with pytest.raises(ValueError):
        exact.duplicates(frame(spark, []), keep="any")
