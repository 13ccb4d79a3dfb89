"""PII: fixed kinds by pattern, and terms that give them away by corpus co-occurrence."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import Scratch, distinct_names, keyed, lean, pick

KINDS = ("email", "ip", "card", "phone")
# Words to either side of an entity that count as said together with it.
REACH = 8
# Part of an entity's information a term may give away.
DISCLOSURE = 0.5
# Contexts that the prior of a term's share weighs as much as: what an entity's class says, and
# for the class what the whole table says. One context alone then counts for a fifth.
PRIOR = 4.0

# The kinds are fixed. Each pattern is stated so that a match starts where a run starts, which
# finds the same matches in time linear in the text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_BEFORE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _BEFORE:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start: matches that pass their check.

    Matches are leftmost and non-overlapping by kind; one that fails is dropped for good.
    """
    spans = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return spans
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            spans.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                spans.append((3, *m.span()))
    return spans


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def entity(kind: int, found: str) -> str:
    """What is protected, however it is written: digits of numbers, e-mail in lower case."""
    return f"{KINDS[kind]}:{found.lower() if kind < 2 else _NOT_DIGIT.sub('', found)}"


def term_hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term) - (1 << 63)


def words_of(text: str) -> list[str]:
    """All words `\\w+` of a text in lower case; letters change after the text is split, so that
    counts and contexts know the same words."""
    return [w.lower() for w in _WORD.findall(text)]


def contexts(
    text: str, spans: list[tuple[int, int, int]]
) -> tuple[list[tuple[str, int, list[int]]], dict[int, list[int]]]:
    """(entity, context, terms) of each entity, and the places of each such term.

    Terms are words of at most REACH words away outside all spans, without digits only. Places
    are starts and ends of all occurrences of a term in the text, outside spans, held once
    however many entities it stands by. context is a hash of the entity's surroundings.
    """
    if not spans:
        return [], {}
    inside = sorted((s, e) for _, s, e in spans)
    starts = np.array([s for s, _ in inside])
    furthest = np.maximum.accumulate(np.array([e for _, e in inside]))
    found = list(_WORD.finditer(text))
    firsts = np.array([m.start() for m in found], np.int64)
    ends = np.array([m.end() for m in found], np.int64)
    last = np.searchsorted(starts, ends) - 1
    free = np.flatnonzero((last < 0) | (furthest[last] <= firsts))
    firsts, ends = firsts[free], ends[free]
    words = [found[k][0].lower() for k in free.tolist()]
    hashes: dict[str, int] = {}
    near = []
    left = np.searchsorted(firsts, [s for _, s, _ in spans]).tolist()
    right = np.searchsorted(firsts, [e for _, _, e in spans]).tolist()
    for (kind, s, e), i, j in zip(spans, left, right, strict=True):
        around = words[max(0, i - REACH) : i] + words[j : j + REACH]
        terms = [t for t in dict.fromkeys(around) if not t.isdigit()]
        for t in terms:
            if t not in hashes:
                hashes[t] = term_hash(t)
        near.append((entity(kind, text[s:e]), term_hash(" ".join(around)), [hashes[t] for t in terms]))
    places: dict[int, list[int]] = {h: [] for h in hashes.values()}
    for w, s, e in zip(words, firsts.tolist(), ends.tolist(), strict=True):
        if w in hashes:
            places[hashes[w]] += (s, e)
    return near, places


CONTEXT = "array<struct<entity:string,context:bigint,terms:array<bigint>>>"
PLACES = "array<struct<term:bigint,places:array<int>>>"
FOUND = ", ".join(
    [
        "row_key bigint",
        *(f"n_{k} bigint" for k in KINDS),
        f"base_sha256 string, base string, contexts {CONTEXT}, places {PLACES}",
    ]
)


def find_base(docs: DataFrame) -> DataFrame:
    """Base spans of (row_key, text) and the terms around them, one row by document."""
    near_kind = [("entity", pa.string()), ("context", pa.int64()), ("terms", pa.list_(pa.int64()))]
    place_kind = [("term", pa.int64()), ("places", pa.list_(pa.int32()))]
    nested = [pa.list_(pa.struct(k)) for k in (near_kind, place_kind)]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + nested

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(
                batch.column("row_key").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                text = text or ""
                spans = base_spans(text)
                base = written([(KINDS[k], s, e) for k, s, e in spans])
                counts = np.bincount([k for k, _, _ in spans], minlength=4).tolist()
                near, places = contexts(text, spans)
                rows.append(
                    (
                        key,
                        *counts,
                        hashlib.sha256(base.encode()).hexdigest(),
                        base,
                        [dict(zip(("entity", "context", "terms"), n, strict=True)) for n in near],
                        [{"term": t, "places": p} for t, p in places.items()],
                    )
                )
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["row_key", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "contexts", "places"],
                )

    return docs.select("row_key", "text").mapInArrow(scan, FOUND)


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, documents): in how many of all documents each word is.

    Tasks add up what they read before anything is shuffled.
    """

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: dict[str, int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([term_hash(t) for t in counts], pa.int64()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                names=["term", "n"],
            )

        counts: dict[str, int] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for word in set(words_of(text or "")):
                    counts[word] = counts.get(word, 0) + 1
            if len(counts) > 200_000:
                yield out(counts)
                counts = {}
        if counts:
            yield out(counts)

    said = docs.select("text").mapInArrow(scan, "term long, n long")
    return said.groupBy("term").agg(F.sum("n").alias("documents"))


def entity_class(entity: Column) -> Column:
    """What rare entities are backed off to: domain, first two bytes, issuer or number prefix."""
    kind = F.substring_index(entity, ":", 1)
    return (
        F.when(kind == "email", F.concat(F.lit("email:"), F.substring_index(entity, "@", -1)))
        .when(kind == "ip", F.substring_index(entity, ".", 2))
        .when(kind == "card", F.substring(entity, 1, len("card:") + 6))
        .otherwise(F.substring(entity, 1, len("phone:") + 4))
    )


def revealing(
    near: DataFrame, docs: DataFrame, n_docs: int, disclosure: float, prior: float, scratch: Scratch
) -> DataFrame:
    """(entity, term): terms that give away at least `disclosure` of an entity's information.

    The information of an entity is -log2 of its share of documents. What a term gives away
    is their pointwise mutual information: log2 of the term's share of the entity's contexts
    over its share of documents. Equal contexts count once, so copies prove nothing more.

    No entity is too rare: the share in its contexts is smoothed by `prior` contexts that have
    the term as often as those of the other entities of its class, and this share by as many
    that have it as often as all documents.
    """
    n = F.lit(float(max(n_docs, 1)))
    said = near.select("entity", "context", "term").distinct()
    pairs = said.groupBy("entity", "term").agg(F.count("*").alias("together"))
    pairs = scratch.save(pairs.withColumn("class", entity_class(F.col("entity"))), "pairs")
    mentions = near.select("entity", "context", "row_key")
    entities = mentions.groupBy("entity").agg(
        F.count_distinct("context").alias("contexts"), F.count_distinct("row_key").alias("held")
    )
    entities = scratch.save(entities, "entities")
    classes = entities.groupBy(entity_class(F.col("entity")).alias("class")).agg(
        F.sum("contexts").alias("class_contexts")
    )
    class_terms = pairs.groupBy("class", "term").agg(F.sum("together").alias("class_together"))
    needed = F.lit(disclosure) * F.log2(n / F.col("held"))
    # A share is 1 at most, so terms in too many documents go before classes are looked at.
    rare = (needed > 0) & (F.log2(n / F.col("documents")) >= needed)
    found = pairs.join(entities, "entity").join(term_counts(docs), "term").filter(rare)
    found = found.join(classes, "class").join(class_terms, ["class", "term"])
    base = F.col("documents") / n
    others = F.col("class_contexts") - F.col("contexts")
    of_class = (F.col("class_together") - F.col("together") + prior * base) / (others + prior)
    share = (F.col("together") + prior * of_class) / (F.col("contexts") + prior)
    return found.filter(F.log2(share / base) >= needed).select("entity", "term")


def find(docs: DataFrame, disclosure: float = DISCLOSURE, prior: float = PRIOR) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every whole text.

    spans lists `kind:start:end` in code points, end exclusive, comma-joined, by kind (email,
    ip, card, phone, then term) and start. Base kinds are what their patterns and checks find;
    `term` are words that give away an entity of the same document (see `revealing`), at all
    their places outside base spans.

    Null text counts as empty; empty tables give empty results; a null doc_id is a document
    like any other; repeated rows are documents of their own. An entity or a term may be in
    any share of the documents: pairs and counts are aggregated in tasks first.
    """
    scratch = Scratch(docs.sparkSession)
    rows, found, extra = _found(docs, disclosure, prior, scratch)
    joined = found.join(extra, "row_key", "left").join(rows.select("row_key", "doc_id"), "row_key")
    terms = F.array_join(
        F.transform("terms", lambda t: F.concat(F.lit("term:"), t["s"], F.lit(":"), t["e"])), ","
    )
    return joined.select(
        "doc_id",
        *(f"n_{k}" for k in KINDS),
        "base_sha256",
        F.concat_ws(",", F.nullif("base", F.lit("")), terms).alias("spans"),
    )


def _found(
    docs: DataFrame, disclosure: float, prior: float, scratch: Scratch
) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = keyed(docs, scratch)
    found = scratch.save(find_base(rows), "found")
    near = found.select("row_key", F.explode("contexts").alias("c"))
    near = near.select("row_key", "c.entity", "c.context", F.explode("c.terms").alias("term"))
    flagged = scratch.save(
        revealing(near, rows, found.count(), disclosure, prior, scratch), "flagged"
    )
    hits = near.join(flagged, ["entity", "term"]).select("row_key", "term").distinct()
    said = found.select("row_key", F.explode("places").alias("p")).select("row_key", "p.*")
    places = said.join(hits, ["row_key", "term"]).select("row_key", F.explode(_pairs("places")).alias("at"))
    extra = places.groupBy("row_key").agg(F.sort_array(F.collect_list("at")).alias("terms"))
    return rows, found.drop("contexts", "places"), scratch.save(extra, "extra")


def _pairs(column: str):
    return F.transform(
        F.sequence(F.lit(1), F.size(column) - 1, F.lit(2)),
        lambda k: F.struct(
            F.element_at(column, k).alias("s"), F.element_at(column, k + 1).alias("e")
        ),
    )


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, prior: float = PRIOR) -> DataFrame:
    """`docs` with text where base spans are generalised to their kind and terms are removed.

    `[email]`, `[ip]`, `[card]` and `[phone]` stand for base spans; a longer span swallows
    those that overlap it. All other columns stay (of names alike but for case one). Null texts stay null. Rows are joined with
    their spans by a key, so texts without any are only passed on. Cases as in `find`.
    """
    scratch = Scratch(docs.sparkSession)
    names = distinct_names(docs, "doc_id", "text")
    whole = pick(docs, *names).select(F.struct(*names).alias("row"), "doc_id", "text")
    unique = keyed(whole, scratch)
    if "keyed" in scratch.saved:  # ids are not keys: key the whole rows instead
        whole = scratch.save(whole.withColumn("row_key", F.monotonically_increasing_id()), "whole")
        unique = whole.select("row_key", F.col("row_key").alias("doc_id"), "text")
    else:
        whole = whole.withColumn("row_key", F.col("doc_id").cast("long"))
    _, found, extra = _found(unique.select(F.col("row_key").alias("doc_id"), "text"), disclosure, prior, scratch)
    spans = found.filter("base <> ''").select("row_key", "base").join(extra, "row_key", "full")
    schema = whole.select("row.*").schema

    def rewrite(text: str, base: str | None, terms: list | None) -> str:
        spans = [(int(s), int(e), f"[{k}]") for k, s, e in (x.split(":") for x in (base or "").split(",") if x)]
        spans += [(t["s"], t["e"], "") for t in terms or []]
        out, at = [], 0
        for s, e, label in sorted(spans, key=lambda x: (x[0], -x[1])):
            if s >= at:
                out += (text[at:s], label)
                at = e
            elif e > at:
                at = e
        return "".join([*out, text[at:]])

    @lean
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                t if t is None or (b is None and not x) else rewrite(t, b, x)
                for t, b, x in zip(
                    *(batch.column(c).to_pylist() for c in ("text", "base", "terms")), strict=True
                )
            ]
            columns = [
                pa.array(texts, pa.string()) if n == "text" else batch.column(k)
                for k, n in enumerate(names)
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = whole.join(spans.hint("shuffle_hash"), "row_key", "left")
    flat = joined.select(*(F.col(f"row.{n}").alias(n) for n in names), "base", "terms")
    return flat.mapInArrow(apply, schema)
