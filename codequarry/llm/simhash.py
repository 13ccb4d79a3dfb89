"""SimHash near-duplicates by meeting in the middle of Hamming balls."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import Scratch, components, lean, pick

_SHINGLES_AT_ONCE = 1 << 14


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash over word shingles, each as often as it occurs; 0 without words.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case. Fewer words than a
    shingle are one shingle. A bit is 1 if it is in over half of the XXH64 hashes (seed 42).
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    pairs = zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    hashes: list[bytes] = []
    for s, e in pairs:
        hashes.append(digest(line[s:e], 42))
        if len(hashes) == _SHINGLES_AT_ONCE:
            ones += _ones(hashes)
            hashes = []
    if hashes:
        ones += _ones(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _ones(hashes: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3, *keys: str) -> DataFrame:
    """(doc_id, bits): the fingerprint of each whole text as a signed long; and long `keys`."""

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            signed = np.array(bits, np.uint64).view(np.int64)
            names = [*keys, "doc_id"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(signed)], names=[*names, "bits"]
            )

    chosen = pick(docs, *keys, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return chosen.mapInArrow(scan, ", ".join(f"{n} long" for n in (*keys, "doc_id", "bits")))


def near_links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): verified links between the distinct `bits`, enough to keep them connected.

    Every fingerprint emits all variants within half the radius; two are within the radius
    just when they share a variant. All that share one are within the radius of each other,
    so each is linked with the least of them only. A variant has no more fingerprints than
    its ball has members, so no group is large, whatever the data.
    """
    if max_bits % 2:
        raise ValueError("the radius must be even to be halved")
    masks = [
        sum(1 << b for b in bits)
        for n in range(max_bits // 2 + 1)
        for bits in combinations(range(64), n)
    ]
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    flips = F.array(*(F.lit(m) for m in signed))
    variants = prints.select("bits", F.explode(flips).alias("flip")).select(
        "bits", F.col("bits").bitwiseXOR(F.col("flip")).alias("variant")
    )
    least = F.min("bits").over(Window.partitionBy("variant"))
    links = variants.withColumn("a", least).filter("a <> bits")
    links = links.select("a", F.col("bits").alias("b")).distinct()
    return links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, bits, component_id, kept): groups linked by at most max_bits differing bits.

    component_id is the smallest doc_id of the group, kept marks that document.

    Null text counts as empty; texts without words have fingerprint 0 and are linked like any
    other; a null doc_id is in its group, but never names it unless all are null; repeated rows
    (also of one doc_id) each get a row; an empty table gives an empty result. Copies meet as
    one fingerprint before anything is paired, so groups of any size cost one row.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.save(fingerprints(docs, shingle), "prints")
    joined = prints.join(_least(prints, "doc_id", max_bits, scratch), "bits")
    return joined.withColumnRenamed("least", "component_id").select(
        "doc_id", "bits", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def redundant(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(row_key): all rows of (row_key, doc_id, text) but one of each group of near-duplicates.

    Groups are those of `near_duplicates`. The row that stays has the smallest doc_id, nulls
    last, and of such rows the smallest row_key, which must be unique.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.save(fingerprints(docs, shingle, "row_key"), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row_key")
    least = _least(prints, order, max_bits, scratch)
    joined = prints.join(least.select("bits", F.col("least.row_key").alias("elected")), "bits")
    return joined.filter("row_key <> elected").select("row_key")


def _least(prints: DataFrame, order: Column | str, max_bits: int, scratch: Scratch) -> DataFrame:
    """(bits, least): the least `order` of the group of each of the distinct fingerprints."""
    distinct = scratch.save(prints.groupBy("bits").agg(F.min(order).alias("first")), "distinct")
    roots = components(near_links(distinct, max_bits), scratch, "links")
    rooted = distinct.join(roots, distinct["bits"] == roots["node"], "left").select(
        "bits", "first", F.coalesce("root", "bits").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    return scratch.save(rooted.join(least, "root").select("bits", "least"), "named")


def hexadecimal(bits: str = "bits"):
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
