"""Document fingerprints by randomised edit embedding: likeness of texts under edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.llm.common import Scratch, components, keyed, mix

# Sampled bits of a fingerprint; period of the shared walk in steps; classes of characters.
BITS = 512
PERIOD = 4096
CLASSES = 64
# Steps of a band.
BAND_STEPS = 16
# Characters of a group of documents that walk together, padding included.
AT_ONCE = 1 << 21


def _random_bits(salt: int) -> np.ndarray:
    """(CLASSES, PERIOD) of fixed random bits."""
    return (mix(np.arange(CLASSES * PERIOD, dtype=np.uint64), salt) & np.uint64(1)).astype(
        np.uint8
    ).reshape(CLASSES, PERIOD)


@cache
def _walk() -> tuple[np.ndarray, np.ndarray]:
    """Steps from each step until the walk leaves a character, and the bit seen at a step.

    The walk copies its character at each step, then moves to the next one where the shared
    random bit of (character, step) is 1.
    """
    moves = np.tile(_random_bits(1), 2)
    until = np.full((CLASSES, 2 * PERIOD + 1), PERIOD, np.int32)
    for j in range(2 * PERIOD - 1, -1, -1):
        until[:, j] = np.where(moves[:, j] == 1, 1, until[:, j + 1] + 1)
    return until[:, :PERIOD].ravel().copy(), _random_bits(2)


@cache
def _candidates(power: int) -> np.ndarray:
    """Steps below 2 ** power that samples may take, by falling priority."""
    steps = np.arange(1 << power, dtype=np.uint64)
    order = np.argsort(mix(steps, 3), kind="stable")
    return order[: 4 * BITS].astype(np.int64)


@cache
def _samples(n_chars: int) -> np.ndarray:
    """The steps that a text of so many characters is sampled at: fixed random steps, those of
    highest priority below twice its length, so texts of like length share most of them."""
    if not n_chars:
        return np.empty(0, np.int64)
    steps = _candidates((2 * n_chars - 1).bit_length())
    return steps[steps < 2 * n_chars][:BITS]


def _classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return ((points * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.int32)


def embed(texts: list[str]) -> list[np.ndarray]:
    """The sampled bits of each text. Texts of like length walk side by side."""
    result: list[np.ndarray] = [np.empty(0, np.uint8)] * len(texts)
    order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
    until, seen = _walk()
    at = len(order)
    while at:
        longest = len(texts[order[at - 1]])
        if not longest:
            break
        size = max(1, min(at, AT_ONCE // longest))
        group = order[at - size : at]
        at -= size
        rows = np.zeros((len(group), longest), np.int32)
        for r, k in enumerate(group):
            rows[r, : len(texts[k])] = _classes(texts[k])
        keys = np.ascontiguousarray(rows.T) * PERIOD
        arrival = np.zeros((longest, len(group)), np.int32)
        step = np.zeros(len(group), np.int32)
        for i in range(longest - 1):
            step = step + until.take(keys[i] + (step & (PERIOD - 1)))
            arrival[i + 1] = step
        arrival = np.ascontiguousarray(arrival.T)
        for r, k in enumerate(group):
            n = len(texts[k])
            sampled = _samples(n)
            char = np.searchsorted(arrival[r, :n], sampled, "right") - 1
            bits = seen[rows[r, char], sampled & (PERIOD - 1)]
            # Past the last character the walk sees padding.
            end = arrival[r, n - 1] + until[rows[r, n - 1] * PERIOD + (arrival[r, n - 1] & (PERIOD - 1))]
            result[k] = np.where(sampled < end, bits, 0).astype(np.uint8)
    return result


def to_string(n_chars: int, bits: np.ndarray) -> str:
    """Length and sampled bits in hexadecimal; the length says which steps were sampled."""
    return f"{n_chars:08x}{np.packbits(bits).tobytes().hex()}"


def from_string(fingerprint: str) -> tuple[int, np.ndarray]:
    n = int(fingerprint[:8], 16)
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint[8:]), np.uint8))
    return n, bits[: len(_samples(n))]


def likeness(n: int, a: np.ndarray, m: int, b: np.ndarray) -> float:
    """0 to 1: agreements less disagreements at the steps both were sampled at, by all steps."""
    if n == m and np.array_equal(a, b):
        return 1.0
    most = max(len(a), len(b))
    if n == m:
        equal = int((a == b).sum())
        both = len(a)
    else:
        _, i, j = np.intersect1d(_samples(n), _samples(m), assume_unique=True, return_indices=True)
        both = len(i)
        equal = int((a[i] == b[j]).sum())
    return max(0, 2 * equal - both) / most


def fingerprints(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, fingerprint) of each whole text of (row_key, doc_id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            prints = [to_string(len(t), b) for t, b in zip(texts, embed(texts), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("doc_id"), pa.array(prints, pa.string())],
                names=["row_key", "doc_id", "fingerprint"],
            )

    return docs.select("row_key", "doc_id", "text").mapInArrow(
        scan, "row_key long, doc_id long, fingerprint string"
    )


def bands_of(fingerprint: str, bands: int) -> list[int]:
    """Hashes of the bits that each band samples, for the text's length class and the one below.

    A band is BAND_STEPS of the first steps by priority that every text of the class has, so
    texts whose lengths are of neighbouring classes still share one.
    """
    n, bits = from_string(fingerprint)
    known = dict(zip(_samples(n).tolist(), bits.tolist(), strict=True))
    top = (2 * n).bit_length()
    keys = []
    for level in (top, top - 1):
        steps = _candidates(max(level - 1, 0))[:64].tolist()
        for band in range(bands):
            drawn = _band(band)
            seen = "".join(str(known.get(steps[k], "")) for k in drawn if k < len(steps))
            digest = hashlib.blake2b(f"{level}:{band}:{seen}".encode(), digest_size=8).digest()
            keys.append(int.from_bytes(digest, "big", signed=True))
    return keys


@cache
def _band(band: int) -> list[int]:
    return np.random.default_rng(band).choice(64, BAND_STEPS, replace=False).tolist()


def near_duplicates(
    docs: DataFrame, least: float = 0.8, bands: int = 64, block_rows: int = 256
) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents linked by likeness >= `least`.

    Documents whose fingerprints agree in a band meet and are verified by likeness. Equal
    fingerprints are one row before that. Two texts of likeness s agree in a given band with
    probability ((1 + s) / 2) ** BAND_STEPS: 0.18 at 0.8, so 64 bands miss few of them.
    component_id is the smallest doc_id reachable.

    The rows of a bucket are cut into blocks, and pairs of blocks are verified each for
    itself, so a bucket of any size spreads over tasks; a task returns for each row the least
    one it reached, never pairs. Null text counts as empty, null doc_ids name no component,
    repeated rows each get a row, an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.save(fingerprints(keyed(docs, scratch)), "prints")
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    distinct = scratch.save(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, name in zip(
                batch.column("node").to_pylist(), batch.column("fingerprint").to_pylist(), strict=True
            ):
                keys = bands_of(name, bands)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node] * len(keys)), pa.array([name] * len(keys)), pa.array(keys)],
                    names=["node", "fingerprint", "bucket"],
                )

    members = distinct.select("node", "fingerprint").mapInArrow(
        bucket, "node long, fingerprint string, bucket long"
    )
    members = scratch.save(members, "members")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / F.lit(block_rows)).cast("int")
    spread = members.join(sizes, "bucket").withColumn("blocks", blocks)
    spread = spread.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = spread.select(
        "bucket",
        "node",
        "fingerprint",
        "own",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select(
        "bucket",
        "node",
        "fingerprint",
        "own",
        F.least("own", "other").alias("x"),
        F.greatest("own", "other").alias("y"),
    )

    def verify(pdf):
        import pandas as pd

        known = [from_string(f) for f in pdf["fingerprint"]]
        nodes, own = pdf["node"].tolist(), pdf["own"].tolist()
        within = pdf["x"].iat[0] == pdf["y"].iat[0]
        reached = list(range(len(nodes)))

        def top(i: int) -> int:
            while reached[i] != i:
                i = reached[i]
            return i

        for i in range(len(nodes)):
            for j in range(i + 1, len(nodes)):
                if (within or own[i] != own[j]) and (a := top(i)) != (b := top(j)):
                    if likeness(*known[i], *known[j]) >= least:
                        reached[max(a, b)] = min(a, b)
        out = [(nodes[i], nodes[top(i)]) for i in range(len(nodes)) if top(i) != i]
        return pd.DataFrame(out, columns=["a", "b"])

    links = paired.groupBy("bucket", "x", "y").applyInPandas(verify, "a long, b long").distinct()
    roots = components(links, scratch, "stars").withColumnRenamed("node", "member")
    rooted = distinct.join(roots, distinct["node"] == roots["member"], "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(names, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


# The edited texts ---------------------------------------------------------------------------

CELLS = 1 << 14
EDITED = T.StructType(
    [
        T.StructField("row_key", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness.

    The edited text is the text with its last floor(n / 2) code points replaced by the first
    as many (or all) of the next document's, in descending order of doc_id; after the last
    document comes the first. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Documents are dealt out once, by ranges of doc_id of about equal counts (a histogram of
    doc_id over at most CELLS cells is all that reaches the driver). The first document of a
    range is also sent to the end of the range before it, so every document meets its next
    one in its own task, which streams through a range in order.

    Null text counts as empty and empty texts are alike; nulls in doc_id come last, repeated
    rows and ids are documents of their own in a fixed order; an empty table gives an empty
    result; a document alone is its own next one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = keyed(docs, scratch)
    low, high, total = rows.agg(F.min("row_key"), F.max("row_key"), F.count("*")).first()
    low, high = low or 0, high or 0
    width = (high - low) // CELLS + 1
    cell = F.floor((F.col("row_key") - F.lit(low)) / F.lit(width)).cast("int")
    counts = dict(rows.groupBy(cell.alias("cell")).count().collect())
    wanted = max(1, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranges, held, current = [0] * CELLS, 0, 0
    for c in range(CELLS):
        if held >= wanted:
            current, held = current + 1, 0
        ranges[c] = current
        held += counts.get(c, 0)
    of_cell = F.element_at(F.lit(ranges), cell + 1)
    dealt = rows.select("row_key", F.coalesce("text", F.lit("")).alias("text"), of_cell.alias("range"))
    heads = dealt.groupBy("range").agg(F.max("row_key")).collect()
    filled = sorted(r[0] for r in heads)
    after = {r: filled[(k + 1) % len(filled)] for k, r in enumerate(filled)}
    before = [after.get(r, 0) for r in range(current + 1)]  # ids fall, so the range above is before
    extra = dealt.filter(F.col("row_key").isin([r[1] for r in heads])).select(
        "row_key",
        "text",
        F.element_at(F.lit(before), F.col("range") + 1).alias("range"),
        F.lit(True).alias("extra"),
    )
    streams = dealt.withColumn("extra", F.lit(False)).unionByName(extra).repartition("range")
    streams = streams.sortWithinPartitions("range", "extra", F.desc("row_key"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # range, row_key, text, fingerprint bits of the last row
        for batch in batches:
            own = list(
                zip(
                    *(batch.column(c).to_pylist() for c in ("range", "row_key", "text", "extra")),
                    strict=True,
                )
            )
            texts = [r[2] for r in own]
            bits = embed(texts)
            if held:
                own.insert(0, held[:4])
                texts.insert(0, held[2])
                bits.insert(0, held[4])
            pairs = [k for k in range(len(own) - 1) if not own[k][3] and own[k][0] == own[k + 1][0]]
            edited = []
            for k in pairs:
                n = len(texts[k])
                edited.append(texts[k][: n - n // 2] + texts[k + 1][: n // 2])
            edited_bits = embed(edited)
            out = []
            for k, text, other in zip(pairs, edited, edited_bits, strict=True):
                n, m = len(texts[k]), len(texts[k + 1])
                out.append(
                    (
                        own[k][1],
                        n,
                        hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
                        to_string(n, bits[k]),
                        to_string(len(text), other),
                        likeness(n, bits[k], len(text), other),
                        likeness(n, bits[k], m, bits[k + 1]),
                    )
                )
            if own:
                held = (*own[-1], bits[-1])
            if out:
                kinds = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=EDITED.names,
                )

    result = streams.mapInArrow(scan, EDITED)
    if "keyed" not in scratch.saved:
        return result.withColumnRenamed("row_key", "doc_id")
    return result.join(rows.select("row_key", "doc_id"), "row_key").select("doc_id", *EDITED.names[1:])
