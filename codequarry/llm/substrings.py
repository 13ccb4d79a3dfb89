"""Substring dedup: repeated windows of words found through difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.llm.common import Scratch, keyed, window_hashes, word_hashes

# Perfect difference covers (every shift modulo the period is a difference).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18)}
# Windows gathered before a task looks for repeats among its own.
AT_ONCE = 1 << 20
# Settled rows go to any task: their key is the document's, scrambled.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor length: any `window` words hold an anchor at every alignment."""
    period = max(p for p in COVERS if p == 1 or 3 * p <= 2 * window)
    return period, COVERS[period], window - period + 1


def _anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the anchors of a document: those at cover positions."""
    period, cover, length = cover_for(window)
    count = len(words) - length + 1
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.arange(count)
    at = at[np.isin(at % period, cover)]
    return at, window_hashes(words, at, length)


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=[*columns])


def _runs(sorted_equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a boolean 'equals the one before' array: the first of each run, and run sizes."""
    first = np.flatnonzero(~sorted_equal)
    return first, np.diff(np.append(first, len(sorted_equal)))


def repeated_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, anchor): anchors whose hash is anywhere else in `docs` (doc_id, text).

    A task settles what repeats among its own rows, and sends one row by hash to the others
    (`repeat` says that it has more), so a passage that all documents share is as many rows as
    there are batches. Rows then meet by hash, and a streaming pass compares neighbours.
    """

    def emit(hashes: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        h, d = np.concatenate(hashes), np.concatenate(ids)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        same = np.concatenate(([False], h[1:] == h[:-1]))
        first, size = _runs(same)
        repeat = np.repeat(size > 1, size)
        # One row by document and hash will do.
        again = same & np.concatenate(([False], d[1:] == d[:-1]))
        sent = ~same
        kind = np.where(sent, repeat.astype(np.int8), np.int8(2))
        keep = sent | ~again
        # In the order of documents, neighbours in a shuffle have much in common.
        keep = np.flatnonzero(keep)
        keep = keep[np.argsort(order[keep])]
        h, d, kind = h[keep], d[keep], kind[keep]
        key = np.where(kind == 2, h ^ (d.astype(np.uint64) * _SPREAD), h)
        return _batch({"key": key.view(np.int64), "kind": kind, "doc_id": d})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                _, h = _anchors(word_hashes((text or "").encode())[0], window)
                if len(h):
                    hashes.append(h)
                    ids.append(np.full(len(h), doc_id, np.int64))
                    held += len(h)
                if held >= AT_ONCE:
                    yield emit(hashes, ids)
                    hashes, ids, held = [], [], 0
        if held:
            yield emit(hashes, ids)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by (key, kind); a row waits for the next batch to know its neighbour.
        last: tuple | None = None  # key, doc_id, kind: 1 once it is known to repeat

        def marks(key: np.ndarray, kind: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            spread = np.where(kind == 2, ids.astype(np.uint64) * _SPREAD, np.uint64(0))
            return _batch({"doc_id": ids, "anchor": (key.view(np.uint64) ^ spread).view(np.int64)})

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            kind = batch.column("kind").to_numpy()
            ids = batch.column("doc_id").to_numpy()
            if last is not None:
                key, ids, kind = (
                    np.concatenate((x, y)) for x, y in zip(last, (key, ids, kind), strict=True)
                )
            same = np.concatenate(([False], key[1:] == key[:-1]))
            after = np.concatenate((same[1:], [False]))
            hit = same | after | (kind > 0)
            known = np.maximum(kind[-1:], hit[-1:].astype(np.int8))
            last = (key[-1:].copy(), ids[-1:].copy(), known)
            hit[-1] = False
            yield marks(key[hit], kind[hit], ids[hit])
        if last is not None and last[2][0]:
            yield marks(last[0], last[2], last[1])

    sent = docs.mapInArrow(scan, "key long, kind byte, doc_id long")
    sorted_ = sent.repartition("key").sortWithinPartitions("key")
    return sorted_.mapInArrow(meet, "doc_id long, anchor long")


def later_windows(marked: DataFrame, window: int) -> DataFrame:
    """(doc_id, at, n): windows whose words also start earlier, n of them from `at` on; from
    (doc_id, text, anchors).

    A window counts if a marked anchor lies in it. It is known by 96 bits of hashes of all its
    words. A task keeps the earliest of equal windows and settles the others itself; the
    earliest ones meet by hash in order of (doc_id, start), where all but the first go.
    """
    _, _, length = cover_for(window)

    def emit(found: list[tuple]) -> pa.RecordBatch:
        a, b, d, s = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((s, d, b, a))
        a, b, d, s = a[order], b[order], d[order], s[order]
        later = np.concatenate(([False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])))
        # Settled windows that follow each other are one row: b is how many there are.
        gone = np.lexsort((s[later], d[later]))
        gd, gs = d[later][gone], s[later][gone]
        first, size = _runs(
            np.concatenate(([False], (gd[1:] == gd[:-1]) & (gs[1:] == gs[:-1] + 1)))
        )
        one = np.flatnonzero(~later)
        one = one[np.argsort(order[one])]
        return _batch(
            {
                "a": np.concatenate((a[one], gd[first].astype(np.uint64) * _SPREAD)).view(np.int64),
                "b": np.concatenate((b[one].astype(np.uint32).view(np.int32), size.astype(np.int32))),
                "later": np.arange(len(one) + len(first)) >= len(one),
                "doc_id": np.concatenate((d[one], gd[first])),
                "at": np.concatenate((s[one], gs[first])).astype(np.int32),
            }
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for doc_id, text, marks in zip(
                batch.column("doc_id").to_pylist(),
                batch.column("text").to_pylist(),
                batch.column("anchors"),
                strict=True,
            ):
                words, _, _ = word_hashes((text or "").encode())
                at, h = _anchors(words, window)
                known = marks.values.to_numpy().view(np.uint64)
                hits = at[np.isin(h, known)]
                count = len(words) - window + 1
                steps = np.zeros(count + 1, np.int64)
                np.add.at(steps, np.maximum(hits - (window - length), 0), 1)
                np.add.at(steps, np.minimum(hits, count - 1) + 1, -1)
                starts = np.flatnonzero(np.cumsum(steps[:-1]))
                if len(starts):
                    found.append(
                        (
                            window_hashes(words, starts, window),
                            window_hashes(words, starts, window, 1) >> np.uint64(32),
                            np.full(len(starts), doc_id, np.int64),
                            starts,
                        )
                    )
                    held += len(starts)
                if held >= AT_ONCE:
                    yield emit(found)
                    found, held = [], 0
        if held:
            yield emit(found)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            later = batch.column("later").to_numpy(zero_copy_only=False)
            before = last if last is not None else (None, None)
            same = np.concatenate(
                ([a[0] == before[0] and b[0] == before[1]], (a[1:] == a[:-1]) & (b[1:] == b[:-1]))
            )
            last = (a[-1], b[-1])
            hit = later | same
            yield _batch(
                {
                    "doc_id": batch.column("doc_id").to_numpy()[hit],
                    "at": batch.column("at").to_numpy()[hit],
                    "n": np.where(later, b, np.int32(1))[hit],
                }
            )

    sent = marked.mapInArrow(scan, "a long, b int, later boolean, doc_id long, at int")
    # A settled row may share its key with a true window by chance: it sorts behind all of
    # them, so that no window takes it for its equal.
    sorted_ = sent.repartition("a").sortWithinPartitions("a", "later", "b", "doc_id", "at")
    return sorted_.mapInArrow(meet, "doc_id long, at int, n int")


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()),
    ]
)


def remove_repeats(docs: DataFrame, window: int = 20, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): texts without words of windows that start earlier.

    A window is `window` consecutive words `[^\\x20\\x09-\\x0D]+` of one document; it goes if
    its word sequence also starts earlier (smaller doc_id, or earlier in the same document).
    All windows are judged on the input. kept joins the words left by one space; with digest
    it is their SHA-256 in hexadecimal.

    Anchors are hashed at the positions of a difference cover modulo a period, so two equal
    windows share an anchor at the same place in both, however they are aligned. Anchors that
    repeat extend to all windows around them, and these are compared as a whole.

    Equal texts: all but the one of the smallest doc_id lose every window without being
    compared. Null text has no words; a null doc_id comes after all others and repeated rows of
    one doc_id are documents of their own, in any fixed order; an empty table gives an empty
    result.
    """
    scratch = Scratch(docs.sparkSession)
    whole = keyed(docs, scratch)
    text = F.coalesce("text", F.lit(""))
    ids = whole.select("row_key", F.xxhash64(text).alias("h"), F.md5(text.cast("binary")).alias("m"))
    least = ids.groupBy("h", "m").agg(F.min("row_key").alias("row_key"))
    firsts = scratch.save(least.select("row_key", F.lit(True).alias("one")), "firsts")
    # One plan from here on: the texts are dealt out by document once, and all three steps
    # that look at them read that one exchange.
    texts = whole.select(F.col("row_key").alias("doc_id"), "text").filter("doc_id is not null")
    texts = texts.repartition("doc_id")
    firsts = firsts.withColumnRenamed("row_key", "doc_id")
    first_texts = texts.join(firsts.hint("shuffle_hash"), "doc_id").select("doc_id", "text")
    marks = repeated_anchors(first_texts, window)
    marks = marks.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    marked = first_texts.join(marks.hint("shuffle_hash"), "doc_id")
    later = later_windows(marked.select("doc_id", "text", "anchors"), window)
    later = later.groupBy("doc_id").agg(
        F.collect_list(F.struct("at", F.col("at") + F.col("n"))).alias("starts")
    )
    flags = firsts.join(later, "doc_id", "left")
    joined = texts.join(flags.hint("shuffle_hash"), "doc_id", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, one, starts in zip(
                *(batch.column(c).to_pylist() for c in ("doc_id", "text", "one")),
                batch.column("starts"),
                strict=True,
            ):
                words = (text or "").encode().split()
                count = len(words) - window + 1
                gone = np.zeros(len(words), bool)
                if count > 0 and one is None:
                    gone[:] = True
                elif count > 0 and starts.is_valid:
                    at, end = (x.to_numpy() for x in starts.values.flatten())
                    steps = np.zeros(len(words) + 1, np.int64)
                    np.add.at(steps, at, 1)
                    np.add.at(steps, end + window - 1, -1)
                    gone = np.cumsum(steps[:-1]) > 0
                n = int(gone.sum())
                if n:
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                left = b" ".join(words)
                out = hashlib.sha256(left).hexdigest() if digest else left.decode()
                rows.append((doc_id, len(gone), n, out))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c, k)
                        for c, k in zip(
                            zip(*rows, strict=True),
                            (pa.int64(), pa.int64(), pa.int64(), pa.string()),
                            strict=True,
                        )
                    ],
                    names=RESULT.names,
                )

    result = joined.select("doc_id", "text", "one", "starts").mapInArrow(finish, RESULT)
    if "keyed" not in scratch.saved:
        return result
    names = whole.select("row_key", F.col("doc_id").alias("name"))
    return result.join(names, result["doc_id"] == names["row_key"]).select(
        F.col("name").alias("doc_id"), *RESULT.names[1:]
    )
