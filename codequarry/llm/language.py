"""Language ID: sparse softmax regression on TF-IDF character n-grams, calibrated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import Scratch, mix, pick
from codequarry.llm.linear import Ftrl, softmax, temperature

# Lengths of n-grams in characters, and bits of their hashed features.
LENGTHS = (1, 2, 3)
BITS = 18
# Labelled rows to fit on: by language, in all, and the bytes of their vectors in all.
ROWS_BY_LANGUAGE = 1000
ROWS_IN_ALL = 50_000
SAMPLE_BYTES = 96 << 20
# Weights of a model, features times languages; with many languages there are fewer features. The
# most frequent languages are learned, up to so many.
WEIGHTS = 1 << 23
MOST_LANGUAGES = 2048
# Part of these rows held back to calibrate on: one in so many.
HELD_BACK = 5
# A longer text is looked at in stretches of so many characters.
STRETCH = 1 << 18
UNKNOWN = "und"


def _plain(text: str) -> str:
    """Lower case, with blanks at the ends."""
    return f" {text.lower()} "


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str, bits: int = BITS) -> Iterator[np.ndarray]:
    """Hashed features of all n-grams, by the stretch they begin in."""
    plain = _plain(text)
    ahead = max(LENGTHS) - 1
    for at in range(0, len(plain), STRETCH):
        part = plain[at : at + STRETCH + ahead]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        points[(points < 128) & ~_LETTERS[np.minimum(points, 127).astype(np.int64)]] = 32
        h = points
        for n in LENGTHS:
            if n > 1:
                if len(points) < n:
                    break
                h = h[:-1] * np.uint64(0x100000001B3) + points[n - 1 :]
            yield (mix(h[:STRETCH], n) >> np.uint64(64 - bits)).astype(np.int64)


_LETTERS = np.array([chr(c).isalpha() for c in range(128)])


def gram_counts(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often each occurs."""
    found = list(grams(text, bits))
    return np.unique(np.concatenate(found), return_counts=True)


def learnable() -> Column:
    """Rows to learn from: a language, a text, and a remainder by doc_id other than 1."""
    return ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def document_frequencies(docs: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """In how many rows of (text) each feature is, and the number of rows.

    Tasks add up their rows in a fixed array; the arrays are added up by Spark.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((1 << bits) + 1, np.int64)
        mark = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts[-1] += 1
                seen = np.concatenate(list(grams(text or "", bits)))
                place = np.arange(len(seen))
                mark[seen] = place
                counts[seen[mark[seen] == place]] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    summed = docs.select("text").mapInArrow(scan, "at long, n long").groupBy("at").agg(F.sum("n"))
    counts = np.zeros((1 << bits) + 1, np.int64)
    for at, n in summed.collect():
        counts[at] = n
    return counts[:-1], int(counts[-1])


def labelled_sample(docs: DataFrame, by: str, rows: int, *key: str) -> DataFrame:
    """Up to `rows` rows of each value of `by`, with their `sample_draw`: those of least hash of
    the columns `key`, rows alike in `by` and `key` counting once.

    Hashes alone are ranked, in each task first. What is chosen is then looked up in the table;
    it is broadcast if it is small by its size.
    """
    scratch = Scratch(docs.sparkSession)
    drawn = docs.filter(F.col(by).isNotNull()).withColumn("sample_draw", F.xxhash64(F.lit("sample"), *key))
    order = Window.partitionBy(by).orderBy("sample_draw")
    ranked = drawn.select(by, "sample_draw").distinct().withColumn("sample_rank", F.row_number().over(order))
    chosen = scratch.save(ranked.filter(F.col("sample_rank") <= rows).drop("sample_rank"), "chosen")
    return drawn.join(chosen, [by, "sample_draw"], "left_semi").dropDuplicates([by, "sample_draw"])


def bounded(rows: DataFrame, by: str, size: Column, most: int) -> DataFrame:
    """Of (by, sample_draw, ...) the rows of least draw of each value, `most` bytes of each."""
    order = Window.partitionBy(by).orderBy("sample_draw").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(order), F.lit(0))
    return rows.withColumn("sample_size", before + size).filter((F.col("sample_size") <= most)).drop("sample_size")


class Model:
    """Languages, the weight of each feature for each of them times its IDF, and bias."""

    def __init__(
        self, names: list[str], table: np.ndarray, bias: np.ndarray, heat: float, bits: int = BITS
    ):
        self.names, self.table, self.bias, self.heat, self.bits = names, table, bias, heat, bits

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text) or not self.names:
            return UNKNOWN, 0.0
        total, count = np.zeros(len(self.names)), 0
        for seen in grams(text, self.bits):
            total += self.table.take(seen, axis=0).sum(axis=0, dtype=np.float64)
            count += len(seen)
        p = softmax((SCALE * total / max(count, 1) + self.bias) / self.heat)
        best = int(p.argmax())
        return self.names[best], float(p[best])


# Term frequencies are shares of a text's n-grams; scaled so that values are near 1.
SCALE = 30.0


def train(docs: DataFrame, rows_by_language: int = ROWS_BY_LANGUAGE) -> Model:
    """Fits on (doc_id, text, lang), lang and text not null. IDF is over all rows; weights on a
    bounded sample.

    What the driver holds is bounded: `rows_by_language` rows of a language, ROWS_IN_ALL and
    SAMPLE_BYTES of all, shared out by language, WEIGHTS weights. Beyond MOST_LANGUAGES the
    most frequent ones are learned (ties: the first by name).
    """
    scratch = Scratch(docs.sparkSession)
    known = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()
    names = sorted(r["lang"] for r in known[:MOST_LANGUAGES])
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    bits = min(BITS, (WEIGHTS // len(names)).bit_length() - 1)
    counts, total = document_frequencies(docs, bits)
    idf = (np.log((1 + total) / (1 + counts)) + 1).astype(np.float64)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gram_counts(t, bits) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang"),
                    batch.column("sample_draw"),
                    pa.array([f[0].astype(np.int32).tobytes() for f in found], pa.binary()),
                    pa.array([f[1].astype(np.int32).tobytes() for f in found], pa.binary()),
                ],
                names=["lang", "sample_draw", "at", "n"],
            )

    if len(known) > MOST_LANGUAGES:
        docs = docs.filter(F.col("lang").isin(names))
    rows = max(1, min(rows_by_language, ROWS_IN_ALL // len(names)))
    sample = labelled_sample(docs.select("doc_id", "text", "lang"), "lang", rows, "doc_id", "text")
    sample = sample.select("lang", "sample_draw", "text").mapInArrow(
        vectors, "lang string, sample_draw long, at binary, n binary"
    )
    size = F.octet_length("at") + F.octet_length("n")
    # A vector may take all that there is for a language: one always has room.
    share = max(8 << bits, SAMPLE_BYTES // len(names))
    sample = bounded(scratch.save(sample, "sample"), "lang", size, share)
    found = sorted(sample.collect(), key=lambda r: (r["lang"], r["sample_draw"]))
    rows, labels = [], []
    for r in found:
        at, n = np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int32)
        rows.append((at, SCALE * n / n.sum() * idf[at]))
        labels.append(names.index(r["lang"]))
    back = [k for k in range(len(rows)) if k % HELD_BACK == 0 and len(rows) > 2 * HELD_BACK]
    kept = [k for k in range(len(rows)) if k not in set(back)]
    model = Ftrl(1 << bits, len(names)).fit([rows[k] for k in kept], [labels[k] for k in kept])
    heat = temperature(model.scores([rows[k] for k in back]), np.array([labels[k] for k in back], int))
    weights, bias = model.parameters()
    return Model(names, weights * idf[:, None].astype(np.float32), bias, heat, bits)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(row_key, lang_pred, score) of each whole text of (row_key, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        scan, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def language_id(docs: DataFrame, rows_by_language: int = ROWS_BY_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the language of every whole text.

    Learned from text and lang of documents with crc32(doc_id as text) mod 3 other than 1
    (held_out is true for 1); a prediction sees the text only. score is the calibrated
    probability of lang_pred.

    Text that is null or has no letter is `und` with score 0, and so is every text if nothing
    can be learned; a null doc_id is not held out; repeated rows are rows of their own; ties go
    to the first language by name; an empty table gives an empty result. No text is shuffled.
    """
    Scratch(docs.sparkSession)  # sets the size of batches
    rows = pick(docs, "doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = train(rows.filter(learnable()), rows_by_language)
    return identify(rows.withColumn("held_out", held_out()), model)
