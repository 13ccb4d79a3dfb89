"""Best-fit packing of documents into token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.llm.common import Scratch, add_fields, lean, pick, rank_within, with_columns

# Bytes of the stretches and words whose ids a task keeps in each of two generations, and what
# an entry takes besides its letters and ids.
STRETCH_BYTES = 48 << 20
WORD_BYTES = 40 << 20
ENTRY_BYTES = 190
LONGEST_KEPT = 48
# Bits of a rank within a length; the length takes the bits above.
RANK_BITS = 44

# Stretches that fall apart by themselves: a word of these letters, then marks of one kind.
# Lower case of these letters is one letter each, and no mark joins a word or a contraction.
_LETTERS = "a-z\u00e0-\u00f6\u00f8-\u00fe"
_PLAIN = re.compile(rf"([{_LETTERS}]+)([!-&(-/:-@\[-`{{-~]*)")

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


class Recent:
    """What was looked up lately: a generation in use and the one before it, bounded in bytes."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if self.size >= self.most:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[key] = value
        self.size += ENTRY_BYTES + len(key) + len(value)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and no token spans it, so texts are encoded by the
    stretches between blanks and line ends, and those met before are looked up. A new stretch
    that is a plain word with marks behind it is put together from the two, which its own
    rules would split it into; only new words reach the tokenizer's model. All others are
    encoded whole. Ids fit 16 bits while kept, if the vocabulary does.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.stretches, self.words = Recent(STRETCH_BYTES), Recent(WORD_BYTES)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {
            c: level.pre_tokenize_str(chr(c))[0][0] for c in range(33, 255) if not chr(c).isspace()
        }
        self.plain = self._splits_as_stated()

    def _splits_as_stated(self) -> bool:
        """Does this tokenizer take plain words and marks apart as assumed here?"""
        tried = ("abc", "\u00e9t\u00e9", "word", "a", "x,", "abc...", "thee!?", "na\u00efve;-)")
        return all(
            self._whole([t.upper(), t]) == [self._by_parts(t)] * 2 for t in tried
        )

    def _whole(self, stretches: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in coded]

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            tokens = self.tokenizer.model.tokenize(word.translate(self.signs))
            ids = np.array([t.id for t in tokens], self.kind).tobytes()
            if len(word) <= LONGEST_KEPT:
                self.words.put(word, ids)
        return ids

    def _by_parts(self, stretch: str) -> bytes | None:
        parts = _PLAIN.fullmatch(stretch.lower())
        if parts is None or len(parts[0]) != len(stretch):
            return None
        word, marks = parts.groups()
        return self._word(word) + self._word(marks) if marks else self._word(word)

    def _encoded(self, new: list[str]) -> dict[str, bytes]:
        found, rest = {}, []
        for stretch in new:
            ids = self._by_parts(stretch) if self.plain else None
            if ids is None:
                rest.append(stretch)
            else:
                found[stretch] = ids
        if rest:
            found.update(zip(rest, self._whole(rest), strict=True))
        return found

    def __call__(self, text: str) -> bytes:
        for blank in "\n\t\r":
            if blank in text:
                text = text.replace(blank, " ")
        words = text.split(" ")
        found = list(map(self.stretches.new.get, words))
        if None in found:
            fresh, new = {}, []
            for w in {w for w, ids in zip(words, found, strict=True) if ids is None}:
                ids = self.stretches.get(w)
                if ids is None:
                    new.append(w)
                else:
                    fresh[w] = ids
            for w, ids in self._encoded(new).items():
                fresh[w] = ids
                if len(w) <= LONGEST_KEPT:
                    self.stretches.put(w, ids)
            found = [fresh[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        data = b"".join(found)
        if self.kind == "<u2":
            data = np.frombuffer(data, "<u2").astype("<u4").tobytes()
        return data


    def forget(self) -> None:
        self.stretches.clear()
        self.words.clear()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False
) -> DataFrame:
    """The pieces of each document: its ids and `end_id`, cut every `capacity` ids."""
    schema = T.StructType(
        [*PIECE.fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])]
    )

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, closing = encoder(tokenizer), np.uint32(end_id).tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                data = encode(text or "") + closing
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, part) if with_ids else row)
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)],
                    names=schema.names,
                )
        encode.forget()

    chosen = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return chosen.mapInArrow(cut, schema)


def plan_best_fit(
    counts: dict[int, int], capacity: int
) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit by falling length over counts by length.

    Returns entries (length, first rank, items in a sequence, first sequence, offset) and the
    number of sequences. The items of a length from `first rank` on go, so many to each, to
    consecutive sequences from `first sequence`, the first of them at `offset`. Sequences with
    equal room are interchangeable, so runs of them are filled at once: a run that takes an
    item loses at least half its room, hence entries are at most about 2 * lengths *
    log2(capacity), whatever the number of documents.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, number) of each run
    rooms: list[int] = []
    opened = 0

    def keep(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            place = bisect.bisect_left(rooms, length)
            if place < len(rooms):
                room = rooms[place]
                first, number = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[place]
            else:
                room, first = capacity, opened
                number = -(-left // (capacity // length))
                opened += number
            each = room // length
            full = min(number, left // each)
            taken = min(left, number * each)
            plan.append((length, rank, each, first, capacity - room))
            keep(room - each * length, first, full)
            rest = taken - full * each
            if rest:
                keep(room - rest * length, first + full, 1)
            used = full + bool(rest)
            keep(room, first + used, number - used)
            left -= taken
            rank += taken
    return plan, opened


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents with their sequence_id and the offset there.

    Pieces are written once with their rank within their length. Only the histogram of
    lengths, at most `capacity` rows, reaches the driver, and only the plan, bounded by
    capacity as well, is broadcast. Documents longer than `capacity` alone are cut.

    Null and empty texts are one closing id; a null doc_id stays null; repeated rows are
    packed each for itself; ties of length are broken by place; an empty table gives an empty
    result. A length may hold any share of the rows (see `rank_within`). with_ids adds the
    ids of a piece as little-endian unsigned 32-bit bytes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    ranked = rank_within(
        pieces(docs, tokenizer, capacity, end_id, with_ids), "length", scratch, "pieces"
    )
    written = spark.read.parquet(f"{scratch.folder}/pieces")
    counts = {r[0]: r[1] for r in written.groupBy("length").count().collect()}
    plan, _ = plan_best_fit(counts, capacity)
    entries = np.array(sorted(plan), np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(entries)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = sent.value
        keys = (entries[:, 0] << RANK_BITS) | entries[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            wanted = (length << RANK_BITS) | rank
            _, first, each, sequence, offset = entries[np.searchsorted(keys, wanted, "right") - 1].T
            k = rank - first
            yield with_columns(
                batch, sequence_id=sequence + k // each, offset=offset + k % each * length
            )

    schema = add_fields(ranked, sequence_id=T.LongType(), offset=T.LongType())
    return ranked.mapInArrow(place, schema).drop("rank")
