"""Spelling variants: words one edit apart, found in the sorted rotations of marked words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import Scratch, pick
from codequarry.llm.exact import ascii_lower

LETTERS = "A-Za-zÀ-ÿ"
# Marks the end of a word in its rotations; no word may hold it.
END = "$"


def vocabulary(
    docs: DataFrame,
    letters: str = LETTERS,
    least_length: int = 6,
    least_count: int = 5,
    respell: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(word, n): maximal runs of `letters` in whole texts, A-Z in lower case, and how often.

    `respell` makes a word of (doc_id, run) before it is counted. Null texts have no words; rows
    with a null doc_id and repeated rows count like others. Counts are combined by task before
    they are shuffled, so a word may hold any share.
    """
    texts = pick(docs, "doc_id", "text").filter("text is not null")
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"[{letters}]+"), F.lit(0))
    words = texts.select("doc_id", F.explode(runs).alias("word"))
    if respell is not None:
        words = words.select(respell(F.col("doc_id"), F.col("word")).alias("word"))
    counted = words.filter(F.length("word") >= least_length).groupBy("word")
    return counted.agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(key, whole, first, word, order): what sorting the rotations of each word is to bring together.

    A rotation of `word$` ends in the letter in front of the place it begins at. Whole, it is a
    key by itself; without that letter, it is the key of the word with the letter replaced or
    deleted. `first` is false where the letter repeats the one in front of it: deleting either
    gives the same word, so only the first may meet shorter words. `order` is smallest for the
    most frequent word, then by code points.
    """
    turned = words.select(
        "word",
        F.struct((-F.col("n")).alias("less"), "word").alias("order"),
        F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"),
    )
    at = F.col("at")
    head, tail = F.substring("word", F.lit(1), at), F.substring("word", at + 1, F.length("word"))
    letter, before = F.substring("word", at, F.lit(1)), F.substring("word", at - 1, F.lit(1))
    turned = turned.select(
        F.concat(tail, F.lit(END), head).alias("rotation"),
        ((at == 1) | (letter != before)).alias("first"),
        "at",
        "word",
        "order",
    )
    whole = F.struct(F.col("rotation").alias("key"), F.lit(True).alias("whole"), F.lit(False).alias("first"))
    shorter = F.substring("rotation", F.lit(1), F.length("word"))
    skipped = F.struct(shorter.alias("key"), F.lit(False).alias("whole"), "first")
    both = F.when(at == 0, F.array(whole)).otherwise(F.array(whole, skipped))
    return turned.select(F.explode(both).alias("r"), "word", "order").select("r.*", "word", "order")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): of each word with any, how many words are one inserted, deleted or
    replaced letter away, and the most frequent of them as (less, word), less being -n.

    A pair meets under one key only: replacements with the same letter skipped, a longer with a
    shorter word where the skipped letter is the first of its kind. Rotations are sorted by key
    and scanned; of each group every member takes the count and the best other member, so no
    pairs are listed. A group holds at most one word for each letter and one without, however
    large the vocabulary is.
    """
    by_key = Window.partitionBy("key").orderBy("whole", "order")
    group = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    skipped, whole, first = ~F.col("whole"), F.col("whole"), F.col("first")
    order = F.col("order")
    seen = rotations(words).select(
        "word", "order", "whole", "first",
        F.count_if(skipped).over(group).alias("alike"),
        F.count_if(whole).over(group).alias("shorter"),
        F.count_if(first).over(group).alias("longer"),
        F.nth_value(F.when(skipped, order), 1, True).over(group).alias("best"),
        F.nth_value(F.when(skipped, order), 2, True).over(group).alias("second"),
        F.min(F.when(whole, order)).over(group).alias("best_shorter"),
        F.min(F.when(first, order)).over(group).alias("best_longer"),
    )
    other = F.when(F.col("best.word") == F.col("word"), F.col("second")).otherwise(F.col("best"))
    found = seen.select(
        "word",
        F.when(whole, F.col("longer"))
        .otherwise(F.col("alike") - 1 + F.when(first, F.col("shorter")).otherwise(0))
        .alias("near"),
        F.when(whole, F.col("best_longer"))
        .otherwise(F.least(other, F.when(first, F.col("best_shorter"))))
        .alias("best"),
    ).filter("near > 0")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def group_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for (word, n), words distinct and not null.

    form is the most frequent word one edit away (ties: the smallest by code points), if it is
    `times` (above 1) as frequent as the word; root is where following forms ends, the word
    itself without one. Each step multiplies the count, so chains have at most
    log(largest n) / log(times) steps, which doubling the steps takes in a few rounds.

    An empty table gives an empty result.
    """
    if times < 2:
        raise ValueError("a form must be more frequent than its variants")
    scratch = Scratch(words.sparkSession)
    words = scratch.save(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best_n = -F.col("best.less")
    formed = best_n >= F.col("n") * times
    known = words.join(near_words(words), "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best.word")).alias("form"),
        F.when(formed, best_n).alias("form_n"),
    )
    known = scratch.save(known, "known")
    steps, turn, left = known.filter("form is not null").select("word", F.col("form").alias("root")), 0, True
    while left:
        steps = scratch.save(steps, f"steps_{turn}")
        turn += 1
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = steps.join(ahead, "root", "left")
        left = not moved.filter("further is not null").isEmpty()
        steps = moved.select("word", F.coalesce("further", "root").alias("root"))
    return known.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
