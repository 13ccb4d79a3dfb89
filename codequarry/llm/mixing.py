"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import Scratch, distinct_names, pick

# Steps of all sources up to which rates are broadcast (counted first), some 50 MB; beyond it
# they are joined.
BROADCAST_STEPS = 6_400_000
# Largest mean of one draw: exp(-mean) must stay far from the least double. The sum of draws of
# equal means is a draw of the sum of their means.
DRAWN_RATE = 700
ADDED = ("rate", "n_copies", "copy", "shuffle_key")


def uniform(*parts: Column | str) -> Column:
    """In [0, 1), from 52 bits of an MD5 of the parts joined by '|'."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(2.0**52)


def rates(
    docs: DataFrame, power: float = 0.7, epochs: float = 1.0, weights: dict | None = None
) -> DataFrame:
    """(source, rate): how often a document of each source is to appear on average.

    Size is the bytes of text plus one by document. A source's target share of the output is
    its `weights` entry by the sum of entries (sources without one get 0), or, without
    weights, size ** power by the sum of these; the output is `epochs` times the input.
    """
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).alias("size")
    )
    sizes = Scratch(docs.sparkSession).save(sizes, "sizes")  # used twice: one pass over the texts
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(power)))
    else:
        known = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else None
        found = F.coalesce(known[F.col("source")].cast("double"), F.lit(0.0)) if weights else F.lit(0.0)
        sizes = sizes.withColumn("weight", found)
    total, weight = sizes.agg(F.sum("size"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(weight or 1.0)
    rate = share * F.lit(float(total or 0) * epochs) / F.col("size")
    return sizes.select("source", F.round(rate, 6).alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, 2 ... copies, to where the tail is nothing."""
    last = (rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("steps"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        following = F.element_at(state["steps"], -1) + p
        return F.struct(p.alias("p"), F.concat(state["steps"], F.array(following)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["steps"]


def mix_sources(
    docs: DataFrame,
    power: float = 0.7,
    epochs: float = 1.0,
    weights: dict | None = None,
    seed: int = 42,
) -> DataFrame:
    """Each document as often as a Poisson draw says, all copies shuffled over the whole output.

    The draw inverts the Poisson distribution whose mean is the source's rate at a uniform
    number hashed from (seed, doc_id), so a rerun or a lost executor changes nothing. A rate above
    DRAWN_RATE is shared out evenly among as few draws as needed, each at a number hashed from
    (seed, doc_id, its place), and their counts are added: Poisson with that rate again. Added
    columns: rate, n_copies, copy (from 1), shuffle_key; columns of these names are replaced, and
    of names alike but for case one stays.
    Rows go to partitions by their random key and are sorted by it there.

    Null source counts as source ''; null text as empty; null doc_id is drawn like 'null';
    repeated rows each get the count of their doc_id; an empty table gives an empty result.
    A hot source costs nothing: rates are aggregated in tasks first and no row is grouped.
    """
    scratch = Scratch(docs.sparkSession)
    names = distinct_names(docs, "doc_id", "text", "source", without=ADDED)
    docs = pick(docs, *names)
    by_source = scratch.save(rates(docs, power, epochs, weights), "rates")
    draws = F.greatest(F.ceil(F.col("rate") / F.lit(DRAWN_RATE)), F.lit(1)).cast("int")
    by_source = by_source.select(
        F.col("source").alias("rate_source"),
        "rate",
        draws.alias("rate_draws"),
        poisson_steps(F.col("rate") / draws).alias("rate_steps"),
    )
    if (by_source.agg(F.sum(F.size("rate_steps"))).first()[0] or 0) <= BROADCAST_STEPS:
        by_source = F.broadcast(by_source)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    seeded = F.lit(str(seed))

    def draw(place: Column) -> Column:
        return uniform(seeded, F.lit("copies"), key, F.when(place > 1, place.cast("string")))

    def count(total: Column, drawn: Column) -> Column:
        return total + F.size(F.filter("rate_steps", lambda c: c <= drawn))

    numbers = F.transform(F.sequence(F.lit(1), F.col("rate_draws")), draw)
    copies = (
        docs.join(by_source, F.coalesce(docs["source"], F.lit("")) == F.col("rate_source"))
        .withColumn("rate_numbers", numbers)
        .withColumn("n_copies", F.aggregate("rate_numbers", F.lit(0), count))
        .filter("n_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
        .withColumn(
            "shuffle_key",
            F.substring(
                F.md5(F.concat_ws("|", seeded, F.lit("order"), key, F.col("copy")).cast("binary")),
                1,
                16,
            ),
        )
        .select(*names, *ADDED)
    )
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
