"""The registered queries of the operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import (
    embeddings,
    exact,
    fingerprints,
    language,
    mixing,
    packing,
    periods,
    pii,
    quality,
    sharding,
    simhash,
    spelling,
    substrings,
)
from codequarry.llm.common import pick, table

CAPACITY = 4096
END_ID = 1
SHARDS = 8


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select(
        "doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id", "kept"
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), CAPACITY, END_ID)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=20, digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.classify(docs, labels).select("doc_id", "source", "quality_score", "accepted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "rate", "n_copies", "copy", "shuffle_key")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def misspelt(doc_id: Column, run: Column) -> Column:
    """The run without one letter, for about one in 199 of the (document, run)."""
    seed = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run)
    h = F.crc32(seed.cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % 199 == 0, shorter).otherwise(run)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(
        table(spark, sf_dir, "documents"), least_length=6, least_count=5, respell=misspelt
    )
    return spelling.group_variants(words, times=5)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(table(spark, sf_dir, "documents"), keep="largest")


def with_repeats(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text); in about one document of ten the words from some place on become
    repeats of the first few there."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        again = F.transform(
            w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int")))
        )
        return F.when(n > 0, F.array_join(again, " ")).otherwise("")

    # One array of one array: its words are taken once, not for each place.
    changed = F.get(F.transform(F.array(words), repeated), F.lit(0))
    text = F.when((h % 10 == 0) & F.col("text").isNotNull(), changed).otherwise(F.col("text"))
    return pick(docs, "doc_id", "text").select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_repeats(table(spark, sf_dir, "documents"))
    return periods.digests(periods.collapse(docs, least=12, digest=True))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_simhash,
        op2_embedding_dedup,
        op3_best_fit_packing,
        op4_sharding,
        op5_substring_dedup,
        op6_language_id,
        op7_quality_classifier,
        op8_mixing,
        op9_fingerprints,
        op10_pii,
        op11_spelling,
        op12_exact_dedup,
        op13_periodic_runs,
        pipeline,
    )
    return {f.__name__: f for f in found}


OP2 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links,
  least(e.vec_id, coalesce(least.b, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(least.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN least ON e.vec_id = least.a LEFT JOIN n ON e.vec_id = n.a
"""

OP5 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, pos, list_slice(words, pos, pos + 19) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM w)
), later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS n FROM windows
  ) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM later
), word AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept
  FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP8 = """
WITH RECURSIVE size AS (
  SELECT coalesce(source, '') AS source, sum(coalesce(strlen(text), 0) + 1) AS size
  FROM documents GROUP BY 1
), rate AS (
  SELECT source, round(pow(CAST(size AS DOUBLE), 0.7) / (SELECT sum(pow(CAST(size AS DOUBLE), 0.7)) FROM size)
    * CAST((SELECT sum(size) FROM size) AS DOUBLE) / size, 6) AS rate FROM size
), mean AS (
  SELECT source, rate, draws, rate / draws AS mean
  FROM (SELECT *, CAST(greatest(ceil(rate / 700), 1) AS INT) AS draws FROM rate)
), step AS (
  SELECT source, rate, draws, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM mean
  UNION ALL
  SELECT source, rate, draws, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM step
  WHERE k + 1 <= CAST(floor(mean + 12 * sqrt(mean) + 30) AS INT)
), draw AS (
  SELECT doc_id, d.source, rate, unnest(range(1, draws + 1)) AS place
  FROM documents d JOIN mean m ON coalesce(d.source, '') = m.source
), number AS (
  SELECT doc_id, source, rate, CAST('0x' || substr(md5('42|copies|' || doc_id
    || CASE WHEN place > 1 THEN '|' || place ELSE '' END), 1, 13) AS BIGINT) / pow(2, 52) AS u
  FROM draw
), copies AS (
  SELECT doc_id, d.source, d.rate, count(*) AS n
  FROM number d JOIN step s ON coalesce(d.source, '') = s.source AND s.c <= d.u GROUP BY ALL
)
SELECT doc_id, source, rate, CAST(n AS INT) AS n_copies, CAST(copy AS INT) AS "copy",
  substr(md5('42|order|' || doc_id || '|' || copy), 1, 16) AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM copies)
"""

OP11 = """
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, b)) AS t
), run AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents
), counted AS (SELECT doc_id, run, count(*) AS n FROM run GROUP BY ALL),
byte AS (SELECT doc_id, run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS b FROM counted
), hashed AS (
  SELECT doc_id, run, n, xor(CAST(4294967295 AS BIGINT), list_reduce(
    list_transform(range(1, len(b), 2), lambda i: CAST('0x' || substr(b, CAST(i AS INT), 2) AS BIGINT)),
    lambda c, v: xor(c >> 8, t[CAST((xor(c, v) & 255) + 1 AS INT)]), CAST(4294967295 AS BIGINT))) AS h
  FROM byte, steps
), word AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT))
    || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), letter AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word
), gone AS (
  SELECT word, i, substr(word, 1, CAST(i AS INT) - 1) AS head, substr(word, CAST(i AS INT) + 1) AS tail FROM letter
), near AS (
  SELECT a.word AS a, b.word AS b FROM gone a JOIN gone b USING (i, head, tail) WHERE a.word <> b.word
  UNION SELECT g.word, w.word FROM gone g JOIN word w ON g.head || g.tail = w.word
  UNION SELECT w.word, g.word FROM gone g JOIN word w ON g.head || g.tail = w.word
), best AS (
  SELECT a, count(*) AS n_near, arg_min(b, (-n, encode(b))) AS b, max(n) AS b_n
  FROM near JOIN word ON b = word GROUP BY a
), known AS (
  SELECT word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
    CASE WHEN b_n >= 5 * n THEN b END AS form, CASE WHEN b_n >= 5 * n THEN b_n END AS form_n
  FROM word LEFT JOIN best ON word = a
), chain AS (
  SELECT word, word AS root, form AS further FROM known
  UNION ALL
  SELECT c.word, k.word, k.form FROM chain c JOIN known k ON c.further = k.word
)
SELECT word, form, root, n, n_near, form_n
FROM known JOIN (SELECT word, root FROM chain WHERE further IS NULL) USING (word)
"""

OP12 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
) WINDOW same AS (PARTITION BY norm)
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say what an operator does; the others are tested by brute force."""
    return {
        "op2_embedding_dedup": OP2,
        "op5_substring_dedup": OP5,
        "op8_mixing": OP8,
        "op11_spelling": OP11,
        "op12_exact_dedup": OP12,
    }
