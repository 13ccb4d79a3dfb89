"""Quality classifier by co-training a view of the text and a view of the page's metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.llm.common import (
    Scratch,
    distinct_names,
    mix,
    pick,
    release_memory,
    word_hashes,
)
from codequarry.llm.language import bounded, labelled_sample
from codequarry.llm.linear import Ftrl, softmax, temperature

# Hashed features of a view; labelled rows to fit on by stratum, which is good, of low quality or
# toxic; unlabelled rows of the pool; bytes of the vectors of a stratum or the pool.
FEATURES = 1 << 18
GOOD, POOR, TOXIC, POOL = "good", "poor", "toxic", "pool"
ROWS_BY_STRATUM = 2000
POOL_ROWS = 2000
SAMPLE_BYTES = 32 << 20
# Part of the labelled rows held back to calibrate on: one in so many.
HELD_BACK = 4
EPOCHS = 5
# Rounds of exchange, rows by class a view passes on in one, and how sure it must be.
ROUNDS = 3
PASSED_ON = 150
SURE = 0.99
PSEUDO_IMPORTANCE = 0.5
# Good held-back rows that the threshold may lose.
LOST = 0.01

# Fixed tables by byte: letters in lower case, all else in ASCII blank.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_KINDS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "blank": (9, 10, 11, 12, 13, 32),
    "mark": [c for c in range(33, 127) if not chr(c).isalnum()],
    "high": range(128, 256),
}
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _index(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int32)


def content_features(data: bytes) -> np.ndarray:
    """Hashed words of a text, as written and in plain letters, each once."""
    written, _, _ = word_hashes(data)
    plain, _, _ = word_hashes(data.translate(_PLAIN))
    return np.unique(np.concatenate((_index(mix(written, 11)), _index(mix(plain, 12)))))


def metadata_features(data: bytes, lang: str | None, source: str | None, n_chars) -> np.ndarray:
    """Hashed facts about the page around its words: columns and layout, in coarse steps."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    total = max(1, len(data))
    shares = {k: counts[list(r)].sum() / total for k, r in _KINDS.items()}
    words = data.split()
    lines = [x for x in data.split(b"\n") if x]
    facts = [
        f"lang={lang}",
        f"source={source}",
        f"chars={int(n_chars).bit_length() if n_chars is not None else None}",
        f"words={len(words).bit_length()}",
        f"lines={len(lines).bit_length()}",
        f"line={(total // max(1, len(lines))).bit_length()}",
        f"same_lines={int(10 * len(set(lines)) / max(1, len(lines)))}",
        f"same_words={int(10 * len(set(words)) / max(1, len(words)))}",
        f"long={int(2 * (len(data) - shares['blank'] * total) / max(1, len(words)))}",
        *(f"{k}={int(20 * v)}" for k, v in shares.items()),
        *(f"any_{k}={int(200 * v) if v < 0.05 else 10}" for k, v in shares.items()),
    ]
    hashed, _, _ = word_hashes(" ".join(f.replace(" ", "_") for f in facts).encode())
    return np.unique(_index(mix(hashed, 13)))


@dataclass
class Model:
    """Weights and bias by view as a log-odds, and how calibrated views are combined."""

    content: np.ndarray
    metadata: np.ndarray
    biases: tuple[float, float]
    mixing: tuple[float, float, float]
    threshold: float
    # Part of the held-back rows that is accepted, by stratum.
    accepted: dict[str, float] | None = None

    def score(self, content: np.ndarray, metadata: np.ndarray) -> float:
        a = float(self.content[content].sum()) + self.biases[0]
        b = float(self.metadata[metadata].sum()) + self.biases[1]
        u, v, w = self.mixing
        return float(1 / (1 + np.exp(-np.clip(u * a + v * b + w, -30, 30))))


def _rows(found: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(at, np.ones(len(at))) for at in found]


def _combine(a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Weights (not negative) of two log-odds and a constant, by penalised logistic regression."""
    x = np.stack([a, b, np.ones(len(a))], axis=1)
    w = np.array([0.5, 0.5, 0.0])
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) / len(labels) + 0.01 * (w - np.array([0.5, 0.5, 0]))
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(labels) + 0.01 * np.eye(3)
        move = np.linalg.solve(curve, slope)
        w = w - move
        w[:2] = np.maximum(w[:2], 0)
        if np.abs(move).max() < 1e-6:
            break
    return tuple(w.tolist())


def co_train(
    views: tuple[list[np.ndarray], list[np.ndarray]],
    labels: list[int],
    pools: tuple[list[np.ndarray], list[np.ndarray]],
    rounds: int = ROUNDS,
    strata: list[str] | None = None,
) -> Model:
    """Fits both views; in each round a view labels what it is sure of in the pool for the other.

    Every fourth labelled row of a stratum is held back: its labels set the temperature of each
    view, the weights of the views and the threshold.
    """
    truth = np.array(labels)
    kinds = np.array(strata if strata is not None else [(POOR, GOOD)[y] for y in labels])
    back = held_back(kinds)
    labelled = [_rows(v) for v in views]
    pool = [_rows(p) for p in pools]
    taught: list[dict[int, int]] = [{}, {}]

    def fit(view: int) -> tuple[Ftrl, float]:
        rows = [r for r, h in zip(labelled[view], back, strict=True) if not h]
        own = truth[~back].tolist()
        more = sorted(taught[view].items())
        weight = np.array([1.0] * len(own) + [PSEUDO_IMPORTANCE] * len(more))
        model = Ftrl(FEATURES, 2, alpha=0.5, l1=0.3, l2=0.1)
        model.fit(
            rows + [pool[view][k] for k, _ in more],
            own + [y for _, y in more],
            epochs=EPOCHS,
            importance=weight,
        )
        held = [r for r, h in zip(labelled[view], back, strict=True) if h]
        return model, temperature(model.scores(held), truth[back])

    models = [fit(0), fit(1)]
    for _ in range(rounds):
        if not pool[0]:
            break
        for view in (0, 1):
            model, heat = models[view]
            p = softmax(model.scores(pool[view]) / heat)
            for label in (0, 1):
                best = np.argsort(-p[:, label], kind="stable")
                sure = [int(k) for k in best if p[k, label] >= SURE and int(k) not in taught[1 - view]]
                taught[1 - view].update((k, label) for k in sure[:PASSED_ON])
        models = [fit(0), fit(1)]

    odds = []
    for view, (model, heat) in enumerate(models):
        held = [r for r, h in zip(labelled[view], back, strict=True) if h]
        scores = model.scores(held) / heat
        odds.append(scores[:, 1] - scores[:, 0])
    mixing = _combine(odds[0], odds[1], truth[back])
    parts = [m.parameters() for m, _ in models]
    model = Model(
        *(((w[:, 1] - w[:, 0]) / h).astype(np.float32) for (w, _), (_, h) in zip(parts, models, strict=True)),
        tuple(float(b[1] - b[0]) / h for (_, b), (_, h) in zip(parts, models, strict=True)),
        mixing,
        0.5,
    )
    u, v, w = mixing
    scores = 1 / (1 + np.exp(-np.clip(u * odds[0] + v * odds[1] + w, -30, 30)))
    by_stratum = {k: scores[kinds[back] == k] for k in sorted(set(kinds[back].tolist()))}
    model.threshold = choose_threshold(
        by_stratum.get(GOOD, np.zeros(0)), [s for k, s in by_stratum.items() if k != GOOD]
    )
    model.accepted = {k: float((s >= model.threshold).mean()) for k, s in by_stratum.items()}
    return model


def held_back(strata: np.ndarray) -> np.ndarray:
    """Every fourth row of each stratum, in their order."""
    back = np.zeros(len(strata), bool)
    for kind in set(strata.tolist()):
        at = np.flatnonzero(strata == kind)
        back[at[::HELD_BACK]] = True
    return back


def choose_threshold(fine: np.ndarray, bad: list[np.ndarray]) -> float:
    """The score from which on documents are accepted.

    Of the thresholds that lose at most LOST of the good rows the one that lets the least part
    of any bad stratum pass, of such the lowest; then half way down to the next score below.
    """
    if not len(fine):
        return 0.5
    scores = np.unique(np.concatenate([fine, *bad]))
    best, chosen = None, 0
    for k, t in enumerate(scores.tolist()):
        if (fine < t).mean() > LOST:
            break
        passed = max(((b >= t).mean() for b in bad if len(b)), default=0.0)
        if best is None or passed < best:
            best, chosen = passed, k
    below = scores[chosen - 1] if chosen else 0.0
    return float((scores[chosen] + below) / 2)


def train(
    docs: DataFrame,
    labels: DataFrame,
    rows_by_stratum: int = ROWS_BY_STRATUM,
    pool_rows: int = POOL_ROWS,
) -> Model | None:
    """A model from bounded samples of labelled and of unlabelled documents; None without both
    classes. Good is quality 1 and not toxic.

    Samples are chosen by hashes of ids or texts alone; what the driver gets of them is bounded
    in rows and in bytes, by stratum.
    """
    scratch = Scratch(docs.sparkSession)
    known = pick(labels, "doc_id", "quality", "toxic").filter("doc_id is not null and quality is not null")
    toxic = F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")) == 1
    stratum = F.when(toxic, TOXIC).when(F.min((F.col("quality") == 1).cast("int")) == 1, GOOD).otherwise(POOR)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(stratum.alias("stratum"))
    chosen = labelled_sample(known, "stratum", rows_by_stratum, "doc_id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(*row) for row in _wanted(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("stratum"),
                    batch.column("sample_draw"),
                    pa.array([c.tobytes() for c, _ in found], pa.binary()),
                    pa.array([m.tobytes() for _, m in found], pa.binary()),
                ],
                names=["stratum", "sample_draw", "content", "metadata"],
            )

    # At most so many ids by stratum.
    labelled = docs.join(F.broadcast(chosen), "doc_id").select(*COLUMNS, "stratum", "sample_draw")
    free = docs.withColumn("stratum", F.lit(POOL)).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    pool = labelled_sample(free, "stratum", pool_rows, "doc_id", "text").select(*labelled.columns)
    schema = "stratum string, sample_draw long, content binary, metadata binary"
    taken = scratch.save(labelled.unionByName(pool).mapInArrow(vectors, schema), "taken")
    size = F.octet_length("content") + F.octet_length("metadata")
    found = bounded(taken, "stratum", size, SAMPLE_BYTES).collect()
    found.sort(key=lambda r: (r["sample_draw"], bytes(r["content"]), bytes(r["metadata"])))
    seen, free = ([r for r in found if (r["stratum"] == POOL) == k] for k in (False, True))
    strata = [r["stratum"] for r in seen]
    truth = [int(k == GOOD) for k in strata]
    back = held_back(np.array(strata, str))
    if len({y for y, b in zip(truth, back, strict=True) if not b}) < 2 or len(set(truth)) < 2:
        return None

    def of(rows: list, column: str) -> list[np.ndarray]:
        return [np.frombuffer(r[column], np.int32) for r in rows]

    return co_train(
        (of(seen, "content"), of(seen, "metadata")),
        truth,
        (of(free, "content"), of(free, "metadata")),
        strata=strata,
    )


def features(text, lang, source, n_chars) -> tuple[np.ndarray, np.ndarray]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return content_features(data), metadata_features(data, lang, source, n_chars)


def _wanted(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in COLUMNS[1:]), strict=True)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    rows_by_stratum: int = ROWS_BY_STRATUM,
    pool_rows: int = POOL_ROWS,
) -> DataFrame:
    """`docs` with quality_score (0 to 1) and accepted; columns of these names are replaced,
    and of names alike but for case one stays.

    Trained on `labels` (doc_id, quality, toxic): good documents are of quality 1 and not
    toxic. Two views, hashed words of the text and facts of the page (source, language, length,
    layout), are fitted apart, teach each other what they are sure of, and their calibrated
    log-odds are combined. The threshold keeps 99 % of the good held-back rows and, within that,
    lets the least part of the poor or of the toxic ones pass.

    Samples are bounded: `rows_by_stratum` labelled rows that are good, poor or toxic, and
    `pool_rows` unlabelled ones to exchange labels on. All documents are scored whole. Null
    and empty texts have no words and are scored by the rest; nulls in other columns are
    values of their own; labels that are null are ignored, the worst of repeated ones counts;
    repeated rows are scored alike; without labels of both kinds all get 1.0 and are accepted;
    an empty table gives an empty result. No text is shuffled.
    """
    Scratch(docs.sparkSession)  # sets the size of batches
    names = distinct_names(docs, *COLUMNS, without=("quality_score", "accepted"))
    docs = pick(docs, *names)
    model = train(pick(docs, *COLUMNS), labels, rows_by_stratum, pool_rows)
    if model is None:
        return docs.withColumn("quality_score", F.lit(1.0)).withColumn("accepted", F.lit(True))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (text, lang, source, n_chars)), strict=True)
        scores = [sent.value.score(*features(*row)) for row in rows]
        release_memory()
        return pa.array(scores, pa.float64())

    # Scores alone come back from Python; what nobody selects does not go there. Marked so that
    # the score is taken once, whatever is done with it.
    scored = docs.withColumn("quality_score", score.asNondeterministic()(*COLUMNS[1:]))
    return scored.withColumn("accepted", F.col("quality_score") >= model.threshold)
