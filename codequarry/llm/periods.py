"""Runs of words that repeat with a period, found by minimizers at several scales.

A run is a stretch of consecutive words with smallest period q that no neighbour extends, of
at least two periods. All of them are found, nested and overlapping ones too:

* Periods below FIRST_SCALE by comparing the text with itself at that lag.
* At scale w, periods q from w to below 2w. Grams of g = w/2 words have exact names. Each window
  of w words selects the gram of least hash (the leftmost) that has no period up to g/2. A run
  repeats its windows q words on, so what one of them selects is selected again at distance q.
  Places of such a gram are over g/2 apart, hence q is the distance to one of the next seven.
  Each pair is extended to the whole stretch of that lag by comparing words.
* Windows of a run that select nothing have a period p up to g/2. If all of them do, the run lies
  over two runs of that period, one over each of its ends, that touch or overlap; both are known
  from smaller scales. All lags that bring their letters together are tried.

A run of period q holds every gram of its first windows twice, so once no gram of a scale occurs
twice in a text, no larger scale has runs. Most texts end there at the first scale.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import Scratch, distinct_names, mix, pick

# The first period not looked for by direct comparison; a power of two.
FIRST_SCALE = 32
# Places of one gram that can lie within two windows (see above).
NEXT_PLACES = 7
# Words whose text is put together at once.
_AT_ONCE = 1 << 18
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_NONE = np.iinfo(np.int64).max


def word_places(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts between `cuts` in UTF-8 bytes: name, first byte and end byte of each word.

    Equal words have equal names, different ones different names.
    """
    blank = _BLANK[raw]
    change = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edges = np.union1d(change, cuts)
    starts = edges[:-1]
    inside = ~blank[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[inside].astype(np.int64), edges[1:][inside].astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    array = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~blank])]
    )
    names = array.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return names.astype(np.int64), starts, ends


def _pair_names(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of pairs, and whether each occurs more than once."""
    order = np.lexsort((right, left))
    a, b = left[order], right[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    sorted_names = np.cumsum(new) - 1
    again = np.bincount(sorted_names)[sorted_names] > 1
    names, repeated = np.empty(len(a), np.int64), np.empty(len(a), bool)
    names[order], repeated[order] = sorted_names, again
    return names, repeated


def _stretch(x: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The largest [s, t) around `at` with x[i] == x[i + q] for all i in it."""
    t, step, last = at, 64, len(x) - q
    while t < last:
        stop = min(t + step, last)
        differ = x[t:stop] != x[t + q : stop + q]
        k = int(differ.argmax())
        if differ[k]:
            t += k
            break
        t, step = stop, 2 * step
    s, step = at, 64
    while s > 0:
        stop = max(s - step, 0)
        differ = (x[stop:s] != x[stop + q : s + q])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            s -= k
            break
        s, step = stop, 2 * step
    return s, t


def _has_smaller_period(x: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether the stretch, of period q and at least 2q words, repeats at a divisor of q."""
    rest, f = q, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            p = q // f
            # A period of one q is a period of the whole.
            if np.array_equal(x[start : start + q], x[start + p : start + q + p]):
                return True
            while rest % f == 0:
                rest //= f
        f += 1
    return False


def _near_lags(x: np.ndarray, least: int, below: int) -> list[tuple[int, int, int]]:
    """Runs of periods under `below`, by comparison at each lag."""
    found = []
    for q in range(1, min(below, len(x) // 2 + 1)):
        need = max(least, 2 * q) - q
        differ = np.flatnonzero(x[q:] != x[:-q])
        edges = np.concatenate(([-1], differ, [len(x) - q]))
        long = np.flatnonzero(np.diff(edges) > need)
        for s, t in zip((edges[long] + 1).tolist(), edges[long + 1].tolist(), strict=True):
            if not _has_smaller_period(x, s, t + q, q):
                found.append((s, t + q - s, q))
    return found


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :])


def _touching_seeds(x: np.ndarray, runs: list[tuple[int, int, int]], w: int) -> list[tuple[int, int]]:
    """(lag, place) for lags from w to below 2w over two touching runs of one period up to w/4."""
    small = sorted((p, s, s + n) for s, n, p in runs if 4 * p <= w and n >= w)
    seeds = []
    for (p, a1, b), (p2, a, e2) in zip(small, small[1:], strict=False):
        if p != p2 or a > b:
            continue
        # Where the letters of the left run's last period stand in the right one.
        wanted, room = x[b - p : b], x[a : a + 2 * p - 1]
        at = _find(room, wanted)
        if at < 0:
            continue
        shift = (a + at - (b - p)) % p
        first = w + (shift - w) % p
        for q in range(first, min(2 * w, b - a1 + 1, e2 - a + 1), p):
            lo, hi = max(a1, a - q), min(b, e2 - q)
            if hi - lo >= q:
                seeds.append((q, lo))
    return seeds


def _find(room: np.ndarray, wanted: np.ndarray) -> int:
    """The first place of `wanted` in `room`, -1 without."""
    data, part = room.tobytes(), wanted.tobytes()
    at = data.find(part)
    while at >= 0 and at % room.itemsize:
        at = data.find(part, at + 1)
    return at // room.itemsize if at >= 0 else -1


def find_runs(x: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in x of at least `least` entries and two periods.

    x may hold many texts with an entry between them that occurs nowhere else.
    """
    # Larger scales rest on all runs as long as the first grams, also on those too short to return.
    shown, least = least, min(least, FIRST_SCALE // 2)
    runs = _near_lags(x, least, FIRST_SCALE)
    g, names = 1, x
    w = FIRST_SCALE
    places = np.arange(len(x))
    while len(places):
        # From names of grams of g words to those of 2g, at places where they occur again.
        while 2 * g <= w // 2 and len(places):
            full = np.full(len(x) + g, -1, np.int64)
            full[places] = names
            right = full[places + g]
            both = right >= 0
            places = places[both]
            names, repeated = _pair_names(names[both], right[both])
            places, names = places[repeated], names[repeated]
            g *= 2
        if not len(places):
            break
        width = w - g + 1
        seeds = _touching_seeds(x, runs, w)
        if len(places) >= width:
            # Grams inside a run of a period up to g/2 have that period.
            inside = np.zeros(len(x) + 1, np.int32)
            for s, n, p in runs:
                if 2 * p <= g and n >= g:
                    inside[s] += 1
                    inside[s + n - g + 1] -= 1
            periodic = np.cumsum(inside)[places] > 0
            weight = (mix(names.astype(np.uint64)) >> np.uint64(33)).astype(np.int64)
            order = (weight << 32) | np.arange(len(places))
            order[periodic] = _NONE
            chosen = _sliding_least(order, width)
            chosen = np.unique(chosen[chosen != _NONE]) & 0xFFFFFFFF
            chosen.sort()
            at, name = places[chosen], names[chosen]
            by_name = np.lexsort((at, name))
            at, name = at[by_name], name[by_name]
            for k in range(1, NEXT_PLACES + 1):
                if k >= len(at):
                    break
                lag = at[k:] - at[:-k]
                good = (name[k:] == name[:-k]) & (lag >= w) & (lag < 2 * w)
                seeds.extend(zip(lag[good].tolist(), at[:-k][good].tolist(), strict=True))
        runs.extend(_extended(x, seeds, least))
        w *= 2
    return sorted((r for r in runs if r[1] >= shown), key=lambda r: (r[0], r[2]))


def _extended(x: np.ndarray, seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    found, lag, done = [], 0, 0
    for q, at in sorted(set(seeds)):
        if q == lag and at < done:
            continue
        s, t = _stretch(x, at, q)
        lag, done = q, max(t, at + 1)
        if t - s >= max(q, least - q) and not _has_smaller_period(x, s, t + q, q):
            found.append((s, t + q - s, q))
    return found


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        depth[s + q] += 1
        depth[s + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    """The words joined by one blank, in parts."""
    for k in range(0, len(starts), _AT_ONCE):
        s, e = starts[k : k + _AT_ONCE], ends[k : k + _AT_ONCE]
        width = e - s + 1
        behind = np.cumsum(width)
        at = np.arange(int(behind[-1])) + np.repeat(s - (behind - width), width)
        part = raw[np.minimum(at, len(raw) - 1)]
        part[behind - 1] = 32
        yield part[: None if k + _AT_ONCE < len(starts) else -1].tobytes()


def collapse_texts(
    texts: list[bytes], least: int, digest: bool
) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """Of each text its runs, and its kept words joined or their SHA-256."""
    data = b"".join(texts)
    raw = np.frombuffer(data, np.uint8)
    cuts = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    if len(raw):
        names, starts, ends = word_places(raw, cuts)
    else:
        names = starts = ends = np.zeros(0, np.int64)
    first = np.searchsorted(starts, cuts)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    # One entry that occurs nowhere else stands in front of each text, and no word has the name
    # of one of another text.
    x = np.empty(len(names) + len(texts), np.int64)
    at = np.arange(len(names)) + owner + 1
    x[first[:-1] + np.arange(len(texts))] = np.arange(len(texts))
    width = int(names.max()) + 1 if len(names) else 1
    x[at] = len(texts) + owner * width + names
    by_text: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    begin = first[:-1] + np.arange(len(texts)) + 1
    for s, length, q in find_runs(x, least):
        k = int(np.searchsorted(begin, s, "right")) - 1
        by_text[k].append((s - int(begin[k]), length, q))
    for k, runs in enumerate(by_text):
        s, e = starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]]
        if runs:
            keep = kept_words(len(s), runs)
            s, e = s[keep], e[keep]
        if digest:
            sha = hashlib.sha256()
            for part in _joined(raw, s, e):
                sha.update(part)
            yield runs, sha.hexdigest()
        else:
            yield runs, b"".join(_joined(raw, s, e)).decode("utf-8", "surrogatepass")


def collapse(docs: DataFrame, least: int = 12, digest: bool = False) -> DataFrame:
    """`docs` without text, with runs and collapsed.

    runs has (start, length, period) in words `[^\\x20\\x09-\\x0D]+` of the whole text, numbered
    from 0, of every run of at least `least` words and two periods, by start, then period.
    collapsed is the text without the words that any run holds after its first period, joined
    by one blank; with `digest` its SHA-256 in lower-case hex.

    Null and blank texts have no words and no runs; other columns may hold anything; columns
    named as the new ones (but for case) are left out; repeated rows count by themselves; an
    empty table gives an empty result. Each text is read whole by the task that reads its row:
    no shuffle, and memory in proportion to a batch or its one long text.
    """
    Scratch(docs.sparkSession)  # sets the size of batches
    others = [
        n for n in distinct_names(docs, "text", without=("runs", "collapsed")) if n != "text"
    ]
    chosen = pick(docs, *others, "text")
    runs_of = "array<struct<start:long,length:long,period:long>>"
    kinds = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triple = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
        for batch in batches:
            texts = [
                (t or "").encode("utf-8", "surrogatepass") for t in batch.column(len(others)).to_pylist()
            ]
            runs, collapsed = [], []
            for found, text in collapse_texts(texts, least, digest):
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                collapsed.append(text)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in range(len(others))),
                    pa.array(runs, pa.list_(triple)),
                    pa.array(collapsed, pa.string()),
                ],
                names=[*others, "runs", "collapsed"],
            )

    return chosen.mapInArrow(scan, ", ".join([*kinds, f"runs {runs_of}", "collapsed string"]))


def digests(collapsed: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of
    what `collapse` returned with its digest: the longest run, of such the one of the smallest
    start, then period (nulls without runs), and the digest of all runs as `start,length,period`
    and a line end each."""
    longest = F.array_max(
        F.transform(
            "runs",
            lambda r: F.struct(
                r["length"].alias("length"), (-r["start"]).alias("less"), (-r["period"]).alias("shorter")
            ),
        )
    )
    lines = F.array_join(
        F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))),
        "",
    )
    chosen = collapsed.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        longest.alias("longest"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    )
    length, period = F.col("longest.length"), -F.col("longest.shorter")
    return chosen.select(
        "doc_id",
        "n_runs",
        (-F.col("longest.less")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
