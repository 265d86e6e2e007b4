"""Periodic runs of words: stretches in which a short sequence of words repeats, found on a harmonic grid."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ship, text_or_empty

#: A run has this many words or more, and this many times its period.
MIN_WORDS, MIN_EXPONENT = 6, 4
#: Words that are searched together; a longer document is searched alone.
TOGETHER = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:long,length:long,period:long>>"


def _hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, power): ``prefix[i]`` hashes the words before i, modulo 2^64."""
    x = words.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    power = np.ones(len(words) + 1, np.uint64)
    power[1:] = _BASE
    np.cumprod(power, out=power)
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(x * power[:-1], out=prefix[1:])
    return prefix, power


def _grid(words: np.ndarray, ends: np.ndarray, lengths: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(period, grid point) pairs whose words agree: points are the multiples of each period.

    Documents come longest first, so those that are long enough for a period are a prefix.
    """
    periods, points = [], []
    for p in range(1, int(lengths[0]) // exponent + 1):
        fit = np.searchsorted(-lengths, -p * exponent, side="right")
        at = words[: ends[fit - 1] + 1 : p]
        same = np.flatnonzero(at[:-1] == at[1:])
        if len(same):
            periods.append(np.full(len(same), p))
            points.append(same * p)
    if not periods:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(periods), np.concatenate(points)


def _candidates(words: np.ndarray, ends: np.ndarray, lengths: np.ndarray, min_words: int, exponent: int) -> np.ndarray:
    """Rows (start, end, period), one a stretch: the smallest period that fits it by hash."""
    p, i = _grid(words, ends, lengths, exponent)
    prefix, power = _hashes(words)

    def same(a: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (prefix[a + n] - prefix[a]) * power[p] == prefix[a + p + n] - prefix[a + p]

    # a run holds two whole cells of its period's grid at least, each equal to the next; one pair a run is enough
    inside = i + 2 * p <= len(words)
    p, i = p[inside], i[inside]
    whole = same(i, p, p)
    p, i = p[whole], i[whole]
    again = np.zeros(len(p), bool)
    again[1:] = (p[1:] == p[:-1]) & (i[1:] - i[:-1] == p[1:])
    p, i = p[~again], i[~again]
    right, left = p.copy(), np.zeros(len(p), np.int64)
    step = 1 << int(lengths[0]).bit_length()
    while step:  # the longest common extensions of all pairs, a binary digit at a time
        n = np.full(len(p), step)
        fits = i + p + right + step <= len(words)
        fits[fits] = same((i + right)[fits], n[fits], p[fits])
        right += fits * step
        fits = i - left - step >= 0
        fits[fits] = same((i - left - step)[fits], n[fits], p[fits])
        left += fits * step
        step >>= 1
    found = np.stack([i - left, i + p + right, p], axis=1)
    long = found[:, 1] - found[:, 0] >= np.maximum(min_words, exponent * p)
    found = found[long]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    # a stretch with several periods has their common divisor as a period too, and that one is among these
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[first]


def _verified(words: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which rows are runs by their very words."""
    ok = np.ones(len(found), bool)
    for k, (s, e, p) in enumerate(found):
        ok[k] = s > 0 and e < len(words) and np.array_equal(words[s : e - p], words[s + p : e]) and words[s - 1] != words[s + p - 1] and words[e] != words[e - p]
    return ok


def _plainly(words: np.ndarray, min_words: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of one document's runs without hashes, for documents whose hashes collide."""
    least: dict[tuple[int, int], int] = {}
    for p in range(1, len(words) // exponent + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], words[:-p] == words[p:], [False]]).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2]):
            if b + p - a >= max(min_words, exponent * p):
                least.setdefault((int(a), int(b + p)), p)
    return [(s, e, p) for (s, e), p in least.items()]


def runs_of(documents: list[np.ndarray], min_words: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """For each document (words as numbers from 0) its runs (start, length, period) by start, then period.

    All documents are searched at once, longest first, with a word of its own after each.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    order = sorted((k for k in range(len(documents)) if len(documents[k]) >= max(min_words, exponent)), key=lambda k: -len(documents[k]))
    if not order:
        return out
    lengths = np.array([len(documents[k]) for k in order])
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths
    words = np.empty(int(ends[-1]) + 1, np.int64)
    words[0] = -1
    for n, (k, a, b) in enumerate(zip(order, starts, ends)):
        words[a:b] = documents[k]
        words[b] = -2 - n
    found = _candidates(words, ends, lengths, min_words, exponent)
    at = np.searchsorted(starts, found[:, 0], side="right") - 1
    # a stretch that hashes drew out wrongly may hide runs of every document it touches
    untrue = found[~_verified(words, found)]
    last = np.searchsorted(starts, untrue[:, 1] - 1, side="right") - 1
    wrong = {n for a, b in zip(np.searchsorted(starts, untrue[:, 0], side="right") - 1, last) for n in range(max(int(a), 0), int(b) + 1)}
    for (s, e, p), n in zip(found.tolist(), at.tolist()):
        if n not in wrong:
            out[order[n]].append((s - int(starts[n]), e - s, p))
    for n in wrong:
        out[order[n]] = [(s, e - s, p) for s, e, p in _plainly(np.asarray(documents[order[n]]), min_words, exponent)]
    for n in range(len(out)):
        out[n].sort(key=lambda r: (r[0], r[2]))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but for those after a run's first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        change[s + p] += 1
        change[s + n] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def _search(min_words: int, exponent: int):
    def flush(ids: list, words: list[list[bytes]]):
        numbers = defaultdict(count().__next__)
        found = runs_of([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words], min_words, exponent)
        kinds = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(kinds)))
        texts = pa.array([_collapsed(w, r) for w, r in zip(words, found)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), runs, texts], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches):
        for batch in batches:
            ids, words, n = [], [], 0
            # bytes.split() parts at exactly the contract's white space
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                own = text.as_py().split()
                if ids and n + len(own) > TOGETHER:
                    yield flush(ids, words)
                    ids, words, n = [], [], 0
                ids.append(i)
                words.append(own)
                n += len(own)
            if ids:
                yield flush(ids, words)

    return run


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, runs (start, length, period), collapsed.

    Words are what lies between ASCII white space, numbered from 0.  A run is a longest stretch whose
    smallest period is ``period``, with ``min_words`` words and ``min_exponent`` (3 or more) periods
    at least; runs come by start, then period.  ``collapsed`` is the text with one period of each run,
    its words joined by single spaces.

    For every period all multiples of it are grid points, n log n pairs in all.  Pairs whose words and
    whole cells agree are extended both ways at once by binary search over prefix hashes; the words of
    each stretch are then compared, and a document in which hashes collided is searched without
    them.  Documents stay in their tasks; a batch of them is searched together.

    Null and empty texts have no words and no runs.  Rows are documents: repeated rows and null ids
    give their rows.  Other columns are ignored; an empty table gives no rows.
    """
    if min_exponent < 3:
        raise ValueError("min_exponent must be 3 or more")
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_search(min_words, min_exponent), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text``, where every tenth document by hash ends in a repeated sequence of its words.

    With h the CRC-32 of the decimal id and g = floor(h / 10), documents with h % 10 = 0 repeat
    from word a = g % n on with period 1 + floor((n - a) / (3 + g % 8)).  Null ids have no hash.
    """
    words = F.filter(F.split(text_or_empty(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) / 10)

    def repeated(ws):
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, a + (i - a) % p)))

    # the lambda's argument stands for the words, so they are split once and not once a word
    planted = F.array_join(F.get(F.transform(F.array(words), repeated), F.lit(0)), " ")
    mine = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 10 == 0
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(mine & F.exists(words, lambda w: w.isNotNull()), planted).otherwise(text).alias("text"))
