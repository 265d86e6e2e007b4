"""Periodic runs against a search of every start and period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import queries, runs

from helpers import TEXTS, documents, no_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, exponent=4):
    """(start, length, period) of every run by its definition."""
    out = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if j > i and len(stretch) >= max(least, exponent * q) and not any(stretch[k:] == stretch[:-k] for k in range(1, q)):
                out.append((i, len(stretch), q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(i, text):
    words = WORD.findall(text or "")
    h = None if i is None else zlib.crc32(str(i).encode())
    if words and h is not None and h % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    return words


def digest(i, text):
    words = planted(i, text)
    found = brute(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(found), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def query_rows(df):
    return sorted(map(tuple, queries.run_digest(runs.periodic_runs(runs.with_planted_runs(df))).collect()), key=repr)


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == sorted((digest(i, t) for i, t in rows), key=repr)
    assert sum(r[1] for r in got) > 5


def test_awkward_documents(spark):
    texts = TEXTS + [
        (20, "a b " * 3), (21, "a " * 6), (22, "a " * 5), (23, "x a b c a b c a b c a b c y"), (24, "a b a b a b a b a\x1ca\x85b"),
        (30, "one two three four five six seven eight nine ten eleven twelve"), (40, "z " * 2000 + "q " + "z z y " * 500), (41, "é 日本 " * 9),
    ]
    df = documents(spark, texts)
    assert query_rows(df) == sorted((digest(i, t) for i, t in texts), key=repr)
    assert query_rows(no_documents(spark)) == []


def test_planted_documents(spark):
    rng = random.Random(5)
    texts = [(k, " ".join(rng.choice("ab cd efg h ij".split()) for _ in range(rng.randint(0, 90)))) for k in range(400)]
    assert query_rows(documents(spark, texts)) == sorted((digest(i, t) for i, t in texts), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(0, 2), max_size=60), st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9)).map(lambda t: t[0] * t[1])), max_size=6))
def test_batches(documents):
    arrays = [np.array(d, np.int64) for d in documents]
    assert runs.runs_of(arrays) == [brute(d) for d in documents]
    assert runs.runs_of(arrays, 3, 3) == [brute(d, 3, 3) for d in documents]


def test_colliding_hashes(monkeypatch):
    """Were every hash the same, the words themselves would decide."""
    monkeypatch.setattr(runs, "_hashes", lambda words: (np.zeros(len(words) + 1, np.uint64), np.ones(len(words) + 1, np.uint64)))
    rng = random.Random(2)
    docs = [[rng.randint(0, 1) for _ in range(rng.randint(0, 40))] for _ in range(60)] + [[1, 2] * 30]
    assert runs.runs_of([np.array(d, np.int64) for d in docs]) == [brute(d) for d in docs]


def test_a_long_document():
    words = np.concatenate([np.arange(50_000), np.tile(np.arange(700), 60), np.zeros(30_000, np.int64)])
    # the last 700 block ends before the zeros, whose first word also goes on with it
    assert runs.runs_of([words]) == [[(50_000, 42_001, 700), (92_000, 30_000, 1)]]


def test_small_exponents_are_refused(spark):
    with pytest.raises(ValueError):
        runs.periodic_runs(no_documents(spark), min_exponent=2)
