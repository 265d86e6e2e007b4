"""One text of some two million characters beside short ones, through every operator on texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import BPE, PIECES
from test_dedup import normal, slow_fingerprint
from test_scans import base_places, base_spans, joined
from test_tokens import CONTINUATION, INITIAL, greedy, library_ids

from lodestone.llm import exact_dedup, licenses, packing, pieces, runs, secrets, simhash, token_files, toxicity, wordpiece
from lodestone.llm.queries import license_digest, secret_digest


def long_text():
    rng = random.Random(11)
    words = ["stone", "river", "licença", "日本", "don't", "token=", "idiot", "deadbeefdeadbeef01", "mit license", "x" * 300]
    return " ".join(rng.choices(words, k=120_000)) + "\n" + "y" * 200_000


TEXT = long_text()
ROWS = [(1, TEXT, "en", "s", len(TEXT)), (2, "short", "en", "s", 5), (3, " " + TEXT, "de", "s", len(TEXT) + 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def of(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_tokens(spark, docs):
    ids = {i: np.array([*library_ids(t), 0], "<u4") for i, t, *_ in ROWS}
    root = token_files.write_token_files(docs, BPE)
    assert of(token_files.token_file_digests(spark, root), "n_tokens", "ids_crc32") == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in ids.items()}
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pack(docs, BPE).collect())
    assert got == sorted((i, k, a, n, zlib.crc32(x[a : a + n].tobytes())) for i, x in ids.items() for k, (a, n) in enumerate(packing.cut_points(len(x), 2048)))


def test_pieces(docs):
    counts = of(wordpiece.token_counts(docs, PIECES), "n_pieces")
    kinds = {}
    words = TEXT.encode().split()
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    assert counts[1] == (sum((greedy(w.decode(), INITIAL, CONTINUATION) or 1) * n for w, n in kinds.items() if len(w) < 1000) + sum(greedy_long(w.decode()) * n for w, n in kinds.items() if len(w) >= 1000),)
    assert {r["restored"] for r in pieces.encode(docs, PIECES, keep_ids=False).collect()} == {True}


def greedy_long(word):
    """As ``greedy``, looking no further than the longest piece."""
    longest = max(map(len, INITIAL | CONTINUATION))
    at, n = 0, 0
    while at < len(word):
        table = CONTINUATION if at else INITIAL
        end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in table), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_scans(docs):
    spans = base_spans(TEXT)
    assert of(secret_digest(secrets.find_secrets(docs)), "n_hex", "base_sha256")[1] == (sum(s[2] == "hex" for s in spans), hashlib.sha256(joined(spans).encode()).hexdigest())
    assert of(license_digest(licenses.scan_licenses(docs)), "n_words", "n_base", "first_word", "last_word", "base_labels")[1] == base_places(TEXT)


def test_duplicates(docs):
    assert of(exact_dedup.exact_duplicates(docs), "keep_id", "group_size", "digest")[1] == (3, 2, hashlib.sha256(normal(TEXT).encode()).hexdigest())
    assert of(simhash.near_duplicates(docs).withColumn("hex", simhash.fingerprint_hex()), "hex", "component_id")[3] == (format(slow_fingerprint(TEXT), "016x"), 1)


def test_toxicity(docs):
    weights = np.zeros((toxicity.PLACES, 1))
    weights[toxicity._place("idiot")] = 5.0
    chain = toxicity.Chain(["c"], weights, np.zeros((1, 1)), np.array([-2.0]))
    assert of(toxicity.score(docs, chain), "rejected") == {1: (True,), 2: (False,), 3: (True,)}


def test_periodic_runs(docs):
    """In words at random only short periods repeat four times; each is searched on its own."""
    words, want = TEXT.split(), {}
    for p in range(1, 20):
        at = 0
        while at + p < len(words):
            end = at
            while end + p < len(words) and words[end] == words[end + p]:
                end += 1
            if end > at and end + p - at >= max(6, 4 * p):
                want.setdefault((at, end + p - at), p)
            at = max(end, at) + 1
    got = of(runs.periodic_runs(docs), "n_words", "runs", "collapsed")
    assert [tuple(r) for r in got[1][1]] == sorted((s, n, p) for (s, n), p in want.items()) and len(want) > 5
    gone = {k for (s, n), p in want.items() for k in range(s + p, s + n)}
    assert got[1][0] == len(words) and got[1][2] == " ".join(w for k, w in enumerate(words) if k not in gone)
    assert got[2] == (1, [], "short")
