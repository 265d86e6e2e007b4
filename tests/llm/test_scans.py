import hashlib
import re
import string

from helpers import TEXTS, documents, no_documents, rows
from pyspark.sql import functions as F

from lodestone.llm import licenses, secrets
from lodestone.llm.queries import license_digest, secret_digest

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
KINDS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def base_spans(text):
    return sorted((m.start(), k, name, m.end()) for k, (name, rx, fine) in enumerate(KINDS) for m in rx.finditer(text or "") if fine(m))


def joined(spans):
    return ",".join(f"{name}:{a}:{b}" for a, _, name, b in spans)


MARKS = TEXTS + [(50, f"{chr(0xE000)}token{chr(0xE001)} token=abcdefabcdefabcdef12 {chr(0xE000)}"), (51, "\U0001f600 secret: 'zzzzyyyyxxxx' tokentoken=abc.def/ghi+jkl")]


def test_secret_spans(spark):
    found = secret_digest(secrets.find_secrets(documents(spark, MARKS)))
    got = {(r["doc_id"], r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in found.collect()}
    want = set()
    for i, t in MARKS:
        spans = base_spans(t)
        want.add((i, hashlib.sha256(joined(spans).encode()).hexdigest(), *(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex"))))
    assert got == want and found.count() == len(MARKS)
    assert secrets.find_secrets(no_documents(spark)).collect() == []


def test_ownership_separates_examples_from_credentials(spark):
    copied, own = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "9c1d2e3f4a5b60718293a4b5c6d7e8f90a1b2c3d"
    mixed = "Zk3vQ9xLr7TmB2nWc5Yd8HsJ"
    texts = [(k, f'use token = "{copied}" here', "en", f"s{k}", 1) for k in range(6)]
    texts += [(10, f'token = "{own}"', "en", "s1", 1), (11, f'token = "{own}"', "fr", "s1", 1), (12, f"key {mixed} end", "en", "s2", 1), (13, "token=exampleexample1", "en", "s9", 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    spans = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs).collect()}
    assert {(s["n_owners"], s["n_repos"], s["live"]) for k in range(6) for s in spans[k]} == {(6, 6, False)}
    assert {(s["n_owners"], s["n_repos"], s["live"]) for k in (10, 11) for s in spans[k]} == {(1, 2, True)}
    assert [(s["kind"], s["start"], s["end"]) for s in spans[12]] == [("owned", 4, 4 + len(mixed))]
    assert [s["live"] for s in spans[13]] == [False]
    spread = spark.createDataFrame([(k, f'token = "{own}"', lang, "s1", 1) for k, lang in enumerate(("de", "en", "es", "fr"))], docs.schema)
    seen = [s for r in secrets.find_secrets(spread).collect() for s in r["spans"]]
    assert {(s["n_owners"], s["n_repos"], s["live"]) for s in seen} == {(1, 4, False)}
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_live(docs).collect()}
    assert masked[0] == texts[0][1] and masked[13] == texts[9][1]
    assert masked[12] == f"key {'*' * len(mixed)} end" and own not in masked[10] and len(masked[10]) == len(texts[6][1])


def test_a_text_of_100_000_matches(spark):
    values = [hashlib.md5(str(k).encode()).hexdigest() for k in range(100_000)]
    text = "é ".join(values)
    docs = spark.createDataFrame([(1, text, "en", "s1", 1), (2, "x", "en", "s1", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r = secret_digest(secrets.find_secrets(docs)).where("doc_id = 1").first()
    assert r["n_hex"] == 100_000 and r["base_sha256"] == hashlib.sha256(joined(base_spans(text)).encode()).hexdigest()
    assert secrets.mask_live(docs).where("doc_id = 1").first()["text"] == "é ".join("*" * 32 for _ in values)


def test_overlapping_spans_are_masked_once(spark):
    spans = [(0, 3), (2, 5), (2, 4), (7, 8), (7, 8)] + [(10 + 3 * k, 12 + 3 * k) for k in range(600)]
    text = "".join(chr(0x61 + k % 26) for k in range(1900)) + "é日\U0001f600"
    df = spark.createDataFrame([(text, spans), (text, [])], "t string, s array<struct<start:int,end:int>>")
    got = [r[0] for r in df.select(secrets._masked(F.col("t"), F.col("s"))).collect()]
    hidden = {i for a, b in spans for i in range(a, b)}
    assert got == ["".join("*" if i in hidden else c for i, c in enumerate(text)), text]


def test_masking_keeps_rows_and_columns(spark):
    docs = documents(spark)
    out = secrets.mask_live(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {(r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] in (1, 3, 4, 7)} == {(i, t) for i, t in TEXTS if i in (1, 3, 4, 7)}
    assert secrets.mask_live(no_documents(spark)).collect() == []


def base_places(text):
    words = licenses.words_of(text or "")
    starts, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


LICENSED = TEXTS + [
    (60, "MIT LICENSE mit license" + " mit license" * 3),
    (61, "license"),
    (62, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (63, "A MİT License, éMIT license and the mit licenses"),
    (64, "permission granted hereby free person charge " * 5),
]


def test_base_places(spark):
    out = license_digest(licenses.scan_licenses(documents(spark, LICENSED)))
    got = rows(out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    assert got == sorted(((i, *base_places(t)) for i, t in LICENSED), key=repr)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in out.collect())
    assert license_digest(licenses.scan_licenses(no_documents(spark))).collect() == []


def test_positional_index(spark):
    out = {r["doc_id"]: r["labels"] for r in license_digest(licenses.scan_licenses(documents(spark, LICENSED))).collect()}
    assert out[13] == "apache,apache-2.0" and out[16] == "cc-by-nc" and out[62] == "mit-text"
    assert out[64] == "" and out[61] == "" and "mit-notice" in out[9]
