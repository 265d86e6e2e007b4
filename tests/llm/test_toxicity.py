import math
import re

import numpy as np
import xxhash
from helpers import TEXTS, documents, no_documents
from pyspark.sql import functions as F

from lodestone.llm import queries, toxicity

DATA = "/root/testdata/sf0.1"


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_scores(chain, text):
    """Each label's probability by the definition, word for word."""
    words = set(WORD.findall("".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")))
    features = [*words, *(w[:5] + "*" for w in words if len(w) >= 5)]
    p = []
    for c in range(len(chain.names)):
        z = chain.bias[c] + sum(chain.weights[xxhash.xxh64(f.encode(), seed=42).intdigest() % 2**18, c] for f in features)
        z += sum(chain.links[c, k] * p[k] for k in range(c))
        p.append(1 / (1 + math.exp(-z)))
    return p


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    assert chain.names == ["quality", "toxic"] and (chain.weights != 0).sum() > 20_000
    scored = toxicity.score(docs, chain).join(labels.where("doc_id % 3 = 0"), "doc_id").select("toxic", "rejected").collect()
    toxic = [r["rejected"] for r in scored if r["toxic"]]
    clean = [r["rejected"] for r in scored if not r["toxic"]]
    assert len(toxic) > 100 and sum(toxic) / len(toxic) >= 0.85
    assert sum(clean) / len(clean) <= 0.005


def test_query_against_brute_force(spark):
    small = "/root/testdata/sf0.001"
    chain = queries.toxicity_chain(spark, small)
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, small).collect()}
    texts = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for i, t in texts:
        p = brute_scores(chain, t)
        assert np.allclose([got[i]["p_quality"], got[i]["p_toxic"]], p, atol=1e-12) and got[i]["rejected"] == (got[i]["p_toxic"] >= 0.2)
    assert any(r["rejected"] for r in got.values())


def rows_of(x):
    return toxicity.Rows([np.repeat(np.arange(x.shape[1]), r.astype(int)).astype(np.int32) for r in x], x.shape[1])


def test_the_fit_is_where_the_slope_is_zero():
    rng = np.random.default_rng(4)
    x, before = rng.integers(0, 3, (200, 7)), rng.random((200, 2))
    y = (rng.random(200) < toxicity._sigmoid(x @ rng.normal(size=7) - 1 + before[:, 0])).astype(float)
    w = toxicity.fit_linear(rows_of(x), before, y, 0.01)
    z = np.hstack([x, before])
    off = (toxicity._sigmoid(z @ w[:-1] + w[-1]) - y) / 200
    assert np.abs(z.T @ off + 0.01 * w[:-1]).max() < 5e-3 and abs(off.sum()) < 5e-3
    # an independent minimum: plain gradient steps
    v = np.zeros(10)
    for _ in range(20_000):
        off = (toxicity._sigmoid(z @ v[:-1] + v[-1]) - y) / 200
        v -= 0.1 * np.append(z.T @ off + 0.01 * v[:-1], off.sum())
    assert np.allclose(v, w, atol=0.05)


def test_rows_of_counts():
    x = np.array([[2, 0, 1], [0, 0, 0], [0, 3, 0]])
    rows = rows_of(x)
    assert rows.times(np.array([1.0, 10.0, 100.0])).tolist() == [102.0, 0.0, 30.0]
    assert rows.gathered(np.array([1.0, 5.0, 7.0])).tolist() == [2.0, 21.0, 1.0]
    some = rows.take(np.array([False, True, True]))
    assert some.times(np.array([1.0, 10.0, 100.0])).tolist() == [0.0, 30.0] and len(rows.take(np.zeros(3, bool))) == 0


def test_later_models_see_earlier_probabilities():
    rng = np.random.default_rng(0)
    x = (rng.random((600, 6)) < 0.3).astype(float)
    first = (x[:, 0] + x[:, 1] > 0).astype(float)
    second = first * (rng.random(600) < 0.9)
    chain = toxicity.fit_chain(rows_of(x), np.stack([first, second], axis=1), ["a", "b"], decay=1e-4)
    assert chain.links[1, 0] > 0.5 and chain.links[0].sum() == 0
    p = chain.probabilities(x @ chain.weights)
    by_hand = 1 / (1 + np.exp(-(x @ chain.weights[:, 1] + p[:, 0] * chain.links[1, 0] + chain.bias[1])))
    assert np.allclose(p[:, 1], by_hand) and ((p[:, 0] > 0.5) == first).mean() > 0.95


def fits(monkeypatch, x, **kw):
    seen = []
    real = toxicity.fit_linear

    def spy(rows, before, y, *rest):
        seen.append((len(rows), before.shape[1]))
        return real(rows, before, y, *rest)

    monkeypatch.setattr(toxicity, "fit_linear", spy)
    toxicity.fit_chain(rows_of(x), x[:, :2].copy(), ["a", "b"], folds=5, **kw)
    return seen


def test_out_of_fold_predictions_are_not_those_of_the_final_model(monkeypatch):
    x = (np.random.default_rng(1).random((50, 4)) < 0.5).astype(float)
    assert fits(monkeypatch, x) == [(50, 0), *[(40, 0)] * 5, (50, 1)]


def test_equal_texts_are_in_one_fold(monkeypatch):
    """Copies with the label of their twin: a model that has seen the twin would be too sure."""
    x = (np.random.default_rng(2).random((60, 5)) < 0.5).astype(float)
    groups = np.repeat(np.arange(20), 3)
    assert fits(monkeypatch, x[groups * 3], groups=groups) == [(60, 0), *[(48, 0)] * 5, (60, 1)]


def test_both_forms_of_the_features_agree(spark):
    """Training takes features in the JVM, scoring in Python."""
    texts = TEXTS + [(90, "K\u212aelvin \u0130stanbul ßtraße ÀÉ don't_stop foo-bar 12ab \x7f end")]
    rows = documents(spark, texts).where("text is not null").select("text", toxicity._places(F.col("text")).alias("p")).collect()
    assert len(rows) == len([t for _, t in texts if t is not None])
    for r in rows:
        words = toxicity._words(r["text"])
        assert sorted(r["p"]) == sorted([toxicity._place(w) for w in words] + [toxicity._place(w[:5] + "*") for w in words if len(w) >= 5])


def test_awkward_documents(spark):
    weights = np.zeros((toxicity.PLACES, 1))
    weights[toxicity._place("dog")] = 5.0
    chain = toxicity.Chain(["c"], weights, np.zeros((1, 1)), np.array([-2.0]))
    scored = toxicity.score(documents(spark), chain).collect()
    want = sorted(((i, "dog" in (t or "").lower()) for i, t in TEXTS), key=repr)
    assert sorted(((r["doc_id"], r["rejected"]) for r in scored), key=repr) == want
    kept = toxicity.keep_clean(documents(spark), chain)
    assert kept.columns == documents(spark).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(((i, t) for i, t in TEXTS if "dog" not in (t or "")), key=repr)
    assert toxicity.score(no_documents(spark), chain).collect() == []


def test_few_words_are_kept_by_a_worker():
    chain = toxicity.Chain(["c"], np.random.default_rng(3).random((toxicity.PLACES, 1)), np.zeros((1, 1)), np.zeros(1))
    whole, few = toxicity.Weights(chain), toxicity.Weights(chain, most=3, longest=4)
    for text in ("a bb ccc dddd eeeee ffffff", "", "a ffffff gg"):
        assert np.allclose(whole.linear(text), few.linear(text))
    assert len(few.known) == 3


def test_nothing_to_learn_from_rejects_nothing(spark):
    none = spark.createDataFrame([(1, 1, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(documents(spark), none)
    assert not any(r["rejected"] for r in toxicity.score(documents(spark), chain).collect())
