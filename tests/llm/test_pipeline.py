from collections import Counter

import corpus_pipeline
import numpy as np
from test_dedup import components, normal, slow_fingerprint
from test_tokens import check_packed, library_ids
from test_toxicity import brute_scores

from lodestone.llm import packing, toxicity
from lodestone.llm.common import stored
from lodestone.llm.queries import toxicity_chain

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    start = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA), "test-stage")
        found.append(docs)
        if name != "best-fit packing":
            assert docs.columns == columns
    clean, exact, near, masked = ({r["doc_id"]: r["text"] or "" for r in df.collect()} for df in found[:4])
    chain = toxicity_chain(spark, DATA)
    assert clean == {i: t for i, t in start.items() if brute_scores(chain, t)[-1] < toxicity.THRESHOLD}
    assert 0 < len(start) - len(clean) < len(start) / 4
    groups = {}
    for i, t in clean.items():
        groups.setdefault(normal(t), []).append((-len(t), i))
    assert set(exact) == {min(g)[1] for g in groups.values()}
    prints = {i: slow_fingerprint(t) for i, t in exact.items()}
    ids = sorted(prints)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if bin(prints[a] ^ prints[b]).count("1") <= 3]
    assert set(near) == set(components(ids, linked).values())
    assert masked.keys() == near.keys() and all(len(t) == len(near[i]) and all(a in (b, "*") for a, b in zip(t, near[i])) for i, t in masked.items())
    assert any(t != near[i] for i, t in masked.items())
    placed = found[4].collect()
    want = Counter()
    for i, t in masked.items():
        n = len(library_ids(t)) + 1
        want.update((i, k, a, m) for k, (a, m) in enumerate(packing.cut_points(n, 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in placed) == want
    assert check_packed(placed, 2048) <= -(-int(np.sum([r["length"] for r in placed])) // 2048) + 1


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns[:3] == ["doc_id", "piece", "start"] and out.count() > 0
