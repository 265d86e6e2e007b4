"""Collision-counting search against all inner products."""

import numpy as np
import pytest

from lodestone.llm import collisions, queries

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k, ask=lambda i: True):
    """{(query id, vector): [(id, score)]}; rows that repeat an id and a vector are one."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good:
        if ask(q):
            near = [(-float(np.dot(v, w)), i) for i, w in good if i != q and len(w) == len(v)]
            out[q, v] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def recall(got, true):
    hit = total = 0
    for (q, _), near in true.items():
        least = near[-1][1] if near else 0.0
        total += len(near)
        hit += sum(s >= least - 1e-9 for _, _, s in got.get(q, []))
    return hit / max(total, 1)


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    x = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in rows}
    true = brute([(i, v.tolist()) for i, v in x.items()], 20, lambda i: i % 20 == 0)
    df = queries.op11_nearest_neighbours(spark, "/root/testdata/sf0.01")
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got = found(df)
    assert set(got) == {q for q, _ in true} and recall(got, true) >= 0.95
    for q, near in got.items():
        assert [r for r, _, _ in near] == list(range(1, 21)) and len({i for _, i, _ in near}) == 20
        assert [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near)
        assert all(i != q and abs(s - x[q] @ x[i]) < 1e-12 for _, i, s in near)


@pytest.mark.parametrize("width,spread", [(3, 0.0), (16, 0.0), (64, 1.0), (300, 0.5)])
def test_recall_over_many_cells(spark, width, spread):
    """With several cells and chunks, and norms that differ by ``spread`` powers of e."""
    rng = np.random.default_rng(width)
    x = rng.standard_normal((1500, width)) * np.exp(spread * rng.standard_normal((1500, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    index = collisions.build_index(df, k=10, chunk=400 * width)
    assert len(index.centres[width]) == 8 and index.classes.count() == 1500
    got = found(collisions.search(index, df.where("vec_id % 20 = 0")))
    true = brute(rows, 10, lambda i: i % 20 == 0)
    assert recall(got, true) >= 0.93


def test_a_hot_cluster_is_cut_into_chunks_and_parts(spark, monkeypatch):
    """A third of the rows is one vector, a third nearly another."""
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, 8))
    rows = [(i, a.tolist()) for i in range(300)] + [(i, (b + 1e-3 * rng.standard_normal(8)).tolist()) for i in range(300, 600)] + [(i, rng.standard_normal(8).tolist()) for i in range(600, 900)]
    monkeypatch.setattr(collisions, "TOGETHER", 7)
    monkeypatch.setattr(collisions, "MOST_CELLS", 2)
    df = spark.createDataFrame(rows, SCHEMA)
    index = collisions.build_index(df, k=5, chunk=8 * 40)
    assert index.members.count() == 606 and index.chunks.agg({"chunks": "max"}).first()[0] > 1
    got = found(collisions.search(index, df.where("vec_id % 10 = 0")))
    true = brute(rows, 5, lambda i: i % 10 == 0)
    assert len(got) == 90 and recall(got, true) >= 0.95
    assert [i for _, i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for _, i, _ in got[10]] == [0, 1, 2, 3, 4]


def test_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [-1.0, -0.0]), (11, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (12, [1.0, 5.0]), (12, [2.0, 1.0]), (13, [1e-300, 0.0]), (14, [5.0])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA + ", qid string, cid int, rank int")
    got = found(collisions.search(collisions.build_index(df, k=3), df))
    assert set(got) == {1, 2, 9, 10, 12, 13}
    assert got[1] == [(1, 12, 2.0), (2, 9, 1.0), (3, 12, 1.0)]
    assert got[10] == [(1, 2, 0.0), (2, 13, -1e-300), (3, 1, -1.0)]
    assert [i for _, i, _ in got[2]] == [12, 12, 1]


def test_empty_and_small(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(20, [1.0, 2.0]), (21, [2.0, 1.0])], SCHEMA)
    index = collisions.build_index(none, k=4)
    assert collisions.search(index, some).count() == 0
    index = collisions.build_index(some, k=4)
    assert collisions.search(index, none).count() == 0
    assert found(collisions.search(index, some.where("vec_id = 20"))) == {20: [(1, 21, 4.0)]}
    with pytest.raises(ValueError):
        collisions.search(index, some, k=5)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, float(i % 7), 0.0]) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(collisions.search(collisions.build_index(df, k=20, chunk=3 * 8), spark.createDataFrame([(1000, [1.0, 0.0, 0.0])], SCHEMA)))
    assert [(i, s) for _, i, s in got[1000]] == [(i, 1.0) for i in range(20)]


def test_narrow_queries_of_a_wide_index_keep_their_precision(spark):
    index = collisions.build_index(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>"), k=1)
    got = found(collisions.search(index, spark.createDataFrame([(2, [0.1, 0.2])], SCHEMA)))
    assert got == {2: [(1, 1, 0.1 + 0.4)]}
