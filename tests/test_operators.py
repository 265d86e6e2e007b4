import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.config import load_config
from lodestone.operators import curate as C
from lodestone.operators import evaluate as E
from lodestone.operators import geo, integrity, merge
from lodestone.operators import rank as R


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) if columns else tuple(r)) for r in df.collect())


def frame(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


def protos(spark):
    train = frame(spark, [(1, [1.0, 0.0], 0), (2, [0.6, 0.8], 0), (3, [0.0, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    return R.prototypes(train, frame(spark, [(0,), (1,), (2,)], "class_idx int"))


def query(spark):
    return frame(spark, [(9, [3.0, 4.0]), (10, None)], "vec_id long, embedding array<double>")


def test_prototypes_and_top_k(spark):
    got = {r["class_idx"]: [round(x, 6) for x in r["proto"]] for r in protos(spark).collect()}
    assert got == {0: [0.894427, 0.447214], 1: [0.0, 1.0], 2: [0.0, 0.0]}
    top = R.top_k(query(spark), protos(spark), 5).select("query_id", "rank", "class_idx", F.round("sim", 4))
    assert rows(top) == [(9, 1, 0, 0.8944), (9, 2, 1, 0.8), (9, 3, 2, 0.0)]


def test_blocks_of_prototypes_agree(spark):
    one = rows(R.top_k(query(spark), protos(spark), 2), "class_idx", "rank")
    assert rows(R.top_k(query(spark), protos(spark), 2, block=1), "class_idx", "rank") == one


@pytest.mark.parametrize("boost,active,order,boosted,reported", [(0.05, True, [0, 1, 2], [], 0.8), (0.10, True, [1, 0, 2], [1], 0.8), (0.10, False, [0, 1, 2], [], 0.8)])
def test_geo_rerank(spark, boost, active, order, boosted, reported):
    scores = R.similarities(query(spark), protos(spark))
    hits = frame(spark, [(9, 1)], "query_id long, class_idx int")
    on = frame(spark, [(9,)] if active else [], "query_id long")
    got = R.geo_rerank(scores, hits, on, boost).orderBy("rank").collect()
    assert [r["class_idx"] for r in got] == order
    assert [r["class_idx"] for r in got if r["geo_boosted"]] == boosted
    assert round(next(r["sim"] for r in got if r["class_idx"] == 1), 4) == reported
    assert {r["geo_filtered"] for r in got} == {active}


def test_ties_go_to_the_least_class(spark):
    scores = frame(spark, [(1, 0, 0.5), (1, 1, 0.7), (1, 2, 0.7)], "query_id long, class_idx int, sim double")
    assert [r["class_idx"] for r in R.ranked(scores).orderBy("rank").collect()] == [1, 2, 0]
    assert rows(R.signals(scores), "top1", "max_sim", "top2_sim", "gap") == [(1, 0.7, 0.7, 0.0)]


def test_vectors_that_cannot_be_used_are_left_out(spark):
    train = frame(spark, [(1, [1.0, 0.0], 0), (2, None, 0), (3, [1.0, None], 0), (4, [], 0), (5, [0.0, 3.0], None)], "vec_id long, embedding array<double>, label int")
    assert rows(R.prototypes(train)) == [(0, [1.0, 0.0])]
    got = R.similarities(train, R.prototypes(train))
    assert rows(got) == [(1, 0, 1.0), (5, 0, 0.0)]
    assert R.prototypes(train.limit(0)).isEmpty() and R.similarities(train, R.prototypes(train.limit(0))).isEmpty()


def test_queries_stay_where_they_are(spark):
    plan = R.similarities(query(spark).repartition(3), protos(spark), top=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 1


def test_partial_sums_are_passed_on_when_many_are_held(spark, monkeypatch):
    data = [(k % 7, [float(k % 5 + 1), float(k % 3)]) for k in range(60)]
    df = frame(spark, data, "label int, embedding array<double>").repartition(2)
    one = {r["class_idx"]: [round(x, 9) for x in r["proto"]] for r in R.prototypes(df).collect()}
    monkeypatch.setattr(R, "_HELD", 3)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in data[i : i + 9]], pa.int32()), pa.array([v for _, v in data[i : i + 9]], pa.list_(pa.float64()))], ["class_idx", "v"]) for i in range(0, 60, 9)]
    parts = [row for b in R._partial_sums(iter(batches)) for row in b.to_pylist()]
    assert len(parts) > 7
    for c in range(7):
        total = sum(np.array(p["sums"]) for p in parts if p["class_idx"] == c)
        assert [round(x, 9) for x in total / np.linalg.norm(total)] == one[c]


def test_percentiles_are_numpy_s(spark):
    rng = np.random.default_rng(3)
    data = [("a", float(x)) for x in rng.integers(0, 9, 57)] + [("b", 2.0), ("c", None), (None, 1.0), (None, 4.0), ("b", float("nan"))]
    got = {r["g"]: r for r in E.percentiles(frame(spark, data, "g string, v double").repartition(5), "g", "v").collect()}
    for g in ("a", "b", None):
        values = [v for k, v in data if k == g and v == v]
        want = [len(values), np.mean(values), *np.percentile(values, [50, 5, 95])]
        assert [got[g][c] for c in ("n", "mean", "median", "p5", "p95")] == pytest.approx(want)
    assert got["c"]["n"] == 0 and got["c"]["median"] is None and len(got) == 4


def test_random_split_is_by_rank_of_hashes(spark):
    import hashlib

    keys = [f"k{i}" for i in range(50)]
    df = frame(spark, [(k, i) for i, k in enumerate(keys)], "key string, i int").repartition(7)
    val = {r["key"] for r in C.random_split(df, "key", 0.2, 9).where("split = 'val'").collect()}
    assert val == set(sorted(keys, key=lambda k: (hashlib.md5(f"{k}:9".encode()).hexdigest(), k))[:10])
    assert C.random_split(df.limit(0), "key", 0.2, 9).isEmpty()


def test_library_forms_of_the_joins(spark):
    a = frame(spark, [(1, 10, "x"), (2, None, "y"), (3, 30, "z")], "k int, id int, name string")
    b = frame(spark, [(7, 10, "q"), (6, None, "y"), (5, 99, "z"), (4, None, "x")], "m int, id int, name string")
    assert rows(C.id_else_name(a, b, ("k", "id", "name"), ("m", "id", "name"))) == [(1, 4), (2, 6), (3, None)]
    assert rows(C.backfilled(a, frame(spark, [(1, 5)], "k int, v int"), "k", "v", F.col("id")), "k", "v") == [(1, 5), (2, None), (3, 30)]
    assert rows(C.with_default(a, frame(spark, [(1, 5)], "k int, v int"), "k", "v", -1), "k", "v") == [(1, 5), (2, -1), (3, -1)]
    assert rows(C.shortfall(a.union(a.where("k = 1")), "k", 2, frame(spark, [(1,), (2,), (9,)], "k int"))) == [(2, 1), (9, 0)]
    seen = frame(spark, [("ok", True), ("ok", False), ("ok", None), ("corrupt", None)], "status string, has_exif boolean")
    assert rows(C.status_counts(seen)) == [("corrupt", 1), ("no_exif", 2), ("ok", 3)]


def test_geo_index(spark):
    seen = frame(spark, [("x", 42.27, -83.07), ("x", 42.9, -83.9), ("x", 10.1, 10.1), ("x", None, 5.0), ("e", 1.0, float("nan"))], "slug string, lat double, lon double")
    cells = geo.cell_counts(seen, minimum=2)
    assert rows(cells) == [("x", 42, -84, 2)]
    assert rows(geo.nested_index(cells, frame(spark, [("x",), ("e",)], "slug string"))) == [("e", []), ("x", [[42, -84]])]
    points = frame(spark, [(1, 43.0, -85.0), (2, 44.0, -84.0), (3, None, 1.0)], "id long, lat double, lon double")
    assert rows(geo.in_range(points, cells, "id")) == [(1, "x")]
    edge = frame(spark, [("y", 42, -180, 1)], "slug string, clat long, clon long, n long")
    assert geo.in_range(frame(spark, [(1, 42.5, 179.5)], "id long, lat double, lon double"), edge, "id").isEmpty()


def test_accuracy(spark):
    ranks = frame(spark, [("A", 1), ("A", 1), ("A", 2), ("A", 4), ("B", 1)], "label string, rank int")
    every = frame(spark, [("A",), ("B",), ("C",)], "class_idx string")
    per = E.class_accuracy(ranks, every)
    assert rows(per, "label", "n", "top1", "top3") == [("A", 4, 0.5, 0.75), ("B", 1, 1.0, 1.0), ("C", 0, None, None)]
    r = E.micro_macro(per).first()
    assert (r["micro_top1"], r["macro_top1"], r["classes"]) == (0.6, 0.75, 2)
    empty = E.micro_macro(E.class_accuracy(ranks.limit(0))).first()
    assert (empty["n"], empty["micro_top1"], empty["macro_top1"]) == (0, 0.0, 0.0)


def test_abstention_and_auc(spark):
    df = frame(spark, [(0.9, True), (0.5, True), (0.7, False), (0.2, False), (0.8, None), (0.1, None)], "max_sim double, correct boolean")
    r = E.abstention(df, 0.6).first().asDict()
    assert r == {"accuracy_before": 0.5, "correct_rejected": 0.5, "incorrect_rejected": 0.5, "accuracy_accepted": 0.5, "false_rejection": 0.5, "out_of_scope_accepted": 0.5}
    auc = E.auc(df.withColumn("known", F.col("correct").isNotNull())).first()["auc"]
    assert auc == pytest.approx((2 + 1 + 1 + 1) / 8)


def test_splits_and_caps(spark):
    split = C.every_nth_split(frame(spark, [(i,) for i in range(12)], "i int").repartition(3), "i")
    assert [r["i"] for r in split.where("split = 'val'").orderBy("i").collect()] == [0, 5, 10]
    shots = frame(spark, [("s1", "a", 1), ("s1", "b", 2), ("s1", "c", 3), ("s2", "d", 4), ("s2", "e", 5), ("s3", "f", 6)], "slug string, id string, n int")
    kept = C.exclude(shots, (frame(spark, [("d",), (None,)], "id string"), "id"))
    assert [r["id"] for r in C.diverse_sample(kept, "slug", "n", 2, 3).collect()] == ["a", "b", "e"]
    r1, r2 = (rows(C.random_split(shots, "id", 0.34, 1)) for _ in range(2))
    assert r1 == r2 and sum(r[-1] == "val" for r in r1) == 2
    half = shots.withColumn("split", F.when(F.col("n") < 3, "val"))
    assert rows(C.trusted_split(half, "id", 0.34, 1).groupBy("split").count()) == [("train", 4), ("val", 2)]
    whole = shots.withColumn("split", F.when(F.col("n") < 2, "val").otherwise("train"))
    assert C.trusted_split(whole, "id", 0.34, 1) is whole


def test_running_total_over_many_ranges(spark):
    rows_ = [(i * 7 % 501, i % 3) for i in range(501)]
    df = frame(spark, rows_, "i int, v int").repartition(7)
    got = {r["i"]: r["t"] for r in C.running_total(df, "i", F.col("v"), "t").collect()}
    total, want = 0, {}
    for i, v in sorted(rows_):
        want[i] = total
        total += v
    assert got == want


def test_pages_pins_and_requirements(spark, tmp_path):
    df = frame(spark, [(i,) for i in range(9)], "i int")
    assert [r["i"] for r in C.page(df, "i", 3, 2).collect()] == [3, 4]
    assert C.pinned(df, frame(spark, [(2,), (99,)], "i int"), "i").count() == 1
    with pytest.raises(ValueError, match="pinned"):
        C.pinned(df, frame(spark, [(99,)], "i int"), "i")
    integrity.require_paths(spark, f"file://{tmp_path}")
    with pytest.raises(ValueError, match="missing artifacts"):
        integrity.require_paths(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError, match="9 and 8"):
        integrity.require_same_size(df, df.where("i > 0"), "classes")
    (tmp_path / "c.json").write_text('{"a": 1, "b": {"c": 2}}')
    assert load_config(str(tmp_path / "c.json"), {"a": None, "b": 3}) == {"a": 1, "b": 3}


def test_clean_order(spark):
    df = frame(spark, [("p1", 9, 9, "h"), ("p2", 9, 9, "h"), ("p3", 1, 9, "g"), ("p4", 9, 9, "g"), ("p5", None, None, "z")], "path string, width int, height int, h string")
    assert [r[1] for r in rows(C.image_status(df, 5, "h", "path"), "path", "status")] == ["ok", "duplicate", "too_small", "ok", "corrupt"]


def test_lookups(spark):
    targets = frame(spark, [("ATTA texana",), ("Zed",)], "name string")
    taxa = frame(spark, [(1, 5, "Atta texana", "genus"), (2, 4, "atta TEXANA", "species"), (3, 9, "other", "species"), (4, 10, "ATTA texana", "species"), (5, 11, "ATTA texana", "species"), (6, 12, "ATTA texana", "genus")], "line int, taxon_id int, name string, rank string")
    assert rows(C.name_lookup(targets, taxa, "line")) == [("ATTA texana", 5), ("Zed", None)]
    assert rows(C.species_ids(targets, taxa)) == [("ATTA texana", 10), ("ATTA texana", 11)]
    hits = frame(spark, [("q", 1, "x", 7), ("q", 2, "Q", 8), ("r", 1, "y", 9)], "query string, position int, name string, taxon_id int")
    assert rows(C.resolve_taxon(frame(spark, [("q",), ("r",), ("s",)], "query string"), hits)) == [("q", 8), ("r", 9), ("s", None)]
    files = frame(spark, [("k", "png"), ("k", "jpg"), ("m", "gif")], "k string, ext string")
    assert rows(C.priority_pick(files, "k", "ext", ("jpg", "jpeg", "png"))) == [("k", "jpg")]
    meta = frame(spark, [("s", 1, "N1"), ("s", 2, "N2")], "slug string, i int, name string")
    assert [C.metadata_by_slug(meta, "i", last).first()["name"] for last in (True, False)] == ["N2", "N1"]
    path = frame(spark, [("48/47336/1",), ("147336",), ("47336",), (None,)], "a string")
    assert path.where(C.under_path(F.col("a"), 47336)).count() == 2


def test_upsert_and_insert_ignore(spark):
    old = frame(spark, [("s", 5, "X", None, "old name")], "slug string, taxon_id int, common string, class_idx int, name string")
    new = frame(spark, [("s", None, "Y", 3, "new name", 1), ("t", 1, None, 4, "T", 2)], "slug string, taxon_id int, common string, class_idx int, name string, ord int")
    out = merge.upsert(old, new, "slug", ("taxon_id", "common", "class_idx"), "ord")
    assert [tuple(r) for r in out.orderBy("slug").collect()] == [("s", 5, "Y", 3, "old name"), ("t", 1, None, 4, "T")]
    again = merge.upsert(out, new, "slug", ("taxon_id", "common", "class_idx"), "ord")
    assert [tuple(r) for r in again.orderBy("slug").collect()] == [tuple(r) for r in out.orderBy("slug").collect()]
    target = frame(spark, [("a", 0)], "path string, v int")
    batch = frame(spark, [("a", 1), ("b", 2), ("b", 3)], "path string, v int")
    assert rows(merge.insert_ignore(target, batch, "path", "v")) == [("b", 2)]


def test_integrity(spark):
    want = frame(spark, [("a",), ("b",), ("c",)], "k string")
    have = frame(spark, [("a",), ("c",), ("c",)], "k string")
    problems = integrity.exactly_one(want, have, "k")
    assert rows(problems) == [("b", "missing"), ("c", "ambiguous")]
    with pytest.raises(ValueError, match="2 problems"):
        integrity.require(problems, "benchmark")
    integrity.require(problems.limit(0), "benchmark")
    with pytest.raises(ValueError, match="missing columns"):
        integrity.require_columns(want, ("k", "z"))
    expected = frame(spark, [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "k string, h string")
    found = frame(spark, [("a", "1"), ("b", "9"), ("c", None)], "k string, h string")
    assert [r[1] for r in rows(integrity.restored(expected, found, "k", "h").na.fill("", ["error"]), "k", "error")] == ["", "hash_mismatch", "no_content", "not_found"]
    old = frame(spark, [(1, "a", None), (2, "b", "x")], "i int, n string, c string")
    new = frame(spark, [(1, "a", None), (2, "b", "y"), (3, "c", None)], "i int, n string, c string")
    assert rows(integrity.taxonomy_changes(old, new, "i", ("n", "c"))) == [(2, "c"), (3, "added")]
    assert not integrity.same_order(old, new, "n", "i") and integrity.same_order(old, old, "n", "i")
    assert rows(integrity.overlap(want, have, "k")) == [("k", 2)]
    asks = frame(spark, [(1, 1.0, None, None, b"x"), (2, 91.0, 1.0, None, b"x"), (3, None, None, "text/html", b"x"), (4, None, None, None, b""), (5, 1.0, 2.0, "image/png", b"x")], "i int, lat double, lon double, content_type string, content binary")
    assert rows(integrity.request_problems(asks), "i", "reason") == [(2, "out_of_bounds"), (3, "not_an_image"), (4, "empty")]
    assert rows(integrity.request_problems(asks.withColumn("w", F.when(F.col("i") != 5, 1)), "w"), "i", "reason")[-1] == (5, "undecodable")
    assert rows(integrity.only_pairs(asks.where("i in (1, 5)")), "i", "lat", "lon") == [(1, None, None), (5, 1.0, 2.0)]
    several = frame(spark, [("a", 1, None, "1"), ("b", 2, "u", "2"), ("c", 1, "u", "3")], "k string, n_files int, url string, h string")
    assert rows(integrity.restored(expected, several, "k", "h").na.fill("", ["error"]), "k", "error") == [("a", "no_photo"), ("b", "ambiguous"), ("c", ""), ("d", "not_found")]
    files = frame(spark, [("a", "JPG", "1"), ("b", "gif", "2"), ("c", "png", None), ("c", "jpg", "3")], "k string, extension string, h string")
    assert rows(integrity.file_problems(expected, files, ["k"], "h")) == [("b", "wrong_extension"), ("c", "ambiguous"), ("d", "missing")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 50)), min_size=1, max_size=30))
def test_first_per_key_is_idempotent(spark, data):
    df = frame(spark, data, "k int, v int")
    once = C.first_per_key(df, "k", "v")
    want = sorted({k: min(v for j, v in data if j == k) for k, _ in data}.items())
    assert rows(once) == want == rows(C.first_per_key(once, "k", "v"))
