"""Mechanisms for large tables: what they read, write and shuffle, beside what they give."""

import json
import os
import subprocess
import sys
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import curate as C
from lodestone.operators import rank as R
from lodestone.sources import readers, sinks
from lodestone.sources.keyed import Conflict, KeyedTable

ROW = "id long, name string, idx int"
DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def keyed(spark, path, n=200):
    return KeyedTable.create(spark.createDataFrame([(i, f"n{i}", i if i % 2 else None) for i in range(n)], ROW), f"file://{path}/t", "id", 16)


def folders(table):
    return {b: f for b, some in table.manifest["folders"].items() for f in [tuple(some)]}


def test_an_upsert_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    t = keyed(spark, tmp_path)
    incoming = spark.createDataFrame([(4, "no", 44, 1), (4, "no", None, 2), (1000, "new", None, 1), (None, "x", 1, 1)], ROW + ", ord int")
    u = t.upsert(incoming, ("idx",), "ord")
    assert rows(u.read().where("id in (3, 4, 1000)")) == [(1000, "new", None), (3, "n3", 3), (4, "n4", 44)] and u.read().count() == 201
    changed = {b for b in folders(u) if folders(u)[b] != folders(t).get(b)}
    assert changed == set(u.touched(incoming)) and len(changed) <= 2 and len(folders(t)) == 16
    # the old version is still there for who has it open
    assert t.read().count() == 200 and rows(t.read().where("id = 4")) == [(4, "n4", None)]


def test_an_insert_appends_to_buckets(spark, tmp_path):
    t = keyed(spark, tmp_path)
    more = spark.createDataFrame([(5, "known", 1), (300, "b", 1), (300, "a", 2)], ROW)
    u = t.insert_ignore(more, "name")
    assert rows(u.read().where("id in (5, 300)")) == [(300, "a", 2), (5, "n5", 5)]
    assert [f for b, f in folders(u).items() if len(f) == 2] != [] and all(folders(t)[b][0] == f[0] for b, f in folders(u).items())
    assert u.insert_ignore(more, "name").version == u.version  # nothing new, no new version
    # rows of both files of a bucket are seen by the next upsert
    v = u.upsert(spark.createDataFrame([(300, "z", 9, 1)], ROW + ", ord int"), ("idx",), "ord")
    assert rows(v.read().where("id = 300")) == [(300, "a", 9)] and v.read().count() == 201


def test_a_failed_or_second_writer_leaves_the_table(spark, tmp_path):
    t = keyed(spark, tmp_path)
    broken = spark.createDataFrame([(4, "no", 44, 1)], ROW + ", ord int").withColumn("idx", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        t.upsert(broken, ("idx",), "ord")
    assert KeyedTable(spark, t.path).version == 1 and KeyedTable(spark, t.path).read().count() == 200
    other = KeyedTable(spark, t.path)
    one = spark.createDataFrame([(4, "no", 1, 1)], ROW + ", ord int")
    t.upsert(one, ("idx",), "ord")
    with pytest.raises(Conflict):
        other.upsert(one.withColumn("idx", F.lit(2)), ("idx",), "ord")
    now = KeyedTable(spark, t.path)
    assert now.version == 2 and rows(now.read().where("id = 4")) == [(4, "n4", 1)]
    assert now.vacuum(keep=1) > 0 and KeyedTable(spark, t.path).read().count() == 200
    assert sorted(os.listdir(tmp_path / "t/manifests")) == ["000000000002.json"] or {n for n in os.listdir(tmp_path / "t/manifests") if not n.startswith(".")} == {"000000000002.json"}
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, f"file://{tmp_path}/none")


def test_an_empty_keyed_table(spark, tmp_path):
    t = KeyedTable.create(spark.createDataFrame([], ROW), f"file://{tmp_path}/t", "id", 4)
    assert t.read().count() == 0 and t.upsert(spark.createDataFrame([], ROW + ", ord int"), ("idx",), "ord").version == 1
    u = t.insert_ignore(spark.createDataFrame([(1, "a", 1)], ROW), "name")
    assert rows(u.read()) == [(1, "a", 1)] and u.read().schema.simpleString() == "struct<id:bigint,name:string,idx:int>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_photos_without_a_kept_observation_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        photos = spark.range(100_000).select(F.col("id").alias("photo"), (F.col("id") % 20_000).alias("obs")).union(spark.createDataFrame([(-1, None)], "photo long, obs long"))
        kept = spark.range(0, 20_000, 100).withColumnRenamed("id", "uuid")
        df = C.photos_of_kept(photos, kept, "obs", "uuid")
        before = plan_of(df)
        # the filter lies below the exchange of photos
        sides = before[before.index("SortMergeJoin") :]
        assert "__lodestone_row" in sides and sides.count("Exchange hashpartitioning(obs") == 1
        assert sides.index("Exchange hashpartitioning(obs") < sides.index("getbit")
        assert rows(df.select("photo", "obs", "uuid")) == rows(C.photos_of(photos, kept, "obs", "uuid").select("photo", "obs", "uuid"))
        flagged = C.with_membership(photos, C._hash("obs"), C.membership(kept.select(C._hash("uuid").alias("h")), "h"), "f")
        assert 1000 <= flagged.where("f").count() <= 100_000 / 16 + 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = sinks.by_key(spark.range(1000).select((F.col("id") % 300).alias("k"), "id"), "bucketed_a", f"{tmp_path}/a", "k", 6)
        b = sinks.by_key(spark.range(300).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice")), "bucketed_b", f"{tmp_path}/b", "key", 6)
        df = C.photos_of(a, b, "k", "key")
        assert "Exchange" not in plan_of(df) and df.count() == 1000
        assert "Exchange" not in plan_of(a.groupBy("k").count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table bucketed_a")
        spark.sql("drop table bucketed_b")


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1000])
def test_shuffled_positions_are_a_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(readers.shuffled_position(F.col("id"), n, 5).alias("p"), "id").orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    if n == 1000:
        other = [r[0] for r in spark.range(n).select(readers.shuffled_position(F.col("id"), n, 6).alias("p"), "id").orderBy("id").collect()]
        assert sum(a == b for a, b in zip(got, other)) < 10 and sum(a == i for i, a in enumerate(got)) < 10
        # no drift: places are spread over the positions, and neighbours part
        assert abs(np.corrcoef(np.arange(n), got)[0, 1]) < 0.12 and np.mean(np.abs(np.diff(got)) < 20) < 0.1


def test_epochs_need_no_global_sort_and_go_on_anywhere(spark):
    df = spark.createDataFrame([(f"p{i:03d}",) for i in range(103)], "storage_path string")
    samples = readers.numbered_samples(df)
    assert [r["position"] for r in samples.orderBy("storage_path").collect()] == list(range(103))
    whole = readers.epoch(samples, 103, 1, 0, 10)
    assert "rangepartitioning" not in plan_of(readers.epoch(spark.createDataFrame([(0, "p")], "position long, storage_path string"), 103, 1, 0, 10))
    order = [(r["batch"], r["place"], r["storage_path"]) for r in whole.collect()]  # partition after partition
    assert [(b, p) for b, p, _ in order] == [(i // 10, i % 10) for i in range(103)] and sorted(s for _, _, s in order) == [f"p{i:03d}" for i in range(103)]
    again = [(r["batch"], r["place"], r["storage_path"]) for r in readers.epoch(samples.repartition(7), 103, 1, 0, 10, partitions=3).collect()]
    assert again == order
    rest = [(r["batch"], r["place"], r["storage_path"]) for r in readers.epoch(samples, 103, 1, 0, 10, first_batch=6).collect()]
    assert rest == order[60:]
    second = [r["storage_path"] for r in readers.epoch(samples, 103, 1, 1, 10).collect()]
    assert second != [s for _, _, s in order] and sorted(second) == sorted(s for _, _, s in order)


def test_documents_are_read_by_lines(spark, tmp_path):
    cells = spark.createDataFrame([('x "q", {[', 42, -84), ('x "q", {[', 1, 2), ("y", 0, 0), ("}", 5, 6)], "slug string, clat long, clon long")
    sinks.json_file(sinks.geo_index_document(cells, 1.0), f"{tmp_path}/geo")
    assert rows(readers.geo_index_json(spark, f"{tmp_path}/geo")) == rows(cells) == rows(readers.geo_index_json(spark, f"{tmp_path}/geo", whole=True))
    assert "wholetext" not in str(readers.geo_index_json(spark, f"{tmp_path}/geo")._jdf.queryExecution().analyzed())
    keys = [("b/2", "val"), ('a "1", [', "val"), ("]}", "val"), ("c/3", "train")]
    sinks.json_file(sinks.split_document(spark.createDataFrame(keys, "key string, split string"), 42, 0.2), f"{tmp_path}/split")
    assert rows(readers.split_json(spark, f"{tmp_path}/split")) == sorted([(k, 1, 3) for k, s in keys if s == "val"], key=repr)
    per = spark.createDataFrame([(1, 2, 0.5, 1.0), (10, 3, None, 0.25)], "label int, n long, top1 double, top3 double")
    sinks.json_file(sinks.metrics_document(per.agg(F.sum("n").alias("n"), F.lit("a { b").alias("note")), per), f"{tmp_path}/metrics")
    assert rows(readers.metrics_json(spark, f"{tmp_path}/metrics")) == [("1", 2, 0.5, 1.0), ("10", 3, None, 0.25)]
    text = next(p for p in (tmp_path / "metrics").iterdir() if p.name.startswith("part")).read_text()
    assert json.loads(text)["overall"] == {"n": 5, "note": "a { b"}
    empty = spark.createDataFrame([], "slug string, clat long, clon long")
    sinks.json_file(sinks.geo_index_document(empty, 1.0), f"{tmp_path}/none")
    assert rows(readers.geo_index_json(spark, f"{tmp_path}/none")) == []


def test_scan_order_and_ties_by_first_appearance(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.tsv").write_text("k\n" + "\n".join(["z", "y", "y", "w"]) + "\n")
    (tmp_path / "in/a.tsv").write_text("k\n" + "\n".join(["x", "v", "z"] + ["x"] * 0) + "\n" + "filler\n" * 3000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = readers.with_scan_order(spark.read.csv(f"{tmp_path}/in", sep="\t", header=True)).repartition(5)
        assert [r["k"] for r in df.where("k <> 'filler'").orderBy("scan").collect()] == ["x", "v", "z", "z", "y", "y", "w"]
        top = C.top_first_seen(df, "k", "scan", 5).collect()
        assert [tuple(r) for r in top] == [("filler", 3000), ("z", 2), ("y", 2), ("x", 1), ("v", 1)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_reports_in_parts(spark, tmp_path):
    df = spark.range(1000).select((999 - F.col("id")).alias("n"), F.lit(None).cast("string").alias("x")).repartition(3)
    sinks.csv_parts(df, f"{tmp_path}/parts", "n")
    files = sorted(p for p in (tmp_path / "parts").iterdir() if p.name.startswith("part"))
    assert [line for f in files for line in f.read_text().splitlines()[1:]] == [f"{n}," for n in range(1000)]
    assert all(f.read_text().startswith("n,x\n") for f in files)


def test_a_hot_hash_is_told_from_its_first_by_an_aggregate(spark):
    made = spark.range(500).select(F.format_string("p%03d", "id").alias("path"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("md5"), F.when(F.col("id") != 0, 100).alias("width"), F.when(F.col("id") == 3, 5).otherwise(100).alias("height"))
    df = C.image_status(made, 20, "md5", "path")
    assert "Window" not in plan_of(df) and df.columns == ["path", "md5", "width", "height", "status"]
    got = {r["path"]: r["status"] for r in df.collect()}
    # neither the corrupt first nor the too small second claims the hash
    assert (got["p000"], got["p003"], got["p006"], got["p009"], got["p001"]) == ("corrupt", "too_small", "ok", "duplicate", "ok")
    assert sorted(got.values()).count("duplicate") == 164 and len(got) == 500
    none = C.image_status(made.withColumn("md5", F.lit(None).cast("string")), 20, "md5", "path").groupBy("status").count()
    assert dict(map(tuple, none.collect())) == {"corrupt": 1, "too_small": 1, "ok": 1, "duplicate": 497}


def prototypes(n, width, seed, clusters):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, width))
    x = centres[rng.integers(0, clusters, n)] + 0.1 * rng.standard_normal((n, width))
    x[5] = x[3]
    return x


def test_blocks_are_skipped_by_their_bounds(spark):
    x = prototypes(600, 16, 1, 12)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "class_idx int, proto array<double>")
    cells = R.CellBlocks.store(df, 20)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = unit[:40] + 0.01
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    true = q @ unit.T
    read, asked = 0, 0
    for a in range(0, 40, 4):
        sims, classes, n = cells.nearest(q[a : a + 4], 3)
        want = np.lexsort((np.broadcast_to(np.arange(600), (4, 600)), -true[a : a + 4]), axis=1)[:, :3]
        assert (classes == want).all() and np.allclose(sims, np.take_along_axis(true[a : a + 4], want, 1))
        read, asked = read + n, asked + len(cells.blocks)
    assert len(cells.blocks) >= 30 and read / asked < 0.5
    bounds = cells.bounds(q)
    for at, b in enumerate(cells.blocks):
        names, _ = R._block(cells.path, b)
        assert (true[:, names] <= bounds[:, at : at + 1]).all()


def test_top_k_of_many_agrees_with_top_k(spark):
    x = prototypes(300, 8, 2, 5)
    x[7] = 0.0
    protos = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, None)], "class_idx int, proto array<double>")
    ask = spark.createDataFrame([(i, (v + 0.05).tolist()) for i, v in enumerate(x[:60])] + [(90, None), (91, [0.0] * 8), (92, [None] * 8)], "vec_id long, embedding array<double>")
    columns = ["query_id", "rank", "class_idx", F.round("sim", 9).alias("sim")]
    assert rows(R.top_k_of_many(ask, protos, 4, block=16).select(*columns)) == rows(R.top_k(ask, protos, 4).select(*columns))
    assert R.top_k_of_many(ask, protos.where("class_idx < 0"), 4).count() == 0
    assert {r["n"] for r in R.top_k_of_many(ask, protos.where("class_idx < 2"), 4).groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {2}


def test_a_database_is_read_by_other_processes(tmp_path):
    """Executors have no memory in common with the driver or one another."""
    run = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
from lodestone import plans
print("rows", plans.QUERIES["database_manifest"](spark, "{DATA}").distinct().count(), spark.read.parquet("{DATA}/lineitem.parquet").count())
spark.stop()
"""
    said = subprocess.run([sys.executable, "-c", run], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT, "SPARK_WORKER_DIR": f"{tmp_path}/work"}, capture_output=True, text=True, timeout=300)
    rows = [line.split()[1:] for line in said.stdout.splitlines() if line.startswith("rows")]
    assert rows and rows[0][0] == rows[0][1] != "0", said.stderr[-2000:]


def test_database_files_hold_ranges_and_come_back_whole(spark, tmp_path):
    put = [(n, None if n % 7 == 0 else f"näme '{n}'", n / 3 if n % 2 else None, n % 5) for n in range(-20, 300)]
    ddl = "id long, name string, x double, k int"
    root = f"file://{tmp_path}/db"
    sinks.sqlite_files(spark.createDataFrame(put, ddl), root, "t", ["id"], 3)
    got = readers.sqlite_table(spark, root, "t", ddl)
    assert sorted(map(tuple, got.collect())) == put and got.dtypes == [("id", "bigint"), ("name", "string"), ("x", "double"), ("k", "int")]
    assert len(list((tmp_path / "db").glob("*.db"))) == 3
    sinks.sqlite_files(spark.createDataFrame([], ddl), f"{root}0", "t", ["id"], 2)
    assert readers.sqlite_table(spark, f"{root}0", "t", ddl).count() == 0


def test_a_server_is_read_in_ranges(spark):
    url = f"jdbc:derby:memory:lodestone{uuid.uuid4().hex};create=true"
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    spark.range(100).write.format("jdbc").options(url=url, dbtable="t").mode("append").save()
    got = readers.jdbc_table(spark, url, "t", "id", (0, 99), 4)
    assert sorted(r[0] for r in got.collect()) == list(range(100)) and got.rdd.getNumPartitions() == 4


def test_places_in_a_group_that_holds_all_rows(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("id"), F.when(F.col("id") < 2900, F.lit(1)).when(F.col("id") < 2950, F.lit(2)).alias("g"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = C.place_in_group(df, "g", "id", "place")
        got = rows(placed)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = {}
    for n, g in sorted(map(tuple, df.collect())):
        groups.setdefault(g, []).append((n, g, len(groups.get(g, []))))
    assert got == sorted((r for some in groups.values() for r in some), key=repr)
    windows = [w for w in placed._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [row_number" in w]
    assert windows and all("[_range" in w for w in windows)


def test_pages_are_numbered_by_ranges_of_a_key(spark, tmp_path, monkeypatch):
    from lodestone.plans import services

    numbered = []
    monkeypatch.setattr(services.C, "place_in_group", lambda *a, f=C.place_in_group: numbered.append(a[1:]) or f(*a))
    docs = spark.range(95).select("id", F.lit(3).alias("key"), F.struct("id").alias("doc"))
    name = lambda key, page: F.concat_ws("-", key.cast("string"), page.cast("string"))
    services._put_pages(docs, "id", name, f"file://{tmp_path}/up", size=40)
    services._put_pages(docs, "id", name, f"file://{tmp_path}/down", size=40, newest=True)
    pages = {way: {p.name: [r["id"] for r in json.loads(p.read_text())["results"]] for p in (tmp_path / way).iterdir()} for way in ("up", "down")}
    up, down = list(range(95)), list(range(94, -1, -1))
    assert pages == {way: {"3-0": ids[:40], "3-1": ids[40:80], "3-2": ids[80:], "3-3": []} for way, ids in (("up", up), ("down", down))}
    assert len(numbered) == 2


def test_a_lookup_meets_no_pairs(spark):
    left = spark.range(300).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.lit(1)).alias("id"), F.lit("n").alias("name"))
    right = spark.range(400).select((F.col("id") + 5).alias("m"), F.when(F.col("id") % 2 > 0, F.lit(1)).alias("id"), F.lit("n").alias("name"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = C.id_else_name(left.union(left.limit(1)), right, ("k", "id", "name"), ("m", "id", "name"))
        got, todo, joined = rows(df), [df._jdf.queryExecution().executedPlan()], []
        while todo:
            node = todo.pop()
            todo += [node.children().apply(n) for n in range(node.children().size())]
            if "Join" in node.nodeName():
                joined.append(node.metrics().apply("numOutputRows").value())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == sorted(((k, 5) for k in range(300)), key=repr)
    assert joined and max(joined) <= 301
