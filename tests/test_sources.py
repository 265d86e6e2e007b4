import contextlib
import gzip
import hashlib
import json
import os
import subprocess
import sys
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from io import BytesIO
from urllib.error import HTTPError

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.config import load_config
from lodestone.functions import images
from lodestone.operators import rank
from lodestone.sources import readers, rest, sinks
from lodestone.streaming import extension


def test_tsv(spark, tmp_path):
    with gzip.open(tmp_path / "taxa.csv.gz", "wt") as f:
        f.write("taxon_id\tancestry\trank\tname\n1\t48/2\tspecies\tA b\n2\t\tgenus\tA\n")
    df = readers.tsv(spark, str(tmp_path / "taxa.csv.gz"), "taxon_id string, ancestry string, rank string, name string", ("taxon_id", "name"), 2)
    assert sorted(map(tuple, df.collect())) == [("1", "A b"), ("2", "A")] and df.rdd.getNumPartitions() == 2


def test_species_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# head\n\nAtta  texana   # Leafcutter\natta texana\nPogonomyrmex rugosus\n")
    got = readers.species_list(spark, str(tmp_path / "list.txt")).select("name", "common_name", "slug").collect()
    assert [tuple(r) for r in got] == [("Atta texana", "Leafcutter", "atta-texana"), ("Pogonomyrmex rugosus", None, "pogonomyrmex-rugosus")]


@pytest.fixture
def folder(tmp_path):
    for name in ("b-two/1.PNG", "a-one/2.jpg", "a-one/2.png", "a-one/note.txt"):
        (tmp_path / "img" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / name).write_bytes(name.encode())
    return tmp_path


def test_manifests(spark, folder):
    root = str(folder / "img")
    samples = readers.directory_manifest(spark, root).orderBy("storage_path").collect()
    assert [(r["slug"], r["label"]) for r in samples] == [("a-one", 0), ("a-one", 0), ("b-two", 1)]
    (folder / "m.csv").write_text("slug,photo_id,split,lat\na-one,2,val,1.5\nb-two,1,,x\nzero,9,train,\n")
    found, missing = readers.csv_manifest(spark, str(folder / "m.csv"), root)
    got = {r["slug"]: r for r in found.collect()}
    assert got["a-one"]["storage_path"].endswith("2.jpg") and got["a-one"]["lat"] == 1.5 and got["b-two"]["split"] is None
    assert [tuple(r) for r in missing.collect()] == [("zero", "9")]
    images = spark.createDataFrame([(1, "p", "val", None, 2.0)], "species_id int, storage_path string, split string, lat double, lon double")
    species = spark.createDataFrame([(1, "a-one")], "id int, slug string")
    assert readers.manifest(spark, (images, species), csv="ignored").count() == 1
    assert readers.manifest(spark, root=root).count() == 3
    with pytest.raises(ValueError):
        readers.manifest(spark)
    assert [r["storage_path"] for r in readers.batches(readers.manifest(spark, root=root)).collect()] == sorted(r["storage_path"] for r in samples)


def test_nested_documents(spark):
    doc = {"uuid": "u", "location": "1.5,2", "created_at": "2026-01-01", "taxon": {"id": 3, "name": "A b", "rank": "species"}, "photos": [{"id": 7, "url": "x/square.jpg"}]}
    flat = readers.observations_json(spark.createDataFrame([(json.dumps(doc),), ('{"uuid": "v"}',)], "value string"))
    from lodestone.operators.curate import first_photo, still_images

    assert [(r["uuid"], r["lat"], r["lon"], r["photo_id"], r["name"]) for r in first_photo(flat).collect()] == [("u", 1.5, 2.0, 7, "A b")]
    page = {"results": [{"media": [{"identifier": "i", "type": "StillImage"}, {"identifier": "j", "format": "image/png"}, {"identifier": "k", "type": "Sound"}]}], "endOfRecords": True}
    media = readers.occurrences_json(spark.createDataFrame([(json.dumps(page),)], "value string"))
    assert sorted(r["identifier"] for r in still_images(media).collect()) == ["i", "j"]


def test_specimen_payloads(spark):
    records = '[{"shotType": "H", "image": "a"}, {"shotType": "", "shot_type": "P", "url": ""}, {"shot_type": "d", "image": null, "url": 0, "imageURL": "b"}, 5, null, "x", [1], {"image": "a", "shot_type": "p"}, {"image": {"small": "s", "high": "h"}}, {"image": {"small": "t", "high": ""}}, {"image": {"original": "o", "high": "h"}}]'
    payloads = [
        (1, f'{{"specimenImages": {records}}}'),
        (2, '{"specimenImages": {}, "images": {"b": {"url": "1"}, "a": {"originalThumbnailUrl": "2", "shot_type": "h"}, "c": 7}}'),
        (3, '{"specimenImages": "text"}'), (4, "[1]"), (5, "no json"), (6, None), (7, '{"images": [[{"url": "nested"}]]}'),
    ]
    df = spark.createDataFrame(payloads, "id int, value string")
    rows = [tuple(r) for r in readers.specimens_json(df).select("id", "position", "shot_type", "url").orderBy("id", "position").collect()]
    assert rows == [(1, 0, "h", "a"), (1, 1, "d", "b"), (1, 2, "p", "a"), (1, 3, "", "h"), (1, 4, "", "t"), (1, 5, "", "o"), (2, 0, "", "1"), (2, 1, "h", "2")]
    first = readers.specimen_images(df, ("p", " D "), 3).drop("value").orderBy("id", "position").collect()
    assert [tuple(r) for r in first] == [(1, 0, "b"), (1, 1, "a"), (1, 2, "h"), (2, 0, "1"), (2, 1, "2")]
    assert [tuple(r)[::2] for r in readers.specimen_images(df, ("h",), 9).drop("value").where("id = 2").orderBy("position").collect()] == [(2, "2"), (2, "1")]


def test_documents_written_and_read(spark, tmp_path):
    cells = spark.createDataFrame([("x", 42, -84), ("x", 1, 2), ("y", 0, 0)], "slug string, clat long, clon long")
    sinks.json_file(sinks.geo_index_document(cells, 1.0), str(tmp_path / "geo"))
    assert sorted(map(tuple, readers.geo_index_json(spark, str(tmp_path / "geo")).collect())) == sorted(map(tuple, cells.collect()))
    taxonomy = spark.createDataFrame([(10, "B", None, 2, "b"), (2, "A", "a!", None, "a")], "class_idx int, species_name string, common_name string, taxon_id int, slug string")
    text = sinks.taxonomy_document(taxonomy)
    assert list(json.loads(text)) == ["2", "10"]
    (tmp_path / "tax.json").write_text(text)
    assert sorted(map(tuple, readers.taxonomy_json(spark, str(tmp_path / "tax.json")).collect())) == sorted(map(tuple, taxonomy.collect()))
    split = spark.createDataFrame([("b/2", "val"), ("a/1", "val"), ("c/3", "train")], "key string, split string")
    sinks.json_file(sinks.split_document(split, 42, 0.2), str(tmp_path / "split"))
    assert json.loads(next((tmp_path / "split").glob("part*")).read_text()) == {"seed": 42, "val_fraction": 0.2, "n_train": 1, "n_val": 2, "val": ["a/1", "b/2"]}
    report = spark.createDataFrame([("p", "ok", 1, 2, True), ("q", "corrupt", None, None, None)], "path string, status string, width int, height int, has_exif boolean")
    sinks.clean_report(report, str(tmp_path / "report"))
    assert next((tmp_path / "report").glob("part*")).read_text().splitlines() == ["path,status,width,height,has_exif,kept", "p,ok,1,2,1,1", "q,corrupt,,,,0"]
    sinks.survivors(report, str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 1
    for _ in range(2):
        sinks.append_run(report, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 4
    objects = spark.createDataFrame([("a/x.jpg", bytearray(b"1")), ("b/y.png", bytearray(b"22"))], "key string, content binary")
    sinks.put_objects(objects, f"file://{tmp_path}/store")
    assert (tmp_path / "store/a/x.jpg").read_bytes() == b"1" and (tmp_path / "store/b/y.png").read_bytes() == b"22"
    per = spark.createDataFrame([(1, 2, 0.5, 1.0)], "label int, n long, top1 double, top3 double")
    assert json.loads(sinks.metrics_document(per.select("n", "top1"), per).first()["value"]) == {"overall": {"n": 2, "top1": 0.5}, "per_species": {"1": {"n": 2, "top1": 0.5, "top3": 1.0}}}
    assert readers.staged(spark, f"file://{tmp_path}/tax.json", f"file://{tmp_path}/copy.json").endswith("copy.json")
    assert (tmp_path / "copy.json").read_text() == text


def test_response(spark):
    ranks = spark.createDataFrame([(1, 0, 0.51239, 2, False), (1, 1, 0.5, 1, True)], "query_id long, class_idx int, sim double, rank int, geo_boosted boolean")
    species = spark.createDataFrame([(0, "A", None, 5), (1, "B", "b", 6)], "class_idx int, species_name string, common_name string, taxon_id int")
    got = json.loads(rank.response(ranks, species).first()["results"])
    assert [(r["rank"], r["species_name"], r["similarity"], r["geo_boosted"]) for r in got] == [(1, "B", 0.5, True), (2, "A", 0.5124, False)]
    timed = ranks.withColumns({"ms": F.lit(12.9), "geo_filtered": F.lit(True)})
    whole = json.loads(rank.response(timed, species, 1, "ms").first()["response"])
    assert whole == {"results": [{"rank": 1, "species_name": "B", "common_name": "b", "taxon_id": 6, "similarity": 0.5, "geo_boosted": True}], "inference_ms": 12, "geo_filtered": True}
    assert json.loads(rank.response(ranks, species).first()["response"])["inference_ms"] is None


def test_retries():
    waits, answers = [], [HTTPError("u", 503, "", None, None), HTTPError("u", 429, "", None, None), BytesIO(b'{"results": [1]}')]

    def fetch(url):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert rest.get_json("http://h", {"a": 1}, fetch=fetch, sleep=waits.append) == {"results": [1]} and waits == [2.0, 4.0]
    with pytest.raises(HTTPError):
        rest.get_json("http://h", {}, fetch=lambda u: (_ for _ in ()).throw(HTTPError(u, 404, "", None, None)), sleep=waits.append)


def test_paging(monkeypatch):
    pages = {("7", 1): [1, 2], ("7", 2): [3], ("8", 1): []}
    monkeypatch.setattr(rest, "get_json", lambda url, p, *a: {"results": pages[p["taxon_id"], p["page"]]})
    reader = rest.PagedReader({"url": "u", "keys": "7,8", "pagesize": "2"})
    assert [list(reader.read(k)) for k in reader.partitions()] == [[("7", "1"), ("7", "2"), ("7", "3")], []]


def test_paging_by_offset_with_caps(monkeypatch):
    asked = []
    rows = [{"taxon": {"rank": r, "name": n}, "photos": p} for r, n, p in [("species", "A", [{"id": 1, "url": "u"}])] * 3 + [("genus", "A", []), ("species", "B", []), ("species", "B", [{"id": 2, "url": "u"}]), ("species", None, [{"id": 3, "url": "u"}])]]

    def answer(url, p, *a):
        asked.append((url, p.get("offset"), p.get("uuid")))
        part = rows[p["offset"] : p["offset"] + p["limit"]]
        return {"results": part, "endOfRecords": p["offset"] + p["limit"] >= len(rows)}

    monkeypatch.setattr(rest, "get_json", answer)
    options = {"url": "u", "keys": "7", "paging": "offset", "pagesize": "3", "pages": "9", "cap": "2", "capfield": "taxon.name", "where": '{"taxon.rank": "species"}', "present": "photos.0.id"}
    reader = rest.PagedReader(options)
    got = [json.loads(v)["taxon"]["name"] for _, v in reader.read(reader.partitions()[0])]
    assert got == ["A", "A", "B"] and [a[1] for a in asked] == [0, 3, 6]
    stopped = rest.PagedReader(options | {"target": "1"})
    asked.clear()
    assert len(list(stopped.read(stopped.partitions()[0]))) == 1 and len(asked) == 1
    many = rest.PagedReader({"url": "u", "keys": ",".join(map(str, range(250))), "keysperrequest": "100"})
    assert [len(p.keys) for p in many.partitions()] == [100, 100, 50]
    seen = []
    monkeypatch.setattr(rest, "get_json", lambda url, p, *a: seen.append((url, p)) or {"results": []})
    by_path = rest.PagedReader({"url": "http://h/taxa/", "keys": "1,2", "keysperrequest": "30", "keyin": "path", "pages": "1"})
    assert list(by_path.read(by_path.partitions()[0])) == [] and seen[0][0] == "http://h/taxa/1,2"


class Server:
    """Answers each path as it says, and counts how often it was asked."""

    def __init__(self):
        self.asked = Counter()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *a):
                pass

            def do_GET(self):
                name = self.path.strip("/")
                outer.asked[name] += 1
                if name == "slow":
                    time.sleep(3)
                status = int(name) if name.isdigit() else 503 if name == "busy" and outer.asked[name] < 3 else 200
                body = b"" if name == "empty" else b"the body of " + name.encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(body) + (50 if name == "cut" else 0)))
                self.end_headers()
                with contextlib.suppress(BrokenPipeError):  # who waited no longer
                    self.wfile.write(body)

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}/"


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


def test_only_accepted_rows_count(spark, monkeypatch):
    """Excluded rows count towards neither the cap nor the target; later pages make up for them."""
    rows = [{"uuid": f"u{i}", "taxon": {"rank": "species", "name": n}, "photos": [{"id": i, "url": "x"}]} for i, n in enumerate(["A b"] * 5 + ["a-B"] * 3 + ["C"] * 6)]
    asked = []

    def answer(url, p, *a):
        asked.append(p["page"])
        return {"results": rows[(p["page"] - 1) * 3 : p["page"] * 3]}

    monkeypatch.setattr(rest, "get_json", answer)
    photos = rest.stored_keys(spark.createDataFrame([(0,), (1,), (1,), (None,), (9,)], "id long"), "id")
    uuids = rest.stored_keys(spark.createDataFrame([("u8",), ("u10",)], "id string"), "id")
    options = {"url": "u", "pagesize": "3", "pages": "9", "cap": "2", "capfield": "taxon.name", "exclude": json.dumps({"photos.0.id": photos, "uuid": uuids})}
    got = lambda **o: [json.loads(v)["uuid"] for v in rest.accepted("7", options | o)]
    assert got() == ["u2", "u3", "u11", "u12"] and asked == [1, 2, 3, 4, 5]
    asked.clear()
    assert got(target="3") == ["u2", "u3", "u11"] and asked == [1, 2, 3, 4]
    assert got(pages="2") == ["u2", "u3"]


def test_the_first_of_equal_photos_counts(monkeypatch):
    rows = [{"photos": [{"id": i, "url": u}]} for i, u in [(1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, ""), (2, "e"), (3, "f")]]
    monkeypatch.setattr(rest, "get_json", lambda url, p, *a: {"results": rows[(p["page"] - 1) * 7 : p["page"] * 7]})
    options = {"url": "u", "pagesize": "7", "present": "photos.0.url", "distinct": "photos.0.id", "target": "3"}
    assert [json.loads(v)["photos"][0]["url"] for v in rest.accepted("7", options)] == ["a", "c", "e"]


def test_stored_keys(spark, monkeypatch):
    monkeypatch.setattr(rest, "_SHARD_KEYS", 4)
    keys = rest.KeySet(rest.stored_keys(spark.range(0, 3000, 3).withColumnRenamed("id", "k"), "k"))
    assert keys.digits == 2 and [i for i in range(3000) if i in keys] == list(range(0, 3000, 3)) and len(keys.shards) == 32
    assert "x" not in rest.KeySet(rest.stored_keys(spark.createDataFrame([], "k string"), "k"))


def test_a_failing_series(monkeypatch):
    def fails(*a):
        raise ValueError("no JSON")

    monkeypatch.setattr(rest, "get_json", fails)
    assert list(rest.accepted("7", {"url": "u", "failures": "skip"})) == []
    with pytest.raises(ValueError):
        list(rest.accepted("7", {"url": "u"}))


def test_requests_pause(monkeypatch):
    waits, now = [], [100.0]
    monkeypatch.setattr(rest.time, "sleep", waits.append)
    monkeypatch.setattr(rest.time, "monotonic", lambda: now[0])
    monkeypatch.setattr(rest, "get_json", lambda url, p, *a: {"results": [1]})
    monkeypatch.setattr(rest, "_last_request", [0.0])
    list(rest.accepted("7", {"url": "u", "pagesize": "1", "pages": "3", "pause": "1.5"}))
    assert waits == [1.5, 1.5]


def test_keys_from_a_table(spark, server, tmp_path):
    """Keys are rows of a table, joined laterally; none is ever on the driver."""
    for k in range(5):
        for page in (1, 2):
            rows = [{"k": k, "page": page}] * (2 if page == 1 else 1)
            (tmp_path / f"list?taxon_id={k}&page={page}&per_page=2").write_text(json.dumps({"results": rows}))
    keys = spark.createDataFrame([(k, f"name {k}") for k in range(5)] + [(None, "none")], "k int, name string").repartition(3)
    got = rest.paged(keys, "k", f"file://{tmp_path}/list", pagesize=2, pages=2)
    assert got.columns == ["k", "name", "value"]
    assert sorted((r["k"], r["name"], json.loads(r["value"])["page"]) for r in got.collect()) == sorted((k, f"name {k}", p) for k in range(5) for p in (1, 1, 2))
    (tmp_path / "some?uuid=a,b&page=1&per_page=2").write_text('{"results": [{"uuid": "b"}]}')
    (tmp_path / "some?uuid=c&page=1&per_page=2").write_text('{"results": []}')
    few = spark.createDataFrame([("a",), ("b",), (None,), ("c",)], "u string").coalesce(1)
    assert [tuple(r) for r in rest.observations_by_uuid(spark, f"file://{tmp_path}/some", few, batch=2, pause=0).collect()] == [("a,b", '{"uuid": "b"}')]


def test_downloads(spark, tmp_path, server):
    (tmp_path / "a.png").write_bytes(b"no image")
    (tmp_path / "empty").write_bytes(b"")
    good = {1: f"file://{tmp_path}/a.png", 2: server.url + "fine", 3: server.url + "busy"}
    bad = {10: f"file://{tmp_path}/none", 11: None, 12: f"file://{tmp_path}/empty", 13: "/no/scheme", 14: "http://[broken", 15: "http://a b/", 16: server.url + "cut", 17: server.url + "slow", 18: server.url + "404", 19: server.url + "429", 20: server.url + "empty", 21: "http://127.0.0.1:1/", 22: "gopher:x", 23: ""}
    urls = spark.createDataFrame(list((good | bad).items()), "content_id int, url string")
    got = {r["content_id"]: r for r in rest.downloaded(urls, tries=3, backoff=0.01, timeout=0.5).collect()}
    said = {1: b"no image", 2: b"the body of fine", 3: b"the body of busy"}
    assert {i: bytes(got[i]["content"]) for i in good} == said
    assert all(got[i]["sha256"] == hashlib.sha256(said[i]).hexdigest() for i in good)
    assert set(got) == set(good | bad) and all(got[i]["content"] is None and got[i]["sha256"] is None for i in bad)
    # what may pass is tried three times, the rest once
    assert server.asked == {"fine": 1, "busy": 3, "cut": 3, "slow": 3, "404": 1, "429": 3, "empty": 1}
    rich = rest.enriched(urls.where("content_id = 1"), "known", "web").first()
    assert (rich["category"], rich["source"], rich["blur_score"]) == ("known", "web", None)
    objects = spark.createDataFrame([(1, f"file://{tmp_path}/a.png"), (2, f"file://{tmp_path}/none"), (3, None)], "i int, uri string")
    assert sorted((r["i"], r["content"] and bytes(r["content"])) for r in readers.get_objects(objects).collect()) == [(1, b"no image"), (2, None), (3, None)]


def test_bodies_go_out_by_bytes_and_few_are_asked_for_at_once():
    batch = pa.RecordBatch.from_pydict({"id": list(range(20)), "n": [10] * 20})
    now, most, lock = [0], [0], threading.Lock()

    def fetch(n):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.005)
        with lock:
            now[0] -= 1
        return bytes(n)

    parts = list(rest.with_bodies(fetch, in_flight=3, flush=35)([batch, batch.slice(0, 0)]))
    assert [len(p) for p in parts] == [4] * 5 and most[0] == 3
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(20)) and parts[0].schema.names == ["id", "content"]


def test_a_shared_folder_without_a_scheme(tmp_path):
    """In a session of its own: what is made there goes when the application ends."""
    said = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
from lodestone import storage
from lodestone.sources import rest, sinks
print(storage.shared_dir(spark))
root = storage.new_folder(spark, "objects")
sinks.put_objects(spark.createDataFrame([("a/x y.png", bytearray(b"1"))], "key string, content binary"), root)
print(rest.downloaded(spark.createDataFrame([(root + "/a/x%20y.png",)], "url string")).first()["content"] == b"1")
print(storage.cut(spark.range(5)).count(), storage.stored(spark.range(6), "six").count())
spark.stop()
"""
    (tmp_path / "shared").mkdir()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", said, str(tmp_path / "shared")], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=240)
    assert done.stdout.split("\n")[:3] == [f"file://{tmp_path}/shared", "True", "5 6"], done.stderr
    left = [p for p in (tmp_path / "shared").rglob("*") if p.is_file()]
    assert left == []


def test_matrix_files(spark, tmp_path):
    protos = spark.createDataFrame([(1, [0.5, 1.0, 2.0]), (0, [1.0, 0.0, -1.0])], "class_idx int, proto array<double>")
    sinks.prototypes_npy(protos, f"file://{tmp_path}/m")
    assert np.load(tmp_path / "m/prototypes.npy").tolist() == [[1.0, 0.0, -1.0], [0.5, 1.0, 2.0]]
    assert sorted(map(tuple, readers.prototypes_npy(spark, f"file://{tmp_path}/m/prototypes.npy").collect())) == sorted(map(tuple, protos.collect()))
    with pytest.raises(ValueError, match="row a class"):
        sinks.prototypes_npy(protos.where("class_idx = 1"), f"file://{tmp_path}/m")


def test_images_decoded_in_the_jvm(spark, tmp_path):
    jvm = spark._jvm
    for name, kind in (("a/x.jpg", "jpg"), ("a/y.png", "png")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        image = jvm.java.awt.image.BufferedImage(20, 10, 1)
        for x in range(20):
            for y in range(10):
                image.setRGB(x, y, 0xFF0000 if x < 10 else 0x0000FF)
        assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(tmp_path / name)))
    (tmp_path / "a/z.jpg").write_bytes(b"no image")
    df = readers.decoded_images(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r for r in df.withColumn("b", images.blur_pixels("image")).withColumn("x", images.preprocess_pixels(4)("image")).collect()}
    assert [(n, got[n]["width"], got[n]["height"], got[n]["slug"]) for n in sorted(got)] == [("x.jpg", 20, 10, "a"), ("y.png", 20, 10, "a"), ("z.jpg", None, None, "a")]
    plain = (tmp_path / "a/x.jpg").read_bytes()
    tags = b"Exif\x00\x00II*\x00\x08\x00\x00\x00\x01\x00\x12\x01\x03\x00\x01\x00\x00\x00\x01\x00\x00\x00\x00\x00\x00\x00"
    filler = b"\xff\xfe\xff\xf2" + bytes(65520)
    (tmp_path / "a/e.jpg").write_bytes(plain[:2] + 2 * filler + b"\xff\xe1" + (len(tags) + 2).to_bytes(2, "big") + tags + plain[2:])
    (tmp_path / "a/f.jpg").write_bytes(plain + tags)
    seen = {r["path"].rsplit("/", 1)[1]: tuple(r)[3:] for r in readers.inspected_images(spark, str(tmp_path)).collect()}
    digest = lambda n: hashlib.md5((tmp_path / "a" / n).read_bytes()).hexdigest()
    assert seen == {"e.jpg": (digest("e.jpg"), True, 20, 10), "f.jpg": (digest("f.jpg"), False, 20, 10), "x.jpg": (digest("x.jpg"), False, 20, 10), "y.png": (digest("y.png"), False, 20, 10), "z.jpg": (digest("z.jpg"), None, None, None)}
    assert got["z.jpg"]["b"] is None and got["y.png"]["b"] > 0 and got["x.jpg"]["b"] == pytest.approx(got["y.png"]["b"], rel=0.5)
    own = spark.createDataFrame([((tmp_path / "a/y.png").read_bytes(),)], "content binary").select(images.blur_score("content").alias("b"), images.preprocess(4)("content").alias("x")).first()
    assert own["b"] == got["y.png"]["b"] and own["x"] == got["y.png"]["x"] and len(got["x.jpg"]["x"]) == 48
    (tmp_path / "a/w.webp").write_bytes(b"RIFF")
    with pytest.raises(Exception, match="WebP needs Pillow"):
        readers.decoded_images(spark, str(tmp_path)).count()


def test_training_order_depends_on_the_seed_only(spark):
    df = spark.createDataFrame([(f"p{i}",) for i in range(40)], "storage_path string")
    orders = [[r[0] for r in readers.batches(d, s).collect()] for d, s in ((df, 1), (df.repartition(5), 1), (df, 2))]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[2]) == sorted(orders[0])


def test_yaml_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("model: b4\nsplit: {seed: 42}\n")
    assert load_config(str(tmp_path / "c.yaml"), {"model": "b0"}) == {"model": "b0", "split": {"seed": 42}}


def test_streaming_extension(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1.5, 2.5), ("a", "x", 1.5, 2.5), ("b", "y", None, 1.0)], "k string, slug string, lat double, lon double").withColumn("ts", F.timestamp_seconds(F.lit(1)))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, n in (("once", extension.first_per_key_stream(stream, "k", "ts"), 2), ("known", extension.known_cells_stream(stream, rows), 3)):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        assert spark.table(name).count() == n
    assert spark.table("known").where("n = 2").count() == 2
