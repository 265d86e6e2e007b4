"""Queries that write files to the shared folder and read them again, and their SQL."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import images
from lodestone.operators import curate as C
from lodestone.operators import evaluate as E
from lodestone.operators import geo
from lodestone.operators import integrity as I
from lodestone.operators import rank as R
from lodestone.plans.base import OBSERVATIONS, SIMS, observations, query, table
from lodestone.plans.retrieval import folds, ranks_of_truth, reranked
from lodestone.shipping import ship
from lodestone.sources import readers, rest, sinks
from lodestone.sources.keyed import KeyedTable
from lodestone.storage import new_folder, stored


@query("SELECT p_partkey::VARCHAR AS taxon_id, p_name AS name FROM part")
def tsv_scan(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "tsv")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("taxon_id"), F.col("p_brand").alias("ancestry"), F.col("p_type").alias("rank"), F.col("p_name").alias("name"))
    part.write.csv(path, sep="\t", header=True, compression="gzip")
    return readers.tsv(spark, path, "taxon_id string, ancestry string, rank string, name string", ("taxon_id", "name"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, nullif(c_name, 'Customer#000000000') AS c_name, c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "csv")
    sinks.csv_file(table(spark, d, "customer").select("c_custkey", F.nullif("c_name", F.lit("Customer#000000000")).alias("c_name"), "c_mktsegment"), path, "c_custkey")
    return readers.rows_csv(spark, path)


@query("""WITH n AS (SELECT n_nationkey, 'Genus' || n_regionkey || ' s' || n_nationkey % 20 AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'Common ' || n_nationkey END AS common_name FROM nation)
SELECT name, common_name, replace(lower(name), ' ', '-') AS slug FROM n QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY n_nationkey) = 1""")
def species_list_scan(spark: SparkSession, d: str) -> DataFrame:
    """A list of names with comments, blank lines and repetitions in other letters."""
    path = new_folder(spark, "species-list")
    n = F.col("n_nationkey")
    name = F.concat(F.lit("Genus"), F.col("n_regionkey").cast("string"), F.lit("  s"), (n % 20).cast("string"))
    line = F.concat(F.when(n >= 20, F.upper(name)).otherwise(name), F.when(n % 3 == 0, F.concat(F.lit("   # Common "), n.cast("string"))).otherwise(F.lit("")))
    lines = table(spark, d, "nation").select(n.alias("at"), line.alias("value")).union(spark.createDataFrame([(-1, "# a head"), (7, "")], "at int, value string"))
    lines.coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return readers.species_list(spark, path).select("name", "common_name", "slug")


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN lang IS NULL THEN 'corrupt' WHEN n_chars < 500 THEN 'too_small' ELSE 'ok' END AS status, CASE WHEN lang IS NOT NULL THEN n_chars::VARCHAR END AS width, (lang IS NOT NULL AND n_chars >= 500)::INTEGER::VARCHAR AS kept FROM documents""")
def clean_report(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "clean-report")
    size, lang = F.col("n_chars"), F.col("lang")
    status = F.when(lang.isNull(), "corrupt").when(size < 500, "too_small").otherwise("ok")
    seen = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), status.alias("status"), F.when(lang.isNotNull(), size).alias("width"), F.when(lang.isNotNull(), size).alias("height"), F.when(lang.isNotNull(), lang == "en").alias("has_exif"))
    sinks.clean_report(seen, path)
    return readers.rows_csv(spark, path).select("path", "status", "width", "kept")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 2000")
def survivors(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "survivors")
    sinks.survivors(table(spark, d, "documents").select("doc_id", "n_chars", F.when(F.col("n_chars") >= 2000, "ok").otherwise("too_small").alias("status")), path)
    return spark.read.parquet(path).select("doc_id", "n_chars")


@query(f"""WITH {OBSERVATIONS} SELECT slug, floor(lat)::BIGINT AS clat, floor(lon)::BIGINT AS clon FROM obs WHERE lat IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def geo_index_file(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "geo-index")
    sinks.json_file(sinks.geo_index_document(geo.cell_counts(observations(spark, d), minimum=2), 1.0), path)
    return readers.geo_index_json(spark, path)


@query("SELECT n_nationkey AS class_idx, n_name AS species_name, CASE WHEN n_regionkey > 2 THEN lower(n_name) END AS common_name, n_regionkey AS taxon_id, replace(lower(n_name), '_', '-') AS slug FROM nation")
def taxonomy_file(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "taxonomy")
    name = F.col("n_name")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("class_idx"), name.alias("species_name"), F.when(F.col("n_regionkey") > 2, F.lower(name)).alias("common_name"), F.col("n_regionkey").alias("taxon_id"), F.replace(F.lower(name), F.lit("_"), F.lit("-")).alias("slug"))
    sinks.json_file(spark.createDataFrame([(sinks.taxonomy_document(rows),)], "value string"), path)
    return readers.taxonomy_json(spark, path)


@query(f"WITH {SIMS} SELECT class_idx, generate_subscripts(proto, 1) - 1 AS dim, round(unnest(proto), 5) + 0 AS x FROM p")
def prototype_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Through a matrix file in single precision."""
    root = new_folder(spark, "prototypes")
    sinks.prototypes_npy(R.prototypes(folds(spark, d)[0]), root)
    x = readers.prototypes_npy(spark, f"{root}/prototypes.npy").select("class_idx", F.posexplode("proto").alias("dim", "x"))
    return x.select("class_idx", F.col("dim").cast("long").alias("dim"), F.round("x", 5).alias("x"))


@query("""SELECT source || '/' || doc_id AS key, (SELECT count(*) FROM documents WHERE doc_id % 5 = 0) AS n_val, (SELECT count(*) FROM documents WHERE doc_id % 5 > 0) AS n_train FROM documents WHERE doc_id % 5 = 0""")
def pinned_split_file(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "split")
    rows = table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("key"), F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split"))
    sinks.json_file(sinks.split_document(rows, 42, 0.2), path)
    return readers.split_json(spark, path)


@query(f"""WITH {SIMS}, ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, class_idx) AS rank FROM sims)
SELECT label::VARCHAR AS label, count(*) AS n, round(count(*) FILTER (rank = 1) / count(*), 6) AS top1 FROM ranks WHERE class_idx = label GROUP BY 1""")
def metrics_file(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "metrics")
    per_class = E.class_accuracy(ranks_of_truth(spark, d))
    sinks.json_file(sinks.metrics_document(E.micro_macro(per_class), per_class), path)
    return readers.metrics_json(spark, path).select("label", "n", F.round("top1", 6).alias("top1"))


@query("SELECT r_name AS config, n AS run FROM region, (VALUES (1), (2)) t(n)")
def run_log(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "runs")
    for n in (1, 2):
        sinks.append_run(table(spark, d, "region").select(F.col("r_name").alias("config"), F.lit(n).alias("run")), path)
    return spark.read.parquet(path)


def _objects(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """Benchmark texts as files of a store, a folder a group: (what was put, where)."""
    root = new_folder(spark, "objects")
    name = F.concat_ws("/", F.concat(F.lit("g"), (F.col("item_id") % 3).cast("string")), F.concat(F.col("item_id").cast("string"), F.lit(".png")))
    rows = table(spark, d, "benchmark").select("item_id", name.alias("key"), F.encode("text", "UTF-8").alias("content"))
    sinks.put_objects(rows, root)
    return rows, root


@query("SELECT item_id, sha256(text) AS sha256 FROM benchmark UNION ALL SELECT -1, NULL")
def object_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Objects put and got by URI; one that is not there gives null."""
    rows, root = _objects(spark, d)
    wanted = rows.select("item_id", F.concat(F.lit(root + "/"), "key").alias("uri")).union(spark.range(1).select(F.lit(-1), F.lit(f"{root}/none.png")))
    return readers.get_objects(wanted).select("item_id", F.sha2("content", 256).alias("sha256"))


@query("SELECT item_id, sha256(text) AS sha256 FROM benchmark")
def downloads(spark: SparkSession, d: str) -> DataFrame:
    """Downloaded by URL with their digests; rows whose download fails go."""
    rows, root = _objects(spark, d)
    wanted = rows.select("item_id", F.concat(F.lit(root + "/"), "key").alias("url")).union(spark.range(1).select(F.lit(-1), F.lit(f"{root}/none.png")))
    return rest.downloaded(wanted, tries=1).where("content is not null").select("item_id", "sha256")


@query("""SELECT 'g' || item_id % 3 AS slug, (item_id % 3)::INTEGER AS label, item_id::VARCHAR AS photo_id, CASE WHEN item_id % 2 = 0 THEN 'val' END AS split, item_id % 4 = 0 AS found FROM benchmark""")
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows with their files; three of four rows name a file that is not there."""
    rows, root = _objects(spark, d)
    path = new_folder(spark, "manifest")
    n = F.col("item_id")
    photo = F.when(n % 4 == 0, n.cast("string")).otherwise(F.concat(F.lit("no"), n.cast("string")))
    listed = rows.select(F.substring_index("key", "/", 1).alias("slug"), photo.alias("photo_id"), F.when(n % 2 == 0, "val").alias("split"))
    sinks.csv_file(listed, path)
    found, missing = readers.csv_manifest(spark, path, root)
    at = F.regexp_extract("storage_path", r"([^/]+)\.png$", 1)
    there = found.select("slug", F.col("label").cast("int").alias("label"), at.alias("photo_id"), "split", F.lit(True).alias("found"))
    gone = missing.select("slug", F.substring("slug", 2, 9).cast("int").alias("label"), F.substring("photo_id", 3, 9).alias("photo_id"), F.when(F.substring("photo_id", 3, 9).cast("int") % 2 == 0, "val").alias("split"), F.lit(False).alias("found"))
    return there.union(gone)


@query("SELECT 'g' || item_id % 3 AS slug, (item_id % 3)::BIGINT AS label, count(*) AS n, min(sha256(text)) AS least FROM benchmark GROUP BY 1, 2")
def folder_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A folder of folders as a manifest, with digests of the inputs."""
    root = _objects(spark, d)[1]
    digests = I.provenance(readers.image_files(spark, root)).withColumnRenamed("path", "storage_path")
    samples = readers.manifest(spark, root=root).join(digests, "storage_path")
    return samples.groupBy("slug", F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"), F.min("sha256").alias("least"))


@query(f"""WITH {SIMS}, {OBSERVATIONS},
ccells AS (SELECT DISTINCT (user_id % 10)::INTEGER AS class_idx, floor(lat)::BIGINT AS clat, floor(lon)::BIGINT AS clon FROM obs WHERE lat IS NOT NULL),
spot AS (SELECT v.vec_id AS query_id, o.lat, o.lon FROM embeddings v JOIN obs o ON o.event_id = v.vec_id WHERE v.vec_id % 5 = 0 AND o.lat IS NOT NULL),
hit AS (SELECT DISTINCT a.query_id, c.class_idx FROM spot a JOIN ccells c ON abs(c.clat - floor(a.lat)) <= 1 AND abs(c.clon - floor(a.lon)) <= 1),
g AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY sim + CASE WHEN h.class_idx IS NOT NULL THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END DESC, s.class_idx) AS rank FROM sims s LEFT JOIN hit h ON s.query_id = h.query_id AND s.class_idx = h.class_idx)
SELECT g.query_id, string_agg(n_name, ',' ORDER BY rank) AS names, min(round(sim, 4)) + 0 AS least, g.query_id IN (SELECT query_id FROM spot) AS geo_filtered FROM g JOIN nation ON class_idx = n_nationkey WHERE rank <= 3 GROUP BY 1""")
def response_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole answers as JSON, read again."""
    species = table(spark, d, "nation").select(F.col("n_nationkey").alias("class_idx"), F.col("n_name").alias("species_name"), F.lit(None).cast("string").alias("common_name"), F.col("n_regionkey").alias("taxon_id"))
    said = R.response(reranked(spark, d), species)
    a = said.select("query_id", F.from_json("response", "results array<struct<rank:int,species_name:string,similarity:double>>, inference_ms long, geo_filtered boolean").alias("a"))
    return a.select("query_id", F.array_join("a.results.species_name", ",").alias("names"), F.array_min("a.results.similarity").alias("least"), "a.geo_filtered")


#: Pictures a task.
_PICTURES = 5000


def _dealt(spark: SparkSession, d: str) -> DataFrame:
    """Keys and sizes of parts, dealt out by their number: they are few bytes, but what is made of
    them is much work, so files and their splits would give it to one task."""
    parts = table(spark, d, "part").select("p_partkey", "p_size")
    return parts.repartition(max(spark.sparkContext.defaultParallelism, -(-parts.count() // _PICTURES)), "p_partkey")


def _png(pixels: np.ndarray, extra: bytes = b"") -> bytes:
    """A grey picture as a PNG file; ``extra`` are chunks between the pixels and the end."""
    h, w = pixels.shape
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    rows = np.hstack([np.zeros((h, 1), np.uint8), pixels]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows)) + extra + _chunk(b"IEND", b"")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


#: What each sample of n weighs in sample o of 4, by a triangle as wide as the shrinking, in 22 binary digits.
_SHRUNK = """dims AS (SELECT DISTINCT unnest([8 + p_size, 58 - p_size]) AS n FROM part),
taps AS (SELECT n, o, i, greatest(0, 1 - abs((i + 0.5::DOUBLE - (o + 0.5::DOUBLE) * n / 4) / (n / 4))) AS t FROM (SELECT n, o, unnest(range(n)) AS i FROM dims, (VALUES (0), (3)) v(o))
 WHERE i >= greatest(0, trunc((o + 0.5::DOUBLE) * n / 4 - n / 4 + 0.5)) AND i < trunc((o + 0.5::DOUBLE) * n / 4 + n / 4 + 0.5)),
weights AS (SELECT n, o, i, trunc(t / sum(t) OVER (PARTITION BY n, o) * 4194304 + 0.5) AS weight FROM taps),
across AS (SELECT p_partkey, height, o, y, floor((sum(((level * 31 + i * 17 + y * y * 13) % 256) * weight) + 2097152) / 4194304) AS v
 FROM (SELECT p_partkey, level, width, height, unnest(range(height)) AS y FROM p) JOIN weights ON n = width GROUP BY ALL),
shrunk AS (SELECT p_partkey, a.o, floor((sum(v * weight) + 2097152) / 4194304) AS v FROM across a JOIN weights w ON w.n = height AND w.i = y AND w.o = a.o GROUP BY 1, 2)"""


@query(f"""WITH p AS (SELECT p_partkey, 8 + p_size AS width, 58 - p_size AS height, p_partkey % 256 AS level, p_size % 10 = 0 AS broken FROM part),
s AS (SELECT *, CASE WHEN broken THEN 'corrupt' WHEN least(width, height) < 20 THEN 'too_small' ELSE 'ok' END AS base FROM p),
{_SHRUNK},
px AS (SELECT p_partkey, level, x, unnest(range(1, height - 1)) AS y FROM (SELECT p_partkey, level, height, unnest(range(1, width - 1)) AS x FROM p)),
lap AS (SELECT p_partkey, (level * 31 + (x - 1) * 17 + y * y * 13) % 256 + (level * 31 + (x + 1) * 17 + y * y * 13) % 256 + (level * 31 + x * 17 + (y - 1) * (y - 1) * 13) % 256 + (level * 31 + x * 17 + (y + 1) * (y + 1) * 13) % 256 - 4 * ((level * 31 + x * 17 + y * y * 13) % 256) AS l FROM px),
sharp AS (SELECT p_partkey, var_pop(l::DOUBLE) AS blur FROM lap GROUP BY 1)
SELECT s.p_partkey, CASE WHEN base = 'ok' AND row_number() OVER (PARTITION BY base, width, height, level ORDER BY s.p_partkey) > 1 THEN 'duplicate' ELSE base END AS status,
 CASE WHEN NOT broken THEN width END AS width, CASE WHEN NOT broken THEN height END AS height, CASE WHEN NOT broken THEN round(sharp.blur, 3) END AS blur,
 CASE WHEN NOT broken THEN round((a.v / 255 - 0.485::DOUBLE) / 0.229::DOUBLE, 3) + 0 END AS red, CASE WHEN NOT broken THEN round(2 * ((b.v / 255 - 0.406::DOUBLE) / 0.225::DOUBLE), 3) + 0 END AS embedded
FROM s JOIN shrunk a ON a.p_partkey = s.p_partkey AND a.o = 0 JOIN shrunk b ON b.p_partkey = s.p_partkey AND b.o = 3 JOIN sharp ON sharp.p_partkey = s.p_partkey""")
def image_functions(spark: SparkSession, d: str) -> DataFrame:
    """Patterned pictures, some of them broken: size, status, sharpness, network input, embedding."""
    ship(spark)

    @F.pandas_udf("binary")
    def picture(key: pd.Series, size: pd.Series) -> pd.Series:
        def made(k: int, n: int) -> bytes:
            y, x = np.ogrid[: 58 - n, : 8 + n]
            whole = _png(((k % 256 * 31 + x * 17 + y * y * 13) % 256).astype(np.uint8))
            return whole[: len(whole) // 2] if n % 10 == 0 else whole

        return pd.Series([made(k, n) for k, n in zip(key, size)])

    made = _dealt(spark, d).select("p_partkey", picture("p_partkey", "p_size").alias("content"))
    seen = made.withColumn("m", images.measured(4)("content"))
    seen = seen.withColumn("e", images.embedder(lambda: lambda x: 2 * x[-1:])("m.x"))
    sized = seen.select("p_partkey", F.md5("content").alias("h"), "m.width", "m.height", F.round("m.blur", 3).alias("blur"), F.round(F.get("m.x", F.lit(0)).cast("double"), 3).alias("red"), F.round(F.get("e", F.lit(0)).cast("double"), 3).alias("embedded"))
    return C.image_status(stored(sized, "measured"), 20, "h", "p_partkey").drop("h")  # read twice, made once


def _container(kind: int, width: int, height: int, exif: bool, stray: bool, broken: bool) -> bytes:
    """A file of parts: JPEG, PNG, or one of three kinds of WebP.  EXIF comes after 70 kB of other
    parts; a stray one is text where no EXIF belongs."""
    tags = b"MM\0*" + struct.pack(">IHHHII", 8, 1, 0x0112, 3, 1, 1 << 16) + b"\0\0\0\0"
    text = b"Exif\0\0eXIf" + tags if stray else b"no such thing"
    if kind == 0:
        part = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
        data = b"\xff\xd8" + part(0xE0, b"JFIF\0") + part(0xFE, text) + 2 * part(0xE2, bytes(35_000)) + (part(0xE1, b"Exif\0\0" + tags) if exif else b"")
        data += part(0xC2, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0") + part(0xDA, b"\1\1\0\0\0\0") + text + b"\xff\xd9"
    elif kind == 1:
        data = _png(np.zeros((height, width), np.uint8), _chunk(b"tEXt", text + bytes(70_000)) + (_chunk(b"eXIf", tags) if exif else b""))
    else:
        part = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
        lossy = part(b"VP8 ", b"\x30\1\0\x9d\1\x2a" + struct.pack("<HH", width, height) + text)
        lossless = part(b"VP8L", b"\x2f" + struct.pack("<I", width - 1 | height - 1 << 14) + text)
        extended = part(b"VP8X", bytes([8 * exif, 0, 0, 0]) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little"))
        body = {2: lossy, 3: lossless, 4: extended + part(b"ICCP", bytes(70_001)) + lossless}[kind] + (part(b"EXIF", tags) if exif else b"")
        data = b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body
    return data[: len(data) // 2] if broken else data


@query("""SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN 8 + p_size END AS width, CASE WHEN p_size % 7 > 0 THEN 70 - p_size END AS height, CASE WHEN p_size % 7 > 0 THEN p_partkey % 3 = 0 END AS has_exif FROM part""")
def image_containers(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and EXIF flags of JPEG, PNG and WebP files by their parts; some are cut off."""
    ship(spark)

    @F.pandas_udf("binary")
    def made(key: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([_container(k % 5, 8 + n, 70 - n, k % 3 == 0, k % 2 == 0, n % 7 == 0) for k, n in zip(key.tolist(), size.tolist())])

    files = _dealt(spark, d).select("p_partkey", made("p_partkey", "p_size").alias("content"))
    return files.select("p_partkey", images.container_info("content").alias("m")).select("p_partkey", "m.*")


@query("SELECT n_name AS value FROM nation")
def staged_file(spark: SparkSession, d: str) -> DataFrame:
    """A file staged twice: the second time it is there and is used as it is."""
    source, target = new_folder(spark, "source"), new_folder(spark, "staged")
    table(spark, d, "nation").select("n_name").coalesce(1).write.text(source)
    for _ in range(2):
        readers.staged(spark, source, target)
    return spark.read.text(target)


@query("""SELECT count(*) = count(DISTINCT n_name) AND count(*) = count(DISTINCT n_nationkey) AS whole, count(*) AS n FROM nation""")
def artifact_checks(spark: SparkSession, d: str) -> DataFrame:
    """Paths, required columns and equal sizes; any problem raises."""
    nation = table(spark, d, "nation")
    I.require_paths(spark, f"{d}/nation.parquet", f"{d}/region.parquet")
    I.require_columns(nation, ("n_nationkey", "n_name"))
    I.require_same_size(nation, nation.select("n_name").distinct(), "nations and their names")
    I.require(I.duplicates(nation, "n_nationkey"), "nation keys")
    return nation.agg(F.lit(True).alias("whole"), F.count("*").alias("n"))


@query("""SELECT 'path' AS what, n_name AS name, NULL::BIGINT AS n FROM nation WHERE n_regionkey % 2 = 0
UNION ALL SELECT 'column', n_name, NULL FROM nation WHERE n_regionkey > 2
UNION ALL SELECT 'size', 'orders and customers', (SELECT count(*) FROM orders) - (SELECT count(*) FROM customer)
UNION ALL SELECT 'duplicate', n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2 HAVING count(*) > 1""")
def artifact_problems(spark: SparkSession, d: str) -> DataFrame:
    """What checks of artifacts find: files and columns that are not there, sizes and keys that do not agree."""
    nation, customer, root = table(spark, d, "nation"), table(spark, d, "customer"), new_folder(spark, "artifacts")
    sinks.put_objects(nation.where("n_regionkey % 2 = 1").select(F.concat("n_name", F.lit(".json")).alias("key"), F.encode("n_name", "UTF-8").alias("content")), root)
    names = [r["n_name"] for r in nation.select("n_name").collect()]  # 25 artifacts
    paths = I.missing_paths(spark, *[f"{root}/{n}.json" for n in names])
    wide = nation.where("n_regionkey <= 2").groupBy().pivot("n_name").agg(F.count(F.lit(1)))
    sizes = I.different_sizes(table(spark, d, "orders"), customer)
    rows = [("path", p.rpartition("/")[2].removesuffix(".json"), None) for p in paths] + [("column", c, None) for c in I.missing_columns(wide, names)]
    rows += [("size", "orders and customers", sizes[0] - sizes[1])] if sizes else []
    found = I.duplicates(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "n_name")
    return spark.createDataFrame(rows, "what string, name string, n long").union(found.select(F.lit("duplicate"), "n_name", "n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name,
 CASE WHEN c_custkey % 2 > 0 THEN nullif(c_nationkey, 3) WHEN c_custkey % 3 = 0 THEN nullif(c_nationkey, 5) ELSE coalesce(nullif(c_nationkey, 5), nullif(c_nationkey, 3)) END AS c_nationkey FROM customer WHERE c_custkey % 3 > 0 OR c_custkey % 2 = 0
UNION ALL SELECT -c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 7 = 0 AND c_custkey > 0""")
def keyed_table(spark: SparkSession, d: str) -> DataFrame:
    """A table by key after an upsert and an insert that ignores known keys, each into its buckets only."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    first = c.where("c_custkey % 3 > 0").withColumn("c_nationkey", F.nullif("c_nationkey", F.lit(3)))
    stored = KeyedTable.create(first, new_folder(spark, "keyed"), "c_custkey", 16)
    incoming = c.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), F.nullif("c_nationkey", F.lit(5)).alias("c_nationkey"), F.lit(1).alias("ord"))
    stored = stored.upsert(incoming, ("c_nationkey",), "ord")
    more = c.where("c_custkey % 7 = 0").withColumn("c_custkey", -F.col("c_custkey")).union(c.where("c_custkey % 3 > 0").withColumn("c_name", F.lit("ignored")))
    return stored.insert_ignore(more, "c_name").read()


@query("""WITH e AS (SELECT event_type, user_id % 40 AS user, row_number() OVER (ORDER BY event_id * 7919 % 10007, event_id) AS place FROM events)
SELECT user, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, min(place) LIMIT 15""")
def top_taxa_as_seen(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent of a file's values; ties by where the file has them first."""
    path = new_folder(spark, "scan")
    e = F.col("event_id")
    table(spark, d, "events").select((e * 7919 % 10007).alias("o"), "event_id", (F.col("user_id") % 40).alias("user")).repartition(1).sortWithinPartitions("o", "event_id").select("user").write.csv(path, sep="\t", header=True)
    scanned = readers.with_scan_order(spark.read.csv(path, sep="\t", header=True, schema="user long"))
    return C.top_first_seen(scanned, "user", "scan", 15)


@query("""SELECT batch, count(*) AS n, min(place) AS low, max(place) AS high, count(DISTINCT place) AS places FROM
 (SELECT unnest(range((SELECT count(*) FROM documents))) AS i) t, LATERAL (SELECT i // 32 AS batch, i % 32 AS place) WHERE batch >= 3 GROUP BY 1""")
def epoch_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of an epoch that goes on at its fourth: each place of each batch is taken once."""
    docs = readers.numbered_samples(table(spark, d, "documents").select(F.format_string("%012d", "doc_id").alias("storage_path")))
    batches = readers.epoch(docs, docs.count(), 42, 1, 32, first_batch=3)
    return batches.groupBy("batch").agg(F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"), F.count_distinct("place").alias("places"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
def photos_of_kept(spark: SparkSession, d: str) -> DataFrame:
    """A large side filtered by a bitmap of the kept keys before it is shuffled."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    kept = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    return C.photos_of_kept(lines, kept, "l_orderkey", "o_orderkey").drop("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def bucketed_join(spark: SparkSession, d: str) -> DataFrame:
    """Both sides stored in buckets of the key, so their join shuffles nothing."""
    tag = uuid.uuid4().hex
    lines = sinks.by_key(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), f"lines_{tag}", new_folder(spark, "lines"), "l_orderkey", 8)
    orders = sinks.by_key(table(spark, d, "orders").select("o_orderkey", "o_custkey"), f"orders_{tag}", new_folder(spark, "orders"), "o_orderkey", 8)
    return C.photos_of(lines, orders, "l_orderkey", "o_orderkey").drop("o_orderkey")


#: Rows a database file.
_STORED = 500_000


@query("""SELECT 'img/' || l_orderkey || '/' || l_linenumber AS storage_path, dense_rank() OVER (ORDER BY p_name) - 1 AS label, p_name AS slug, CASE WHEN l_linestatus = 'F' THEN 'val' END AS split, l_quantity AS lat, NULL::DOUBLE AS lon
FROM lineitem JOIN (SELECT p_partkey, p_name FROM part) ON l_partkey = p_partkey""")
def database_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Samples of the image and species tables of a database, which is kept in files of key ranges.

    The files stand in for a server (``readers.jdbc_table``): executors have no JVM or memory in common,
    so a database embedded in one of them is not there for the others.
    """
    root = new_folder(spark, "database")
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    path = F.concat_ws("/", F.lit("img"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    put = line.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("species_id"), path.alias("storage_path"), F.when(F.col("l_linestatus") == "F", "val").otherwise("").alias("split"), F.col("l_quantity").cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    files = lambda df: max(spark.sparkContext.defaultParallelism, -(-df.count() // _STORED))
    sinks.sqlite_files(put, f"{root}/images", "images", ["id", "storage_path"], files(line))
    sinks.sqlite_files(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("slug")), f"{root}/species", "species", ["id"], files(part))
    images_read = readers.sqlite_table(spark, f"{root}/images", "images", "id long, species_id long, storage_path string, split string, lat double, lon double").withColumn("split", F.nullif("split", F.lit("")))
    found = images_read, readers.sqlite_table(spark, f"{root}/species", "species", "id long, slug string")
    return readers.manifest(spark, database=found, csv="not read", root="nor this").withColumn("label", F.col("label").cast("long"))


@query("""WITH p AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS problems, least(count(*), 50) AS shown FROM p""")
def reported_problems(spark: SparkSession, d: str) -> DataFrame:
    """What a failing check says: how many problems there are, and the first fifty."""
    try:
        I.require(I.duplicates(table(spark, d, "lineitem"), "l_orderkey"), "line keys")
        said = "line keys: 0 problems"
    except ValueError as e:
        said = str(e)
    rows = [(int(said.split(": ")[1].split()[0]), said.count("Row("))]
    return spark.createDataFrame(rows, "problems long, shown long")
