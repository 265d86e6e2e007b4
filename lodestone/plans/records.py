"""Queries over single records: names, nested documents, checks; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import curate as C
from lodestone.operators import integrity as I
from lodestone.plans.base import OBSERVATIONS, observations, query, table
from lodestone.sources import readers


def _taxa(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("p_size") % 2 == 0, "species").otherwise("genus")
    return table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("taxon_id"), rank.alias("rank"), "p_size")


@query("""WITH t AS (SELECT DISTINCT upper(p_name) AS name FROM part UNION SELECT 'no such name')
SELECT t.name, f.taxon_id FROM t LEFT JOIN (SELECT lower(p_name) AS k, p_partkey AS taxon_id FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_size, p_partkey) = 1) f ON lower(t.name) = f.k""")
def name_first_match(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.upper("p_name").alias("name")).union(spark.range(1).select(F.lit("no such name"))).distinct()
    return C.name_lookup(names, _taxa(spark, d), ["p_size", "taxon_id"])


@query("""WITH t AS (SELECT DISTINCT CASE WHEN p_size = 7 THEN upper(p_name) ELSE p_name END AS name FROM part WHERE p_size < 9)
SELECT t.name, p_partkey AS taxon_id FROM t JOIN part ON t.name = p_name WHERE p_size % 2 = 0""")
def name_species_ids(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").where("p_size < 9").select(F.when(F.col("p_size") == 7, F.upper("p_name")).otherwise(F.col("p_name")).alias("name")).distinct()
    return C.species_ids(names, _taxa(spark, d))


@query("""WITH c AS (SELECT c_mktsegment AS query, c_custkey AS taxon_id, CASE WHEN c_custkey % 7 = 0 THEN lower(c_mktsegment) ELSE c_name END AS name FROM customer)
SELECT t.query, coalesce(min_by(taxon_id, taxon_id) FILTER (lower(name) = lower(c.query)), min_by(taxon_id, taxon_id)) AS taxon_id
FROM (SELECT DISTINCT c_mktsegment AS query FROM customer UNION SELECT 'none') t LEFT JOIN c ON t.query = c.query GROUP BY 1""")
def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 7 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_name"))
    candidates = c.select(F.col("c_mktsegment").alias("query"), F.col("c_custkey").alias("taxon_id"), name.alias("name"))
    targets = c.select(F.col("c_mktsegment").alias("query")).union(spark.range(1).select(F.lit("none"))).distinct()
    return C.resolve_taxon(targets, candidates, "taxon_id")


def _with_photos(spark: SparkSession, d: str) -> DataFrame:
    """Events with none, a whole, a broken or two photos."""
    e = F.col("event_id")
    kind = "array<struct<id:bigint,url:string>>"
    one = lambda i, u: F.struct(i.cast("long").alias("id"), u.alias("url"))
    url = F.concat(F.lit("http://h/square/"), e.cast("string"), F.lit(".jpg"))
    photos = F.when(e % 4 == 0, F.array().cast(kind)).when(e % 4 == 1, F.array(one(e, url))).when(e % 4 == 2, F.array(one(F.lit(None), url), one(e, url))).otherwise(F.array(one(e + 1, url), one(e, url)))
    return table(spark, d, "events").select("event_id", photos.alias("photos"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN event_id + 1 ELSE event_id END AS photo_id, 'http://h/medium/' || event_id || '.jpg' AS url FROM events WHERE event_id % 4 IN (1, 3)""")
def first_photo(spark: SparkSession, d: str) -> DataFrame:
    return C.first_photo(_with_photos(spark, d)).select("event_id", "photo_id", X.resize_url(F.col("photo_url")).alias("url"))


@query("""SELECT p_partkey FROM part WHERE p_size % 3 = 0 OR (p_size % 3 = 1 AND p_size % 2 = 0)""")
def still_images(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    media = table(spark, d, "part").select("p_partkey", F.when(n % 3 == 0, "StillImage").when(n % 3 == 1, "Sound").alias("type"), F.when((n % 3 == 1) & (n % 2 == 0), "image/jpeg").when(n % 3 == 1, "audio/mpeg").alias("format"))
    return C.still_images(media).select("p_partkey")


@query("SELECT o_orderkey, o_custkey AS usage_key FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'")
def matched_keys(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "P", "NONE").when(F.col("o_orderpriority") != "5-LOW", "EXACT")
    return table(spark, d, "orders").where(C.matched(kind)).select("o_orderkey", F.col("o_custkey").alias("usage_key"))


@query("""SELECT event_id, CASE WHEN event_id % 5 NOT IN (0, 1, 2) THEN event_id / 8.0::DOUBLE END AS lat, CASE WHEN event_id % 5 NOT IN (0, 1, 2) THEN -event_id / 4.0::DOUBLE END AS lon FROM events""")
def parse_location(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    text = F.concat((e / 8.0).cast("string"), F.lit(","), (-e / 4.0).cast("string"))
    place = F.when(e % 5 == 0, F.lit("1.5")).when(e % 5 == 1, F.concat(text, F.lit(",1"))).when(e % 5 == 2, F.concat(F.lit("x"), text)).otherwise(text)
    p = X.parse_location(place)
    return table(spark, d, "events").select("event_id", p["lat"].alias("lat"), p["lon"].alias("lon"))


@query("""WITH s AS (SELECT s_suppkey, s_name, CASE s_suppkey % 3 WHEN 0 THEN 'gs' WHEN 1 THEN 's3' ELSE 's3a' END AS scheme FROM supplier)
SELECT s_suppkey, CASE WHEN scheme = 'gs' THEN 'gcs' ELSE 's3' END AS backend, 'b' || s_suppkey % 7 AS bucket, 'img/' || s_suppkey % 7 || '/' || s_suppkey || '.png' AS object_key,
 s_suppkey % 7 || '/photo.' || s_suppkey AS sample_key, printf('antweb_%03d.jpg', s_suppkey) AS numbered FROM s""")
def uris_and_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    slug = (k % 7).cast("string")
    uri = F.concat(F.when(k % 3 == 0, "gs").when(k % 3 == 1, "s3").otherwise("s3a"), F.lit("://b"), slug, F.lit("/photo."), k.cast("string"), F.lit(".png"))
    return table(spark, d, "supplier").select("s_suppkey", X.uri_backend(uri).alias("backend"), X.uri_bucket(uri).alias("bucket"), X.object_key(slug, k, F.lit("png"), "/img/").alias("object_key"), X.sample_key(slug, uri).alias("sample_key"), X.numbered_name("antweb", k).alias("numbered"))


@query("""SELECT n_nationkey, greatest(1, ceil(100 / n_nationkey::DOUBLE))::BIGINT AS quota, round(100 * n_regionkey / n_nationkey::DOUBLE, 2) AS share,
 CASE n_regionkey WHEN 0 THEN 'The image could not be read. Try another photo.' WHEN 1 THEN 'The service is starting. Try again shortly.' WHEN 2 THEN 'The service failed with status 500.' ELSE 'No connection to the service.' END AS said FROM nation WHERE n_nationkey > 0""")
def quotas_and_messages(spark: SparkSession, d: str) -> DataFrame:
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    status = F.when(r == 0, 422).when(r == 1, 503).when(r == 2, 500)
    return table(spark, d, "nation").where("n_nationkey > 0").select("n_nationkey", X.quota(F.lit(100), n).alias("quota"), X.percentage(r, n).alias("share"), X.status_message(status).alias("said"))


@query("SELECT d.doc_id, source FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def pinned_split(spark: SparkSession, d: str) -> DataFrame:
    return C.pinned(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").where("toxic = 1"), "doc_id")


@query("SELECT vec_id, label FROM embeddings WHERE label NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)")
def label_domain(spark: SparkSession, d: str) -> DataFrame:
    domain = table(spark, d, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("label"))
    return I.unknown_labels(table(spark, d, "embeddings").select("vec_id", "label"), domain, "label").select("vec_id", "label")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_of_rows(spark: SparkSession, d: str) -> DataFrame:
    return C.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 40, 20)


@query(f"""WITH {OBSERVATIONS}, u AS (SELECT event_id, lat * 6 AS lat, lon * 7 AS lon, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'text/html' ELSE 'image/png' END AS kind, event_id % 11 = 0 AS bare, event_id % 13 = 0 AS broken FROM obs)
SELECT event_id, CASE WHEN abs(lat) > 90 OR abs(lon) > 180 THEN 'out_of_bounds' WHEN kind = 'text/html' THEN 'not_an_image' WHEN bare THEN 'empty' ELSE 'undecodable' END AS reason
FROM u WHERE abs(lat) > 90 OR abs(lon) > 180 OR kind = 'text/html' OR bare OR broken""")
def request_problems(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.when(e % 6 == 1, "text/html").when(e % 6 > 1, "image/png")
    up = observations(spark, d).select("event_id", (F.col("lat") * 6).alias("lat"), (F.col("lon") * 7).alias("lon"), kind.alias("content_type"), F.when(e % 11 == 0, F.lit(b"")).otherwise(F.lit(b"x")).alias("content"), F.when(e % 13 > 0, 8).alias("width"))
    return I.request_problems(up, "width").select("event_id", "reason")


@query("""WITH e AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'a' ELSE 'b' END AS digest FROM part),
f AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'GIF' ELSE 'JPG' END AS extension, 'b' AS digest FROM part WHERE p_size % 11 > 0 UNION ALL SELECT p_partkey, 'png', 'b' FROM part WHERE p_size % 3 = 0),
n AS (SELECT p_partkey, count(*) AS n, min(lower(extension)) AS x, min(digest) AS h FROM f GROUP BY 1)
SELECT e.p_partkey, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN x = 'gif' THEN 'wrong_extension' ELSE 'hash_mismatch' END AS problem
FROM e LEFT JOIN n ON e.p_partkey = n.p_partkey WHERE n IS NULL OR n > 1 OR x = 'gif' OR h <> digest""")
def frozen_file_problems(spark: SparkSession, d: str) -> DataFrame:
    part, n = table(spark, d, "part"), F.col("p_size")
    expected = part.select("p_partkey", F.when(n % 5 == 0, "a").otherwise("b").alias("digest"))
    files = part.where(n % 11 > 0).select("p_partkey", F.when(n % 7 == 0, "GIF").otherwise("JPG").alias("extension"), F.lit("b").alias("digest"))
    files = files.union(part.where(n % 3 == 0).select("p_partkey", F.lit("png"), F.lit("b")))
    return I.file_problems(expected, files, ["p_partkey"], "digest")


@query("""SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'ambiguous' WHEN p_size % 7 = 0 THEN 'not_found' WHEN p_size % 5 = 0 THEN 'no_photo' WHEN p_size % 3 = 0 THEN 'no_content' WHEN p_size % 2 = 0 THEN 'hash_mismatch' END AS error FROM part""")
def restore_errors(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    part = table(spark, d, "part")
    found = part.where((n % 7 > 0) | (n % 11 == 0)).select("p_partkey", F.when(n % 11 == 0, 2).alias("n_files"), F.when(n % 5 > 0, "u").alias("url"), F.when(n % 3 > 0, n % 2).alias("digest"))
    return I.restored(part.select("p_partkey", F.lit(1).alias("digest")), found, "p_partkey", "digest").select("p_partkey", "error")


@query("""SELECT 'price ' || l_orderkey || '/' || l_linenumber AS identifier, l_returnflag AS license, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2""")
def occurrence_media(spark: SparkSession, d: str) -> DataFrame:
    """Occurrence pages made of each order's lines, and read again."""
    line = F.struct(F.concat(F.lit("price "), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("identifier"), F.when(F.col("l_linestatus") == "F", "StillImage").otherwise("Sound").alias("type"), F.col("l_returnflag").alias("license"))
    pages = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("media"))
    text = pages.select(F.to_json(F.struct(F.array(F.struct("media")).alias("results"), F.lit(True).alias("endOfRecords"))).alias("value"))
    return C.still_images(readers.occurrences_json(text)).groupBy("identifier", "license").agg(F.count("*").alias("n"))


@query("""SELECT 'u' || event_id AS uuid, event_type AS name, user_id::INTEGER AS taxon_id, CASE WHEN event_id % 3 > 0 THEN event_id / 8.0::DOUBLE END AS lat, CASE WHEN event_id % 3 > 0 THEN 1.5::DOUBLE END AS lon, CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 4 = 1 THEN 1 ELSE 2 END AS n_photos FROM events""")
def observation_documents(spark: SparkSession, d: str) -> DataFrame:
    """Observation documents made of events, and read again."""
    e = F.col("event_id")
    place = F.when(e % 3 > 0, F.concat((e / 8.0).cast("string"), F.lit(",1.5"))).otherwise(F.lit("nowhere"))
    taxon = F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("name"), F.lit("species").alias("rank"))
    docs = table(spark, d, "events").join(_with_photos(spark, d), "event_id")
    text = docs.select(F.to_json(F.struct(F.concat(F.lit("u"), e.cast("string")).alias("uuid"), place.alias("location"), taxon.alias("taxon"), "photos")).alias("value"))
    return readers.observations_json(text).select("uuid", "name", "taxon_id", "lat", "lon", F.size("photos").alias("n_photos"))


#: Specimen payloads of several shapes; ``@`` stands for the page's id.
_PAYLOADS = (
    '{"specimenImages": [{"shotType": "H", "image": "u@a"}, {"shot_type": "x", "url": "u@b"}, {"shotType": "p", "imageURL": "u@a"}, {"url": "u@c"}]}',
    '{"images": {"2": {"image": {"low": "u@l", "original": "u@o", "high": "u@g"}}, "10": {"shot_type": "d", "image": {"low": "u@l", "high": "u@h"}}, "1": 7}}',
    '{"specimenImages": [], "images": [{"originalThumbnailUrl": "u@t"}, "text", {"image": {"small": "u@s", "large": "u@z"}, "shotType": null}]}',
    '{"specimenImages": null, "images": "none"}',
    "no document",
    '{"images": [{"url": "", "image": {}}, {"url": "u@v", "shotType": "D"}, 3, null]}',
)


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    shape = F.element_at(F.array(*[F.lit(p) for p in _PAYLOADS]), (F.col("page_id") % len(_PAYLOADS) + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", F.replace(shape, F.lit("@"), F.col("page_id").cast("string")).alias("value"))


@query("""SELECT page_id, s.position::INTEGER AS position, s.shot AS shot_type, 'u' || page_id || s.suffix AS url FROM pages JOIN (VALUES
 (0, 0, 'h', 'a'), (0, 1, 'x', 'b'), (0, 2, 'p', 'a'), (0, 3, '', 'c'), (1, 0, '', 'o'), (1, 1, 'd', 'h'), (2, 0, '', 't'), (2, 1, '', 's'), (5, 0, 'd', 'v')) s(shape, position, shot, suffix) ON page_id % 6 = s.shape""")
def specimen_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every image of payloads of several shapes; some hold none."""
    return readers.specimens_json(_payloads(spark, d)).drop("value")


@query("""SELECT page_id, s.position::INTEGER AS position, 'u' || page_id || s.suffix AS url FROM pages JOIN (VALUES
 (0, 0, 'a'), (0, 1, 'b'), (1, 0, 'h'), (1, 1, 'o'), (2, 0, 't'), (2, 1, 's'), (5, 0, 'v')) s(shape, position, suffix) ON page_id % 6 = s.shape""")
def specimen_images(spark: SparkSession, d: str) -> DataFrame:
    """The first two images of each payload: heads and dorsal views first, every URL once."""
    return readers.specimen_images(_payloads(spark, d), (" H", "d"), 2).drop("value")


@query("""WITH b AS (SELECT doc_id, md5(text) AS h, lang = 'en' AS exif, CASE WHEN lang IS NULL THEN 'corrupt' WHEN n_chars < 500 THEN 'too_small' ELSE 'ok' END AS s FROM documents),
c AS (SELECT exif, CASE WHEN s = 'ok' AND row_number() OVER (PARTITION BY h, s ORDER BY doc_id) > 1 THEN 'duplicate' ELSE s END AS status FROM b)
SELECT status, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 'no_exif', count(*) FROM c WHERE status = 'ok' AND NOT coalesce(exif, false)""")
def clean_report_counts(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("lang").isNotNull(), F.col("n_chars"))
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), size.alias("width"), size.alias("height"), (F.col("lang") == "en").alias("has_exif"))
    return C.status_counts(C.image_status(docs, 500, "h", "doc_id"))


@query("""WITH g AS (SELECT n_nationkey, n_name AS slug FROM nation UNION ALL SELECT -1, 'nowhere')
SELECT slug, count(c_custkey) AS n FROM g LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1 HAVING count(c_custkey) < (SELECT count(*) // 25 FROM customer)""")
def shortfall_of_every_group(spark: SparkSession, d: str) -> DataFrame:
    """Nations with fewer customers than the mean, and a group that has none."""
    customer = table(spark, d, "customer")
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("slug")).union(spark.range(1).select(F.lit(-1), F.lit("nowhere")))
    return C.shortfall(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "slug", customer.count() // 25, nation)


@query("""WITH a AS (SELECT p_name AS slug, dense_rank() OVER (ORDER BY p_name) AS i FROM part), b AS (SELECT p_name AS slug, dense_rank() OVER (ORDER BY p_name) AS i FROM part WHERE p_name < 'small')
SELECT 'all' AS other, (SELECT count(*) FROM (SELECT DISTINCT * FROM a EXCEPT SELECT DISTINCT * FROM a)) = 0 AS same UNION ALL
SELECT 'some', (SELECT count(*) FROM (SELECT DISTINCT * FROM a EXCEPT SELECT DISTINCT * FROM b)) = 0 AND (SELECT count(*) FROM (SELECT DISTINCT * FROM b EXCEPT SELECT DISTINCT * FROM a)) = 0""")
def taxonomy_order(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumnRenamed("p_name", "slug")
    same = lambda other: I.same_order(C.class_index(part), C.class_index(other), "slug", "class_idx")
    return spark.createDataFrame([("all", same(part.repartition(3))), ("some", same(part.where("slug < 'small'")))], "other string, same boolean")
