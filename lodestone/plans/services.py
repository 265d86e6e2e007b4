"""Queries of paged services, for which files in the shared folder stand in, and their SQL.

A page is a file whose name is the request's path and parameters; ``file:`` URLs read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import curate as C
from lodestone.plans.base import query, table
from lodestone.sources import readers, rest, sinks
from lodestone.storage import new_folder

#: Rows a page.
_SIZE = 40
_PHOTOS = "array<struct<id:bigint,url:string>>"
_RESEARCH = "quality_grade=research&photos=true&order_by=created_at"


def _put_pages(docs: DataFrame, order: str, name, root: str, size: int = _SIZE, last=lambda n, size, rows: F.lit(None).cast("boolean"), newest: bool = False) -> None:
    """Writes ``docs`` (key, doc) as pages of ``size``, and an empty page after each key's last.

    Keys are few and have very many rows each, so no step is by key alone.
    """
    ordered = docs.withColumn("_order", -F.col(order) if newest else F.col(order))
    numbered = C.place_in_group(ordered, "key", "_order", "place").select("key", F.floor(F.col("place") / size).alias("page"), "place", "doc")
    pages = numbered.groupBy("key", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc"))), lambda s: s["doc"]).alias("results"))
    after = numbered.groupBy("key").agg((F.max("page") + 1).alias("page")).withColumn("results", F.array().cast(pages.schema["results"].dataType))
    rows = pages.unionByName(after)
    body = F.to_json(F.struct("results", last(F.col("page"), size, F.size("results")).alias("endOfRecords")))
    sinks.put_objects(rows.select(name(F.col("key"), F.col("page")).alias("key"), F.encode(body, "UTF-8").alias("content")), root)


def _observations(spark: SparkSession, d: str, photo_id: Column) -> DataFrame:
    """Events as observations of eight taxa, with none, a whole, a broken or two photos."""
    e = F.col("event_id")
    one = lambda i, u: F.struct(i.cast("long").alias("id"), u.alias("url"))
    url = F.concat(F.lit("http://h/square/"), e.cast("string"), F.lit(".jpg"))
    photos = F.when(e % 4 == 0, F.array().cast(_PHOTOS)).when(e % 4 == 1, F.array(one(photo_id, url))).when(e % 4 == 2, F.array(one(F.lit(None), url), one(e, url))).otherwise(F.array(one(photo_id, url), one(e, url)))
    kind = F.when(e % 3 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), "event_type"))
    taxon = F.struct((F.col("user_id") % 5).cast("int").alias("id"), kind.alias("name"), F.when(e % 6 == 0, "genus").otherwise("species").alias("rank"))
    doc = F.struct(F.concat(F.lit("u"), e.cast("string")).alias("uuid"), F.lit("2026-01-01").alias("created_at"), taxon.alias("taxon"), photos.alias("photos"))
    return table(spark, d, "events").select("event_id", (F.col("user_id") % 8).alias("key"), doc.alias("doc"))


def _ask(order: str):
    return lambda key, page: F.concat(F.lit("observations?taxon_id="), key.cast("string"), F.lit(f"&{_RESEARCH}&order={order}&page="), (page + 1).cast("string"), F.lit(f"&per_page={_SIZE}"))


def _ask_since(key: Column, page: Column) -> Column:
    return F.concat(F.lit("observations?taxon_id="), key.cast("string"), F.lit(f"&{_RESEARCH}&order=asc&created_d1=2026-01-01&page="), (page + 1).cast("string"), F.lit(f"&per_page={_SIZE}"))


def _keys(docs: DataFrame) -> DataFrame:
    return docs.select("key").distinct()


def _first_photos(found: DataFrame) -> DataFrame:
    photos = C.first_photo(readers.observations_json(found).select("uuid", "photos"))
    return photos.select(F.substring("uuid", 2, 20).cast("long").alias("event_id"), F.col("photo_id").cast("long").alias("photo_id"))


#: Observations in the order of pages: ``place`` from 0, ``photo`` of the first photo.
_PAGES = """o AS (SELECT event_id, user_id % 8 AS key, event_type, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id {order}) - 1 AS place FROM events),
f AS (SELECT *, {photo} AS photo FROM o WHERE event_id % 4 IN ({kinds}) AND place < {rows})"""


@query(f"""WITH {_PAGES.format(order="DESC", photo="CASE WHEN event_id % 4 <> 2 THEN event_id // 8 END", kinds="1, 2, 3", rows=4 * _SIZE)}
SELECT key::VARCHAR AS key, event_id FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY key, photo ORDER BY place) = 1) QUALIFY row_number() OVER (PARTITION BY key ORDER BY place) <= 12""")
def newest_photos(spark: SparkSession, d: str) -> DataFrame:
    """The newest twelve observations of each taxon with a photo, each photo once."""
    docs, root = _observations(spark, d, F.floor(F.col("event_id") / 8)), new_folder(spark, "service")
    _put_pages(docs, "event_id", _ask("desc"), root, newest=True)
    found = rest.newest_observations(spark, f"{root}/observations", _keys(docs), target=12, pagesize=_SIZE, pause=0)
    return found.select("key", F.substring(F.get_json_object("value", "$.uuid"), 2, 20).cast("long").alias("event_id"))


@query(f"""WITH {_PAGES.format(order="", photo="event_id", kinds="1, 3", rows=3 * _SIZE)}
SELECT event_id, photo AS photo_id FROM (SELECT * FROM f WHERE photo NOT IN (SELECT s_suppkey FROM supplier)) QUALIFY row_number() OVER (PARTITION BY key ORDER BY place) <= 25""")
def photos_since(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 observations of each taxon whose photo is not excluded; keys come from a table."""
    docs, root = _observations(spark, d, F.col("event_id")), new_folder(spark, "service")
    _put_pages(docs, "event_id", _ask_since, root)
    excluded = table(spark, d, "supplier").select("s_suppkey")
    return _first_photos(rest.observations_since(spark, f"{root}/observations", _keys(docs), "2026-01-01", 25, pages=3, exclude_photos=excluded, pagesize=_SIZE, pause=0))


@query(f"""WITH {_PAGES.format(order="", photo="event_id", kinds="1, 3", rows=40 * _SIZE)},
a AS (SELECT * FROM f WHERE event_id % 6 <> 0 AND photo NOT IN (SELECT p_partkey FROM part) AND event_id NOT IN (SELECT event_id FROM events WHERE value > 100)),
c AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY key, event_type ORDER BY place) <= 4)
SELECT event_id, photo AS photo_id FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY place) <= 13""")
def diverse_photos(spark: SparkSession, d: str) -> DataFrame:
    """At most four a species and 13 a taxon, of observations that are not excluded."""
    docs, root = _observations(spark, d, F.col("event_id")), new_folder(spark, "service")
    _put_pages(docs, "event_id", _ask_since, root)
    excluded = table(spark, d, "part").select("p_partkey")
    uuids = table(spark, d, "events").where("value > 100").select(F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("uuid"))
    return _first_photos(rest.diverse_observations(spark, f"{root}/observations", _keys(docs), "2026-01-01", 13, cap=4, exclude_photos=excluded, exclude_uuids=uuids, pagesize=_SIZE, pause=0))


def _batches(rows: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(keys in order, rows with the request that asks for them)."""
    numbered = rows.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(key)) - 1) / n))  # a dimension of few rows
    asked = numbered.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key))), lambda s: s[key]).cast("array<string>"), ",").alias("key"))
    return rows.select(F.col(key).cast("string").alias("key"), F.col(key).alias("_by")).coalesce(1).sortWithinPartitions("_by").select("key"), numbered.join(asked, "batch")


@query("SELECT n_nationkey AS nation, n_name AS name FROM nation WHERE n_regionkey <> 2")
def frozen_observations(spark: SparkSession, d: str) -> DataFrame:
    """Exactly the wanted observations, four a request; those of one region are not there any more."""
    root = new_folder(spark, "service")
    keys, rows = _batches(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey", 4)
    there = rows.where("n_regionkey <> 2").groupBy("key").agg(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("uuid"), F.struct(F.col("n_name").alias("name")).alias("taxon"))).alias("results"))
    asked = rows.select("key").distinct().join(there, "key", "left").select("key", F.to_json(F.struct("results")).alias("body"))
    name = F.concat(F.lit("observations?uuid="), "key", F.lit("&page=1&per_page=4"))
    sinks.put_objects(asked.select(name.alias("key"), F.encode("body", "UTF-8").alias("content")), root)
    found = rest.observations_by_uuid(spark, f"{root}/observations", keys, batch=4, pause=0)
    return readers.observations_json(found).select(F.col("uuid").cast("long").alias("nation"), "name")


@query("SELECT n_nationkey AS taxon_id, lower(n_name) AS common_name FROM nation WHERE n_regionkey < 4")
def taxon_names(spark: SparkSession, d: str) -> DataFrame:
    """Common names of taxa, seven a request with their ids in its path; some have none."""
    root = new_folder(spark, "service")
    keys, rows = _batches(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey", 7)
    taxon = F.struct(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") < 4, F.lower("n_name")).alias("preferred_common_name"))
    asked = rows.groupBy("key").agg(F.to_json(F.struct(F.collect_list(taxon).alias("results"))).alias("body"))
    sinks.put_objects(asked.select(F.concat(F.lit("taxa/"), "key", F.lit("?page=1&per_page=200")).alias("key"), F.encode("body", "UTF-8").alias("content")), root)
    return rest.taxa_by_id(spark, f"{root}/taxa", keys, batch=7, pause=0)


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 5 AS key, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) - 1 AS place FROM orders)
SELECT 'm' || o_orderkey AS identifier, o_orderkey % 2 = 0 AS open FROM o WHERE place < 240 AND o_orderkey % 3 > 0""")
def occurrence_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first six pages of each key's occurrences by offset, and the still images among their media."""
    root, k = new_folder(spark, "service"), F.col("o_orderkey")
    media = F.struct(F.concat(F.lit("m"), k.cast("string")).alias("identifier"), F.when(k % 3 > 0, "StillImage").otherwise("Sound").alias("type"), F.when(k % 2 == 0, "open").otherwise("closed").alias("license"))
    docs = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("key"), F.struct(F.array(media).alias("media")).alias("doc"))
    name = lambda key, page: F.concat(F.lit("occurrence?taxonKey="), key.cast("string"), F.lit(f"&mediaType=StillImage&limit={_SIZE}&offset="), (page * _SIZE).cast("string"))
    _put_pages(docs, "o_orderkey", name, root, last=lambda page, size, rows: rows < size)
    found = rest.occurrences(spark, f"{root}/occurrence", _keys(docs), pages=6, size=_SIZE, pause=0)
    whole = found.select(F.to_json(F.struct(F.array(F.from_json("value", "media array<struct<identifier:string,type:string,format:string,license:string>>")).alias("results"))).alias("value"))
    return C.still_images(readers.occurrences_json(whole)).select("identifier", (F.col("license") == "open").alias("open"))


@query("SELECT n_name AS species, s.position::INTEGER AS position, 'u' || n_nationkey || s.suffix AS url FROM nation JOIN (VALUES (0, 'h'), (1, 'x')) s(position, suffix) ON n_nationkey % 3 > 0")
def specimen_requests(spark: SparkSession, d: str) -> DataFrame:
    """Specimen images of genus and species by request; a third of the requests fail."""
    root = new_folder(spark, "service")
    names = table(spark, d, "nation").select("n_nationkey", F.lit("Genus").alias("genus"), F.col("n_name").alias("species"))
    image = lambda shot, suffix: F.struct(F.lit(shot).alias("shotType"), F.concat(F.lit("u"), F.col("n_nationkey").cast("string"), F.lit(suffix)).alias("image"))
    body = F.to_json(F.struct(F.array(image("x", "x"), image("h", "h"), image("h", "h")).alias("specimenImages")))
    files = names.where("n_nationkey % 3 > 0").select(F.concat(F.lit("images?genus=Genus&species="), "species", F.lit("&limit=30")).alias("key"), F.encode(body, "UTF-8").alias("content"))
    sinks.put_objects(files, root)
    found = rest.specimen_payloads(names, f"{root}/images", 5, tries=1, pause=0)
    return readers.specimen_images(found, ("h",), 5).select("species", "position", "url")
