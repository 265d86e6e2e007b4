"""Curation queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geo as G
from lodestone.functions import text as X
from lodestone.operators import curate as C
from lodestone.operators import integrity as I
from lodestone.operators import merge as M
from lodestone.plans.base import query, table


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug,
 split_part(trim(p_name), ' ', 1) AS genus, split_part(trim(p_name), ' ', 2) AS epithet, trim(regexp_replace(p_brand, '\\s+', ' ', 'g')) AS brand FROM part""")
def slugify_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", X.slugify(name).alias("slug"), X.genus(name).alias("genus"), X.epithet(name).alias("epithet"), X.squeeze(F.col("p_brand")).alias("brand"))


@query("""WITH s AS (SELECT p_partkey, replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-', ' ') AS s FROM part)
SELECT p_partkey, upper(s[1:1]) || lower(s[2:]) AS display FROM s""")
def slug_to_display(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.display_name(X.slugify(F.col("p_name"))).alias("display"))


@query("""WITH p AS (SELECT page_id, url, lower(regexp_extract(split_part(list_last(string_split(url, '/')), '?', 1), '\\.([^.]*)$', 1)) AS e FROM pages)
SELECT page_id, CASE WHEN e IN ('jpg', 'jpeg', 'png', 'webp') THEN e ELSE 'jpg' END AS extension, replace(url, 'page', 'medium') AS medium FROM p""")
def url_extension(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.url_extension(F.col("url")).alias("extension"), X.resize_url(F.col("url"), "page").alias("medium"))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(nullif(trim(event_type), ''), 'none') AS kind,
 round(try_cast(json_extract_string(props, '$.k') AS DOUBLE) / 3, 6) AS third FROM events""")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", X.to_int(k).alias("k"), X.default_if_blank(F.col("event_type"), "none").alias("kind"), F.round(X.to_double(k) / 3, 6).alias("third"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("""SELECT event_id, lat IS NULL AS lat_missing, (lat BETWEEN -15 AND 15) AND (lon BETWEEN -20 AND 20) AS inside, (lat IS NULL) = (lon IS NULL) AS paired
 FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ((event_id * 7919) % 400) / 10.0::DOUBLE - 20.0::DOUBLE END AS lat, ((event_id * 104729) % 600) / 10.0::DOUBLE - 30.0::DOUBLE AS lon FROM events)""")
def bounds_and_pairs(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.plans.base import observations

    lat, lon = F.col("lat"), F.col("lon")
    return observations(spark, d).select("event_id", lat.isNull().alias("lat_missing"), (lat.between(-15, 15) & lon.between(-20, 20)).alias("inside"), G.both_or_none(lat, lon).alias("paired"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01'")
def research_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where((F.col("o_orderstatus") == "F") & C.created_since(F.col("o_orderdate"), "1995-01-01 00:00:00")).select("o_orderkey", "o_custkey")


@query("SELECT p_brand AS slug, dense_rank() OVER (ORDER BY p_brand) - 1 AS class_idx, n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def species_dimension(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumnRenamed("p_brand", "slug")
    return part.groupBy("slug").agg(F.count("*").alias("n")).join(C.class_index(part), "slug").select("slug", F.col("class_idx").cast("long").alias("class_idx"), "n").orderBy("class_idx")


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'O' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def exclusion_union(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id")).union(orders.where("o_orderpriority = '1-URGENT'").select("o_custkey")).distinct()


@query("SELECT page_id FROM pages WHERE regexp_matches(coalesce(url, ''), '(?:^|/)7(?:/|$)') OR regexp_matches(coalesce(url, ''), '(?:^|/)blog(?:/|$)')")
def path_regex_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(C.under_path(F.col("url"), 7) | C.under_path(F.col("url"), "blog")).select("page_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def image_species_join(spark: SparkSession, d: str) -> DataFrame:
    return C.with_species(table(spark, d, "lineitem"), table(spark, d, "part"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "p_name", "p_brand")


@query("""WITH j AS (SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
 row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F')
SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM j WHERE r <= 3""")
def obs_photo_join_cap(spark: SparkSession, d: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    found = C.photos_of(table(spark, d, "lineitem").select(*order), table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey"), "l_orderkey", "o_orderkey")
    return C.first_per_key(found, "o_custkey", order, 3).select("o_custkey", *order)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building')")
def taxon_semi_join(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "customer").where(F.lower("c_mktsegment") == "building").select(F.col("c_custkey").alias("o_custkey"))
    return C.of_taxa(table(spark, d, "orders"), wanted, "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1993-06-01')")
def exclude_anti_join(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "orders").where(~C.created_since(F.col("o_orderdate"), "1993-06-01 00:00:00")).select(F.col("o_custkey").alias("c_custkey"))
    return C.exclude(table(spark, d, "customer"), (seen, "c_custkey")).select("c_custkey", "c_name")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'not_found' WHEN l.quality = 0 THEN 'no_content' WHEN l.toxic = 1 THEN 'hash_mismatch' END AS error
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def restore_left_join(spark: SparkSession, d: str) -> DataFrame:
    expected = table(spark, d, "documents").select("doc_id", F.lit(0).alias("digest"))
    found = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") != 0, F.col("toxic")).alias("digest"))
    return I.restored(expected, found, "doc_id", "digest").select("doc_id", "error")


@query("SELECT d.doc_id, coalesce(nullif(l.quality, 0), d.n_chars % 7) AS filled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def coalesce_backfill(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.nullif(F.col("quality").cast("long"), F.lit(0)).alias("filled"))
    return C.backfilled(table(spark, d, "documents").select("doc_id", "n_chars"), labels, "doc_id", "filled", F.col("n_chars") % 7).select("doc_id", "filled")


@query("SELECT d.doc_id, coalesce(l.toxic, -1) AS known_label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def unknown_default_join(spark: SparkSession, d: str) -> DataFrame:
    return C.with_default(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").withColumnRenamed("toxic", "known_label"), "doc_id", "known_label", -1)


@query("""WITH o AS (SELECT p_name AS k, min(p_brand) AS brand, min(p_size) AS size FROM part WHERE p_size < 40 GROUP BY 1),
n AS (SELECT p_name AS k, min(p_brand) AS brand, min(p_size) AS size FROM part WHERE p_size > 5 GROUP BY 1)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE
 concat_ws(',', CASE WHEN o.brand IS DISTINCT FROM n.brand THEN 'brand' END, CASE WHEN o.size IS DISTINCT FROM n.size THEN 'size' END) END AS change
FROM o FULL JOIN n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.brand IS DISTINCT FROM n.brand OR o.size IS DISTINCT FROM n.size""")
def taxonomy_diff(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    of = lambda df: df.groupBy(F.col("p_name").alias("k")).agg(F.min("p_brand").alias("brand"), F.min("p_size").alias("size"))
    return I.taxonomy_changes(of(part.where("p_size < 40")), of(part.where("p_size > 5")), "k", ("brand", "size"))


@query("""SELECT c.c_custkey, min(s.s_suppkey) AS s_suppkey FROM customer c LEFT JOIN supplier s
 ON CASE WHEN c.c_custkey % 3 > 0 AND s.s_suppkey % 2 > 0 THEN c.c_nationkey = s.s_nationkey ELSE substr(c.c_name, -2) = substr(s.s_name, -2) END GROUP BY 1""")
def conditional_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("id"), F.substring("c_name", -2, 2).alias("name"))
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 > 0, F.col("s_nationkey")).alias("id"), F.substring("s_name", -2, 2).alias("name"))
    return C.id_else_name(c, s, ("c_custkey", "id", "name"), ("s_suppkey", "id", "name"))


@query("""WITH p AS (SELECT l_orderkey, l_returnflag, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY
 list_position(['R', 'A', 'N'], l_returnflag), l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem)
SELECT l_orderkey, l_returnflag, l_partkey FROM p WHERE r = 1""")
def priority_pick(spark: SparkSession, d: str) -> DataFrame:
    return C.priority_pick(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ("R", "A", "N"), ["l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_returnflag", "l_partkey")


@query("""WITH b AS (SELECT doc_id, md5(text) AS h, CASE WHEN lang IS NULL THEN 'corrupt' WHEN n_chars < 500 THEN 'too_small' ELSE 'ok' END AS s FROM documents),
c AS (SELECT CASE WHEN s = 'ok' AND row_number() OVER (PARTITION BY h, s ORDER BY doc_id) > 1 THEN 'duplicate' ELSE s END AS status FROM b)
SELECT status, count(*) AS n FROM c GROUP BY 1""")
def clean_status_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), F.when(F.col("lang").isNotNull(), F.col("n_chars")).alias("width"), F.when(F.col("lang").isNotNull(), F.col("n_chars")).alias("height"))
    return C.image_status(docs, 500, "h", "doc_id").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_global(spark: SparkSession, d: str) -> DataFrame:
    return C.first_per_key(table(spark, d, "documents").select("doc_id", F.md5("text").alias("h")), "h", "doc_id").select("doc_id")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_per_group(spark: SparkSession, d: str) -> DataFrame:
    return C.first_per_key(table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("h")), ["source", "h"], "doc_id").select("doc_id", "source")


@query("SELECT DISTINCT p_name AS slug, dense_rank() OVER (ORDER BY p_name) - 1 AS class_idx FROM part")
def class_index(spark: SparkSession, d: str) -> DataFrame:
    return C.class_index(table(spark, d, "part").withColumnRenamed("p_name", "slug")).select("slug", F.col("class_idx").cast("long").alias("class_idx"))


@query("""WITH a AS (SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM a)
SELECT doc_id, source FROM c WHERE r <= 15 ORDER BY doc_id LIMIT 150""")
def diverse_sample(spark: SparkSession, d: str) -> DataFrame:
    banned = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    docs = C.exclude(table(spark, d, "documents").select("doc_id", "source"), (banned, "doc_id"))
    return C.diverse_sample(docs, "source", "doc_id", 15, 150).select("doc_id", "source")


@query("SELECT doc_id, CASE WHEN (row_number() OVER (ORDER BY source, doc_id) - 1) % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM documents")
def split_modulo(spark: SparkSession, d: str) -> DataFrame:
    return C.every_nth_split(table(spark, d, "documents").select("doc_id", "source"), ["source", "doc_id"]).select("doc_id", "split")


@query("""WITH u AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'fr' THEN 0 ELSE 1 END, doc_id) AS r FROM documents)
SELECT doc_id, source, lang FROM u WHERE r = 1 ORDER BY CASE WHEN lang = 'fr' THEN 0 ELSE 1 END, doc_id LIMIT 12""")
def preferred_first(spark: SparkSession, d: str) -> DataFrame:
    return C.preferred_first(table(spark, d, "documents").select("doc_id", "source", "lang"), F.col("lang") == "fr", "source", "doc_id", 12)


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars IS NOT NULL ORDER BY n_chars, doc_id LIMIT 25")
def blurriest_n(spark: SparkSession, d: str) -> DataFrame:
    return C.top_n(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 25, ascending=True)


@query("""WITH j AS (SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
u AS (SELECT 'toxic' AS category, * FROM j WHERE toxic = 1 UNION ALL SELECT 'poor', * FROM j WHERE quality = 0 UNION ALL SELECT 'good', * FROM j WHERE quality = 1 AND toxic = 0)
SELECT category, count(*) AS n, count(DISTINCT source) AS sources FROM u GROUP BY 1""")
def category_union(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    u = C.tagged_union({"toxic": j.where("toxic = 1"), "poor": j.where("quality = 0"), "good": j.where("quality = 1 and toxic = 0")})
    return u.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query("""SELECT 'md5' AS key, count(*) AS overlap FROM (SELECT md5(text) FROM documents INTERSECT SELECT md5(text) FROM benchmark)
UNION ALL SELECT 'id', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT item_id FROM benchmark)""")
def leakage_overlap(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.md5("text").alias("md5"), F.col("doc_id").alias("id"))
    return I.overlap(docs, table(spark, d, "benchmark").select(F.md5("text").alias("md5"), F.col("item_id").alias("id")), "md5", "id")


@query("""SELECT e.doc_id, CASE WHEN n IS NULL THEN 'missing' ELSE 'ambiguous' END AS problem FROM documents e LEFT JOIN
 (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1) f ON e.doc_id = f.doc_id WHERE n IS NULL OR n > 1""")
def exactly_one_match(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    return I.exactly_one(table(spark, d, "documents"), labels.select("doc_id").union(labels.where("toxic = 1").select("doc_id")), "doc_id")


@query("""WITH t AS (SELECT c_custkey, c_name, nullif(c_nationkey, 3) AS c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 3 > 0),
i AS (SELECT c_custkey, 'new ' || c_name AS c_name, nullif(c_nationkey, 5) AS c_nationkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(t.c_custkey, i.c_custkey) AS c_custkey, CASE WHEN t.c_custkey IS NULL THEN i.c_name ELSE t.c_name END AS c_name,
 coalesce(i.c_nationkey, t.c_nationkey) AS c_nationkey, coalesce(i.c_mktsegment, t.c_mktsegment) AS c_mktsegment FROM t FULL JOIN i ON t.c_custkey = i.c_custkey""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    target = c.where("c_custkey % 3 > 0").select("c_custkey", "c_name", F.nullif("c_nationkey", F.lit(3)).alias("c_nationkey"), "c_mktsegment")
    incoming = c.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), F.nullif("c_nationkey", F.lit(5)).alias("c_nationkey"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"), F.lit(1).alias("ord"))
    return M.upsert(target, incoming, "c_custkey", ("c_nationkey", "c_mktsegment"), "ord")


@query("""WITH i AS (SELECT c_mktsegment || '-' || c_nationkey AS path, c_custkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS r FROM customer)
SELECT path, c_custkey FROM i WHERE r = 1 AND path NOT IN (SELECT c_mktsegment || '-' || c_nationkey FROM customer WHERE c_custkey % 100 = 0)""")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("path"), "c_custkey")
    return M.insert_ignore(rows.where("c_custkey % 100 = 0"), rows, "path", "c_custkey")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) < 12")
def shortfall(spark: SparkSession, d: str) -> DataFrame:
    return C.shortfall(table(spark, d, "documents"), "source", 12)


@query("""SELECT vec_id, label, CASE WHEN row_number() OVER (ORDER BY md5(vec_id || ':42'), vec_id) <= greatest(1, floor(count(*) OVER () * 0.2)) THEN 'val' ELSE 'train' END AS split FROM embeddings""")
def random_split(spark: SparkSession, d: str) -> DataFrame:
    return C.random_split(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 0.2, 42)


@query("""SELECT user_id % 50 AS taxon, count(*) AS n FROM events GROUP BY 1""")
def count_per_taxon(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("taxon")).agg(F.count("*").alias("n"))


@query("""SELECT user_id % 50 AS taxon, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, taxon LIMIT 10""")
def top_taxa(spark: SparkSession, d: str) -> DataFrame:
    return C.top_n(count_per_taxon(spark, d), "n", "taxon", 10)


@query("""SELECT p_name AS slug, min_by(p_type, p_partkey) AS first_type, max_by(p_type, p_partkey) AS last_type FROM part GROUP BY 1""")
def metadata_tie_rule(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_name").alias("slug"), "p_partkey", "p_type")
    first, last = C.metadata_by_slug(rows, "p_partkey", False), C.metadata_by_slug(rows, "p_partkey", True)
    return first.withColumnRenamed("p_type", "first_type").join(last.withColumnRenamed("p_type", "last_type"), "slug")


@query("""SELECT 'unique' AS rule, count(*) AS problems FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'foreign_key', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT 'check', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""")
def constraint_checks(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    found = {
        "unique": I.duplicates(lines, "l_orderkey", "l_linenumber"),
        "foreign_key": I.orphans(lines.select("l_orderkey"), orders.where("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey"),
        "check": I.outside(orders, "o_orderstatus", ("O", "F")),
    }
    return C.tagged_union({k: v.agg(F.count("*").alias("problems")) for k, v in found.items()}, "rule")
