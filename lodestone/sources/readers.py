"""Readers: files and tables to canonical DataFrames."""

from __future__ import annotations

from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import schema
from lodestone.functions import images
from lodestone.functions import text as X
from lodestone.operators.curate import class_index, priority_pick, running_total
from lodestone.operators.integrity import require_columns
from lodestone.shipping import ship
from lodestone.sources.rest import with_bodies
from lodestone.storage import stored


def tsv(spark: SparkSession, path: str, ddl: str, columns: tuple[str, ...], partitions: int | None = None) -> DataFrame:
    """Gzipped tab-separated files with a header, all text.  Gzip cannot be split, so what follows
    the scan is dealt out anew where ``partitions`` says so."""
    df = spark.read.csv(path, sep="\t", header=True, schema=ddl, enforceSchema=False).select(*columns)
    return df.repartition(partitions) if partitions else df


def rows_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; every column is text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def species_list(spark: SparkSession, path: str) -> DataFrame:
    """(position, name, common_name, slug) of a species list: "Genus species  # Common name".

    Blank lines and comments are left out; of names that are equal in any case the first stays.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("position", "line"))
    parsed = lines.select("position", X.squeeze(F.substring_index("line", "#", 1)).alias("name"), F.when(F.col("line").contains("#"), F.nullif(F.trim(F.regexp_extract("line", "#(.*)$", 1)), F.lit(""))).alias("common_name")).where("name <> ''")
    first = parsed.groupBy(F.lower("name").alias("k")).agg(F.min_by(F.struct("position", "name", "common_name"), "position").alias("r"))
    return first.select("r.*").withColumn("slug", X.slugify(F.col("name"))).orderBy("position")


def image_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = schema.IMAGE_EXTENSIONS, content: bool = True) -> DataFrame:
    """Image files below a folder in path order, with the extension tested in any case, and the
    last folder's name as ``slug``."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if not content:
        df = df.drop("content")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return df.where(ext.isin(*extensions)).withColumn("extension", ext).withColumn("slug", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).orderBy("path")


def decoded_images(spark: SparkSession, root: str, extensions: tuple[str, ...] = schema.IMAGE_EXTENSIONS) -> DataFrame:
    """Image files decoded in the JVM: (path, extension, slug, width, height, image); the last is
    Spark's image struct, for ``images.blur_pixels`` and ``images.preprocess_pixels``.

    JPEG, PNG, GIF and BMP are decoded; WebP pixels need Pillow (``images.preprocess``), so such a file
    is an error here; ``inspected_images`` has its size and EXIF flag.  Width, height and image are null where decoding failed.
    """
    pixels = spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image", F.col("image.origin").alias("path"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = pixels.where(ext.isin(*extensions)).withColumns({"extension": ext, "slug": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)})
    good = F.when(F.col("extension") == "webp", F.raise_error(F.concat(F.lit("WebP needs Pillow: "), F.col("path"))).cast("boolean")).otherwise(F.col("image.width") > 0)
    return rows.withColumn("good", good).where("good is not null").select("path", "extension", "slug", *[F.when(F.col("good"), F.col(f"image.{c}")).alias(c) for c in ("width", "height")], F.when(F.col("good"), F.col("image")).alias("image"))


def inspected_images(spark: SparkSession, root: str, extensions: tuple[str, ...] = schema.IMAGE_EXTENSIONS) -> DataFrame:
    """(path, extension, slug, md5, has_exif, width, height) of image files, for ``curate.image_status``.

    EXIF and the size of WebP files come from the container's parts wherever they lie; other files
    are decoded in the JVM, and one that cannot be has no size.  Only these narrow columns are joined,
    neither pixels nor contents move.
    """
    ship(spark)
    at = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  the two sources spell local paths differently
    files = image_files(spark, root, extensions).select("path", "extension", "slug", F.md5("content").alias("md5"), images.container_info("content").alias("own"), at("path").alias("_at"))
    sizes = decoded_images(spark, root, tuple(e for e in extensions if e != "webp")).select(at("path").alias("_at"), "width", "height")
    joined = files.join(sizes, "_at", "left")
    is_webp = F.col("extension") == "webp"
    size = {c: F.when(is_webp, F.col(f"own.{c}")).otherwise(F.col(c)) for c in ("width", "height")}
    return joined.select("path", "extension", "slug", "md5", F.when(size["width"].isNotNull(), F.coalesce("own.has_exif", F.lit(False))).alias("has_exif"), *[v.alias(c) for c, v in size.items()])


def directory_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Samples of a folder of folders: each sub-folder's name is the slug."""
    files = image_files(spark, root, content=False)
    return files.join(class_index(files), "slug").select(F.col("path").alias("storage_path"), F.col("class_idx").alias("label"), "slug", F.lit(None).cast("string").alias("split"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))


def csv_manifest(spark: SparkSession, path: str, root: str) -> tuple[DataFrame, DataFrame]:
    """(samples, missing): manifest rows with their file, and rows without one.

    A row's file is ``slug/photo_id`` with the best extension that exists.  All slugs of the
    manifest count for class indices, also those whose files are missing.
    """
    rows = rows_csv(spark, path)
    require_columns(rows, ("slug", "photo_id"))
    for c in ("split", "lat", "lon"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    files = image_files(spark, root, content=False).withColumn("photo_id", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    best = priority_pick(files, ["slug", "photo_id"], "extension", schema.IMAGE_EXTENSIONS, "path").select("slug", "photo_id", F.col("path").alias("storage_path"))
    joined = rows.join(best, ["slug", "photo_id"], "left").join(class_index(rows), "slug")
    lat, lon = X.to_double(F.col("lat")), X.to_double(F.col("lon"))
    samples = joined.where("storage_path is not null").select("storage_path", F.col("class_idx").alias("label"), "slug", F.nullif("split", F.lit("")).alias("split"), lat.alias("lat"), lon.alias("lon"))
    return samples, joined.where("storage_path is null").select("slug", "photo_id")


def database_manifest(images: DataFrame, species: DataFrame) -> DataFrame:
    """Samples of the image and species tables, each of which the database is asked for once."""
    joined = images.join(species.select(F.col("id").alias("species_id"), "slug"), "species_id")
    joined = stored(joined.select("storage_path", "slug", "split", "lat", "lon"), "samples")
    return joined.join(class_index(joined), "slug").select("storage_path", F.col("class_idx").alias("label"), "slug", "split", "lat", "lon")


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 32, **options) -> DataFrame:
    """A database table.  With a numeric ``key`` and its bounds it is read in ``partitions`` ranges
    of the key by as many tasks; without, by one."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


#: Rows that are fetched from a database at once.
_FETCHED = 5000
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def _sqlite_rows(batches, table: str, fields: list[tuple[str, str]]):
    import shutil
    import sqlite3
    import tempfile
    from contextlib import closing

    from pyarrow import fs

    schema = pa.schema([(name, _ARROW[kind]) for name, kind in fields])
    asked = ", ".join(f'"{name}"' for name, _ in fields)
    for path in (p for batch in batches for p in batch.column(0).to_pylist()):
        store, at = fs.FileSystem.from_uri(path)
        with tempfile.TemporaryDirectory() as own:
            with store.open_input_stream(at) as there, open(f"{own}/copy.db", "wb") as out:
                shutil.copyfileobj(there, out, 1 << 20)
            with closing(sqlite3.connect(f"{own}/copy.db")) as db:
                found = db.execute(f'SELECT {asked} FROM "{table}"')
                while rows := found.fetchmany(_FETCHED):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def sqlite_table(spark: SparkSession, root: str, table: str, ddl: str) -> DataFrame:
    """A table that is kept in SQLite databases below a folder (``sinks.sqlite_files``), whose files are
    dealt to tasks.  Any executor reads any of them; ``ddl`` names long, int, double or string columns."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.db").load(root).select("path")
    fields = [(f.name, f.dataType.simpleString()) for f in T.StructType.fromDDL(ddl)]
    return files.mapInArrow(partial(_sqlite_rows, table=table, fields=fields), ddl)


def _object(uri: str | None) -> bytes | None:
    """An object's bytes, None if it is not there."""
    from pyarrow import fs

    if not uri:
        return None
    files, at = fs.FileSystem.from_uri(uri)
    if files.get_file_info(at).type != fs.FileType.File:
        return None
    with files.open_input_stream(at) as f:
        return f.read()


def get_objects(df: DataFrame, uri: str = "uri") -> DataFrame:
    """``df`` with ``content``: the bytes of each row's object, by its URI (s3://, gs://, file://).

    Objects that are not there are null; other failures are errors.  Few are read at once by a task,
    which passes them on by bytes.  Every row reads its own, so
    rows can come from any table; whole folders are read better with ``image_files``.
    """
    ship(df.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.select(*[f"`{c}`" for c in df.columns], F.col(uri).alias("__lodestone_uri")).mapInArrow(with_bodies(_object), f"{fields}, content binary")


def manifest(spark: SparkSession, database: tuple[DataFrame, DataFrame] | None = None, csv: str | None = None, root: str | None = None) -> DataFrame:
    """The first source that is given: the database, then a manifest file, then a folder."""
    if database is not None:
        return database_manifest(*database)
    if csv is not None:
        return csv_manifest(spark, csv, root)[0]
    if root is not None:
        return directory_manifest(spark, root)
    raise ValueError("no source: a database, a manifest or a folder is needed")


def observations_json(df: DataFrame, column: str = "value") -> DataFrame:
    """Nested observations of a JSON column, with both-or-none coordinates."""
    o = F.from_json(column, schema.OBSERVATION_JSON)
    flat = df.select(o.alias("o")).select("o.uuid", "o.created_at", F.col("o.taxon.id").alias("taxon_id"), F.col("o.taxon.name").alias("name"), F.col("o.taxon.rank").alias("rank"), "o.photos", X.parse_location(F.col("o.location")).alias("p"))
    return flat.select("*", "p.lat", "p.lon").drop("p")


def occurrences_json(df: DataFrame, column: str = "value") -> DataFrame:
    """Media of an occurrence page, one row each."""
    page = df.select(F.from_json(column, schema.OCCURRENCE_JSON).alias("o"))
    return page.select(F.explode("o.results").alias("r")).select(F.explode("r.media").alias("m")).select("m.*")


def specimens_json(df: DataFrame, column: str = "value") -> DataFrame:
    """``df`` with ``position`` and the ``shot_type`` and ``url`` of each specimen image of a payload.

    Payloads vary (see ``text.specimen_records``); one without images gives no rows.
    """
    rows = df.select("*", F.posexplode(X.specimen_records(F.col(column))).alias("position", "_record"))
    return rows.select(*df.columns, "position", "_record.shot_type", "_record.url")


def specimen_images(df: DataFrame, shots: tuple[str, ...], limit: int, column: str = "value") -> DataFrame:
    """``df`` with ``position`` and ``url`` of the up to ``limit`` images that each payload gives.

    Wanted shots come first, then all others, each in the payload's order and every URL once.  A
    payload is one row, so nothing is shuffled.
    """
    records = X.specimen_records(F.col(column))
    wanted = lambda r: r["shot_type"].isin(*[s.strip().lower() for s in shots])
    url = lambda r: r["url"]
    ordered = F.concat(F.transform(F.filter("_records", wanted), url), F.transform(F.filter("_records", lambda r: ~wanted(r)), url))
    rows = df.withColumn("_records", records).select(*df.columns, F.posexplode(F.slice(F.array_distinct(ordered), 1, limit)).alias("position", "url"))
    return rows


def taxonomy_json(spark: SparkSession, path: str) -> DataFrame:
    """(class_idx, species_name, common_name, taxon_id, slug) of a taxonomy file."""
    kind = "map<string,struct<species_name:string,common_name:string,taxon_id:int,slug:string>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", kind)).alias("k", "v")).select(F.col("k").cast("int").alias("class_idx"), "v.*")


def document_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the entries of a document that ``sinks.json_file`` has written: a line each, without
    its comma.  The first and last line are left out."""
    lines = spark.read.text(path)
    ends = F.col("value").rlike(r"^\{") | F.col("value").rlike(r"^[\]}]+$")
    return lines.where(~ends).select(F.regexp_replace("value", ",$", "").alias("value"))


def document_head(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row: what the first line of such a document says before its entries begin."""
    head = spark.read.text(path).where(F.col("value").rlike(r"^\{"))
    closed = F.concat(F.regexp_replace("value", r', "[^"]*": [\[{]$', ""), F.lit("}"))
    return head.select(F.from_json(closed, schema).alias("h")).select("h.*")


def geo_index_json(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(slug, clat, clon) of a nested cell index, read by its lines.

    ``whole`` is for small documents that others have written: one row then holds it all.
    """
    if whole:
        text = spark.read.text(path, wholetext=True).select(F.from_json("value", schema.GEO_INDEX).alias("g"))
        entries = text.select(F.explode("g.cells").alias("slug", "cells"))
    else:
        entry = F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), "map<string,array<array<bigint>>>")
        entries = document_lines(spark, path).select(F.explode(entry).alias("slug", "cells"))
    return entries.select("slug", F.explode("cells").alias("c")).select("slug", F.get("c", F.lit(0)).alias("clat"), F.get("c", F.lit(1)).alias("clon"))


def split_json(spark: SparkSession, path: str) -> DataFrame:
    """(key, n_train, n_val) of the "val" side of a pinned split, read by its lines."""
    keys = document_lines(spark, path).select(F.get(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>"), F.lit(0)).alias("key"))
    return keys.crossJoin(F.broadcast(document_head(spark, path, "n_train long, n_val long")))  # one row


def metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """(label, n, top1, top3) of each class in a report, read by its lines."""
    entry = F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), "map<string,struct<n:long,top1:double,top3:double>>")
    return document_lines(spark, path).select(F.explode(entry).alias("label", "v")).select("label", "v.*")


def _npy_rows(batches):
    import io

    import numpy as np

    for batch in batches:
        for content in batch.column(0):
            matrix = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
            for a in range(0, len(matrix), 1000):
                part = matrix[a : a + 1000].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part), dtype=np.int32)), pa.array(list(part), pa.list_(pa.float64()))], ["class_idx", "proto"])


def prototypes_npy(spark: SparkSession, path: str) -> DataFrame:
    """(class_idx, proto) of a ``.npy`` matrix with a row a class: a class dimension, so one task reads it."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_npy_rows, "class_idx int, proto array<double>")


def staged(spark: SparkSession, source: str, target: str) -> str:
    """Copies a file once: a target that is there and not empty is used as it is."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    fs = b.getFileSystem(conf)
    if not (fs.exists(b) and fs.getFileStatus(b).getLen() > 0):
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, fs, b, False, conf)
    return target


def with_scan_order(df: DataFrame, name: str = "scan") -> DataFrame:
    """A scan's rows with where they stand: file, block of the file, row.  The column sorts as the
    files are read from first to last, however they are split among tasks.

    ``df`` must come straight from files; rows of one block are read by one task, in order.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select("*", place.alias(name))


def numbered_samples(df: DataFrame, path: str = "storage_path") -> DataFrame:
    """Samples with ``position``, 0, 1, 2 ... by path: done once for a manifest, for ``epoch``."""
    return running_total(df, path, F.lit(1).cast("long"), "position")


def shuffled_position(position, n: int, seed: int, rounds: int = 48):
    """Where a position of 0 to n - 1 comes in an order that the seed picks: a permutation.

    A swap-or-not shuffle: in each round a position and its mirror image about a point that the seed
    picks are swapped, or not, as a hash of the greater of the two says.
    """
    points = [int.from_bytes(sha256(f"{seed}:{r}".encode()).digest()[:8], "big") % max(n, 1) for r in range(rounds)]
    steps = F.from_json(F.lit(str([[p, r] for r, p in enumerate(points)])), "array<array<bigint>>")

    def step(x, s):
        mirror = F.pmod(F.get(s, F.lit(0)) - x, F.lit(max(n, 1)))
        swap = F.xxhash64(F.lit(seed), F.get(s, F.lit(1)), F.greatest(x, mirror)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(steps, position.cast("bigint"), step)


def epoch(samples: DataFrame, n: int, seed: int, number: int, batch_size: int, first_batch: int = 0, partitions: int | None = None) -> DataFrame:
    """One epoch's samples with ``batch`` and ``place`` in it, batches in order from ``first_batch`` on.

    ``samples`` have ``position`` (``numbered_samples``), ``n`` of them.  A sample's place is a keyed
    permutation of its position, so it depends on seed and epoch alone, nothing is sorted as a
    whole, and an epoch goes on at any batch.  Each partition holds a stretch of batches in order,
    and partitions follow one another.
    """
    spark = samples.sparkSession
    placed = samples.withColumn("_place", shuffled_position(F.col("position"), n, seed * 1_000_003 + number))
    placed = placed.withColumn("batch", F.floor(F.col("_place") / batch_size)).where(F.col("batch") >= first_batch).withColumn("place", F.col("_place") % batch_size).drop("_place")
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = max(1, -(-n // batch_size) - first_batch)
    share = -(-left // parts)
    part = F.floor((F.col("batch") - first_batch) / share).cast("int")
    return placed.repartitionById(parts, part).sortWithinPartitions("batch", "place")


def batches(df: DataFrame, seed: int | None = None) -> DataFrame:
    """Samples in training order (shuffled by a seed) or in evaluation order (by path).

    The training order is a hash of the path and the seed, so it does not depend on how the rows
    were dealt before.  It is a global sort; ``epoch`` needs none.
    """
    return df.orderBy(F.xxhash64("storage_path", F.lit(seed)), "storage_path") if seed is not None else df.orderBy("storage_path")
