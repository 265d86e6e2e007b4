"""Checks that fail closed: each gives its problems as rows, and ``require`` raises on any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.schema import IMAGE_EXTENSIONS


def require(problems: DataFrame, what: str, shown: int = 50) -> None:
    """Raises if there are problems, with the first 50 and how many there are."""
    first = problems.limit(shown).collect()
    if first:
        raise ValueError(f"{what}: {problems.count()} problems, the first: " + "; ".join(map(str, first)))


def missing_columns(df: DataFrame, names) -> list[str]:
    return [n for n in names if n not in df.columns]


def require_columns(df: DataFrame, names: tuple[str, ...]) -> None:
    if missing := missing_columns(df, names):
        raise ValueError(f"missing columns: {missing}")
    if df.isEmpty():
        raise ValueError("no rows")


def missing_paths(spark: SparkSession, *paths: str) -> list[str]:
    """Those of the paths that are not there, on whatever file system each is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return [p for p in paths if not (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]


def require_paths(spark: SparkSession, *paths: str) -> None:
    """Raises unless every artifact is there."""
    if missing := missing_paths(spark, *paths):
        raise ValueError(f"missing artifacts: {missing}")


def different_sizes(a: DataFrame, b: DataFrame) -> tuple[int, int] | None:
    """Both sizes, if they differ."""
    n, m = a.count(), b.count()
    return (n, m) if n != m else None


def require_same_size(a: DataFrame, b: DataFrame, what: str) -> None:
    if sizes := different_sizes(a, b):
        raise ValueError(f"{what}: {sizes[0]} and {sizes[1]} rows")


def exactly_one(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, problem) of expected keys that are missing or found more than once."""
    n = found.groupBy(key).agg(F.count("*").alias("n"))
    joined = expected.select(key).distinct().join(n, key, "left")
    return joined.select(key, F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").alias("problem")).where("problem is not null")


def file_problems(expected: DataFrame, files: DataFrame, keys: list[str], digest: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """(keys, problem) of expected rows that do not resolve to exactly one file that is what it was.

    ``files`` has the keys, ``extension`` and the digest.  In this order: missing (no file),
    ambiguous (several), wrong_extension, hash_mismatch (an unknown digest is one).
    """
    found = files.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.lower("extension")).alias("_ext"), F.min(digest).alias("_found"))
    n, ext = F.col("_n"), F.coalesce(F.col("_ext").isin(*extensions), F.lit(False))
    problem = F.when(n.isNull(), "missing").when(n > 1, "ambiguous").when(~ext, "wrong_extension").when(~F.coalesce(F.col("_found") == F.col(digest), F.lit(False)), "hash_mismatch")
    return expected.join(found, keys, "left").select(*keys, problem.alias("problem")).where("problem is not null")


def restored(expected: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """Every expected row with ``error``, or null where it is whole: what stands in the way of
    having the frozen rows again.

    ``found`` has the key (the observation's), and may have ``n_files`` (local files of the row),
    ``url`` (of the row's photo among the observation's) and the digest of what was downloaded.
    In this order: ambiguous (several local files), not_found (no such observation), no_photo (the
    photo is gone from it), no_content (the download failed), hash_mismatch.  The expected rows
    are never changed.
    """
    ambiguous = F.col("n_files") > 1 if "n_files" in found.columns else F.lit(False)
    photo = F.col("url") if "url" in found.columns else F.lit("")
    there = found.select(F.col(key), F.lit(True).alias("_there"), F.coalesce(ambiguous, F.lit(False)).alias("_several"), photo.alias("_url"), F.col(digest).alias("_digest"))
    error = F.when(F.col("_several"), "ambiguous").when(F.col("_there").isNull(), "not_found").when(F.col("_url").isNull(), "no_photo").when(F.col("_digest").isNull(), "no_content").when(F.col("_digest") != F.col(digest), "hash_mismatch")
    return expected.join(there, key, "left").withColumn("error", error).drop("_there", "_several", "_url", "_digest")


def unknown_labels(df: DataFrame, domain: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).join(domain.select(key).distinct(), key, "left_anti")


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def outside(df: DataFrame, column: str, allowed: tuple) -> DataFrame:
    return df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def rejects(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Rows with the first reason that holds; rows without one are left out."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(reasons.items()):
        reason = F.when(holds, F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason).where("reason is not null")


def request_problems(df: DataFrame, width: str | None = None) -> DataFrame:
    """Uploads that fail, with the first reason: coordinates out of bounds, a type that is no image
    (none at all is let through), no content, content that cannot be decoded.

    ``width`` names a column that is null where decoding failed (see ``images.inspect_image``).  One
    coordinate alone is no reason: such an upload counts as having none (``only_pairs``).
    """
    lat, lon, kind = F.col("lat"), F.col("lon"), F.col("content_type")
    reasons = {
        "out_of_bounds": ~(F.coalesce(lat.between(-90, 90), F.lit(True)) & F.coalesce(lon.between(-180, 180), F.lit(True))),
        "not_an_image": F.coalesce(kind, F.lit("")).rlike("^(?!image/).+"),
        "empty": F.coalesce(F.length("content"), F.lit(0)) == 0,
    }
    if width:
        reasons["undecodable"] = F.col(width).isNull()
    return rejects(df, reasons)


def only_pairs(df: DataFrame) -> DataFrame:
    """With ``lat`` and ``lon`` null where one of them is missing."""
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return df.withColumns({"lat": F.when(both, F.col("lat")), "lon": F.when(both, F.col("lon"))})


def overlap(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """(key, overlap): how many distinct values of each key both sets have; all should be 0."""
    out = None
    for k in keys:
        both = a.select(k).where(F.col(k).isNotNull()).intersect(b.select(k))
        row = both.agg(F.lit(k).alias("key"), F.count("*").alias("overlap"))
        out = row if out is None else out.unionByName(row)
    return out


def taxonomy_changes(old: DataFrame, new: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, change): added, removed, or the names of fields that differ (nulls compare equal)."""
    o = old.select(key, F.struct(*fields).alias("o"))
    n = new.select(key, F.struct(*fields).alias("n"))
    differing = F.concat_ws(",", *[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields])
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise(differing)
    return o.join(n, key, "full").select(key, change.alias("change")).where("change <> ''")


def same_order(a: DataFrame, b: DataFrame, value: str, order: str) -> bool:
    """Whether two class dimensions list the same values in the same order."""
    first, second = a.select(order, value), b.select(order, value)
    return first.exceptAll(second).isEmpty() and second.exceptAll(first).isEmpty()


def provenance(files: DataFrame) -> DataFrame:
    """(path, sha256) of input files read with the binaryFile source."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))
