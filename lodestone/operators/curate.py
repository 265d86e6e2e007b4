"""Filters, joins, caps, splits and de-duplication that turn raw records into a training manifest.

Wherever the order of records matters it is an explicit column or list of columns (``order``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.membership import membership, with_membership
from lodestone.storage import cut


def _cols(names) -> list:
    return [names] if isinstance(names, (str, Column)) else list(names)


def under_path(ancestry: Column, node: int | str) -> Column:
    """Whether a slash-separated path holds the node as a whole step."""
    return F.coalesce(ancestry, F.lit("")).rlike(rf"(?:^|/){node}(?:/|$)")


def created_since(created: Column, cutoff: str) -> Column:
    return created >= F.to_timestamp_ntz(F.lit(cutoff))


def first_photo(df: DataFrame, photos: str = "photos") -> DataFrame:
    """Observations with a first photo that has an id and a URL, with that photo's columns."""
    first = F.get(F.col(photos), F.lit(0))
    return df.withColumn("photo_id", first["id"]).withColumn("photo_url", first["url"]).where("photo_id is not null and photo_url is not null")


def still_images(media: DataFrame) -> DataFrame:
    return media.where((F.coalesce(F.col("type"), F.lit("")) == "StillImage") | F.coalesce(F.col("format"), F.lit("")).startswith("image"))


def matched(match_type: Column) -> Column:
    return match_type.isNotNull() & (match_type != "NONE")


def first_per_key(df: DataFrame, keys, order, keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each key in order: exact de-duplication, caps, first id wins.

    The row number is pushed below the shuffle as a group limit, so a hot key sends at most
    ``keep`` rows a task.
    """
    rank = F.row_number().over(Window.partitionBy(*_cols(keys)).orderBy(*_cols(order)))
    return df.withColumn("_nth", rank).where(F.col("_nth") <= keep).drop("_nth")


def exclude(df: DataFrame, *sets: tuple[DataFrame, str]) -> DataFrame:
    """Without the rows whose key is in any of the sets; a null key is in none."""
    for ids, key in sets:
        df = df.join(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return df


def of_rank(taxa: DataFrame, wanted: str = "species", column: str = "rank") -> DataFrame:
    return taxa.where(F.col(column) == wanted)


def name_lookup(targets: DataFrame, taxa: DataFrame, order, name: str = "name", key: str = "taxon_id") -> DataFrame:
    """Targets with the first taxon (in ``order``) of their name in any case and of any rank, else null.

    ``order`` is the column, or columns, that hold the order in which taxa were read.
    """
    first = taxa.where(F.col(name).isNotNull()).groupBy(F.lower(name).alias("_name")).agg(F.min_by(key, F.struct(*_cols(order))).alias(key))
    return targets.join(first, F.lower(targets[name]) == F.col("_name"), "left").drop("_name")


def species_ids(targets: DataFrame, taxa: DataFrame, name: str = "name", key: str = "taxon_id", rank: str = "rank") -> DataFrame:
    """(target columns, key): every id of the species whose name is exactly a target's.

    A name may have several ids, and each of them is wanted; targets without any have no row.
    """
    found = of_rank(taxa, column=rank).select(F.col(name).alias("_name"), key).distinct()
    return targets.join(found, targets[name] == F.col("_name")).drop("_name")


def resolve_taxon(targets: DataFrame, candidates: DataFrame, order: str = "position") -> DataFrame:
    """Each target name with its exact match in any case, else its first candidate, else null."""
    exact = F.when(F.lower("name") == F.lower("query"), F.col(order))
    found = candidates.groupBy("query").agg(F.min_by("taxon_id", exact).alias("exact"), F.min_by("taxon_id", order).alias("first"))
    return targets.join(found, "query", "left").select(*targets.columns, F.coalesce("exact", "first").alias("taxon_id"))


def priority_pick(df: DataFrame, keys, kind: str, preference: tuple, order=()) -> DataFrame:
    """Of each key's rows the one whose kind comes first in ``preference``; others are no match."""
    rank = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col(kind))
    return first_per_key(df.where(F.col(kind).isin(*preference)), keys, [rank, *_cols(order)])


def diverse_sample(df: DataFrame, group: str, order, cap: int, target: int) -> DataFrame:
    """At most ``cap`` rows a group in order, then the first ``target`` overall.

    Exclusions come before: only accepted rows count towards the cap.
    """
    return first_per_key(df, group, order, cap).orderBy(*_cols(order)).limit(target)


def running_total(df: DataFrame, order, value: Column, name: str) -> DataFrame:
    """With the sum of ``value`` over all rows before each row in order.

    Nothing meets in one task: rows are dealt by ranges of the order and kept in the shared folder,
    each range adds up its own, and a prefix sum over ranges (a row each) gives where it starts.
    """
    order = _cols(order)
    ranged = cut(df.withColumn("_v", value).repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum("_v").alias("_s"))
    before = sums.select("_range", (F.sum("_s").over(Window.orderBy("_range")) - F.col("_s")).alias("_before"))
    own = F.sum("_v").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_v")
    numbered = ranged.withColumn("_own", own).join(F.broadcast(before), "_range")  # a row a partition
    return numbered.withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_before", "_own", "_v")


def place_in_group(df: DataFrame, group: str, order, name: str) -> DataFrame:
    """With each row's place in its group in order, from 0; the order must tell a group's rows apart.

    A group may be any share of the rows: they are dealt by ranges of group and order and kept in the
    shared folder, each range numbers its own, and the sizes of a group's earlier parts (a row a
    range and group) give where a part starts.
    """
    order = _cols(order)
    ranged = cut(df.repartitionByRange(F.col(group), *[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()))
    parts = ranged.groupBy("_range", F.col(group).alias("_group")).agg(F.count("*").alias("_n"))
    starts = parts.select(F.col("_range").alias("_part"), "_group", (F.sum("_n").over(Window.partitionBy("_group").orderBy("_range")) - F.col("_n")).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order)) - 1
    numbered = ranged.withColumn("_own", own).join(starts, (F.col("_range") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return numbered.withColumn(name, F.col("_start") + F.col("_own")).drop("_range", "_part", "_group", "_start", "_own")


def every_nth_split(df: DataFrame, order, n: int = 5) -> DataFrame:
    """Rows 0, n, 2n ... of the whole order are "val", the others "train"."""
    numbered = running_total(df, order, F.lit(1).cast("long"), "_nth")
    return numbered.withColumn("split", F.when(F.col("_nth") % n == 0, "val").otherwise("train")).drop("_nth")


def page(df: DataFrame, order, offset: int, size: int) -> DataFrame:
    return df.orderBy(*_cols(order)).offset(offset).limit(size)


def pinned(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of a pinned split; none at all is an error, not an empty evaluation."""
    found = df.join(keys.select(key).distinct(), key, "left_semi")
    if found.isEmpty():
        raise ValueError("no row has a pinned key")
    return found


def _place(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed).cast("string")))


def random_split(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """A reproducible split: the ``max(1, int(n * fraction))`` rows with the least hashes are "val".

    The hash is md5 of "key:seed", ties go by key.  Only hashes are ranked, by ranges; the last one
    that is "val" then divides the rows where they are.  Rows with equal keys stay on one side.
    """
    places = df.select(_place(key, seed).alias("h"), F.col(key).alias("k"))
    ranked = running_total(places, ["h", "k"], F.lit(1).cast("long"), "nth")
    last = ranked.where(F.col("nth") == max(1, int(df.count() * fraction)) - 1).select("h", "k").first()
    if last is None:
        return df.withColumn("split", F.lit("train"))
    h, k = _place(key, seed), F.col(key)
    at_most = (h < last["h"]) | ((h == last["h"]) & (k <= last["k"] if last["k"] is not None else k.isNull()))
    if last["k"] is not None:
        at_most = at_most | ((h == last["h"]) & k.isNull())
    return df.withColumn("split", F.when(at_most, "val").otherwise("train"))


def trusted_split(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """The ``split`` column if every row has it and both sides have rows, else a random split."""
    n, known, val, train = df.agg(F.count("*"), F.count("split"), F.count_if(F.col("split") == "val"), F.count_if(F.col("split") == "train")).first()
    return df if n and n == known and val and train else random_split(df.drop("split"), key, fraction, seed)


def preferred_first(df: DataFrame, preferred: Column, key: str, order, limit: int) -> DataFrame:
    """Preferred rows first, each in order; one row a key; then the first ``limit``."""
    ordered = df.withColumn("_other", F.when(preferred, 0).otherwise(1))
    ranks = ["_other", *_cols(order)]
    return first_per_key(ordered, key, ranks).orderBy(*ranks).limit(limit).drop("_other")


def tagged_union(parts: dict[str, DataFrame], tag: str = "category") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def top_n(df: DataFrame, score: Column | str, tie, n: int, ascending: bool = False) -> DataFrame:
    """The n highest (or lowest) scores; null scores are left out; the tie-break is explicit."""
    s = F.col(score) if isinstance(score, str) else score
    return df.where(s.isNotNull()).orderBy(s.asc() if ascending else s.desc(), *_cols(tie)).limit(n)


def top_first_seen(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """(key, n) of the n most frequent keys; of equally frequent ones those seen first come first.

    ``order`` is where a row was seen (``readers.with_scan_order``, or any column that sorts).
    """
    seen = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return seen.orderBy(F.desc("n"), "_first").limit(n).drop("_first")


def class_index(df: DataFrame, slug: str = "slug") -> DataFrame:
    """(slug, class_idx): the position of each distinct slug in sorted order.

    A dimension of classes, so one task ranks it.
    """
    return df.select(slug).where(F.col(slug).isNotNull()).distinct().select(slug, (F.dense_rank().over(Window.orderBy(slug)) - 1).alias("class_idx"))


def metadata_by_slug(df: DataFrame, order: str, last_wins: bool) -> DataFrame:
    """One row of metadata a slug: the last row's (database loader) or the first row's (file loader)."""
    pick = F.max_by if last_wins else F.min_by
    return df.groupBy("slug").agg(*[pick(c, order).alias(c) for c in df.columns if c not in ("slug", order)])


def shortfall(df: DataFrame, group: str, target: int, groups: DataFrame | None = None) -> DataFrame:
    """(group, n) of groups with fewer than ``target`` rows; with ``groups``, those without any too."""
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    if groups is not None:
        n = groups.select(group).distinct().join(n, group, "left").na.fill(0, ["n"])
    return n.where(F.col("n") < target)


def with_species(images: DataFrame, species: DataFrame, key: str, species_key: str) -> DataFrame:
    """Every image with its species' columns; images without one are left out."""
    return images.join(species, images[key] == species[species_key])


def photos_of(photos: DataFrame, observations: DataFrame, key: str, observation_key: str) -> DataFrame:
    """Photos of the observations that were let through; filter and narrow those before."""
    return observations.join(photos, observations[observation_key] == photos[key])


def _hash(column: str) -> Column:
    return F.xxhash64(F.col(column).cast("string"))


def photos_of_kept(photos: DataFrame, observations: DataFrame, key: str, observation_key: str) -> DataFrame:
    """As ``photos_of``, where far more photos than observations are there: a bitmap of the kept
    observations' hashes, of bounded size, is tested as photos are scanned, so photos without a kept
    observation (but for one in sixteen at most) are not shuffled."""
    filtered = with_membership(photos, _hash(key), membership(observations.where(F.col(observation_key).isNotNull()).select(_hash(observation_key).alias("h")).distinct(), "h"), "_kept")
    return photos_of(filtered.where("_kept").drop("_kept"), observations, key, observation_key)


def of_taxa(df: DataFrame, taxa: DataFrame, key: str) -> DataFrame:
    """Rows whose taxon is among the wanted ones, once each."""
    return df.join(taxa.select(key), key, "left_semi")


def backfilled(df: DataFrame, other: DataFrame, key: str, value: str, fallback: Column) -> DataFrame:
    """``value`` of the other table by key, and where that is missing ``fallback`` of this one."""
    return df.join(other.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), fallback))


def with_default(df: DataFrame, other: DataFrame, key: str, value: str, default) -> DataFrame:
    """``value`` of the other table by key, or the default: -1 for a label outside the classes."""
    return df.join(other.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def id_else_name(left: DataFrame, right: DataFrame, left_cols: tuple[str, str, str], right_cols: tuple[str, str, str]) -> DataFrame:
    """(left key, right key) of the first match, null if none: by id where both sides have one, else by name.

    Columns are (key, id, name) of each side; the match with the least right key is the first, and
    rows of one left key share it.  The right side comes down to the least key of each id and of each
    name before it is joined, so a left row meets two rows however many match.
    """
    (lk, lid, lname), (rk, rid, rname) = left_cols, right_cols
    a = left.select(lk, F.col(lid).alias("_lid"), F.col(lname).alias("_lname"))
    b = right.select(F.col(rk).alias("_rk"), F.col(rid).alias("_rid"), F.col(rname).alias("_rname"))
    by_id = b.where("_rid is not null").groupBy("_rid").agg(F.min("_rk").alias("_by_id"))
    by_name = b.where("_rname is not null").groupBy("_rname").agg(F.min("_rk").alias("_any"), F.min(F.when(F.col("_rid").isNull(), F.col("_rk"))).alias("_without"))
    met = a.join(by_id, F.col("_lid") == F.col("_rid"), "left").join(by_name, F.col("_lname") == F.col("_rname"), "left")
    found = F.least("_by_id", F.when(F.col("_lid").isNull(), F.col("_any")).otherwise(F.col("_without")))
    return met.groupBy(lk).agg(F.min(found).alias(rk))


def image_status(df: DataFrame, min_dim: int, key: str, order: str) -> DataFrame:
    """Rows with ``status``: corrupt, too_small, duplicate or ok, decided in that order.

    A corrupt or too small image never claims its hash: the first good one does.  ``order`` (the path)
    tells images apart.
    """
    base = F.when(F.col("width").isNull() | F.col("height").isNull(), "corrupt").when(F.least("width", "height") < min_dim, "too_small").otherwise("ok")
    df = df.withColumn("_base", base)
    # the least order of each hash is an aggregate, so a picture with very many copies is no task's alone
    claims = df.where("_base = 'ok'").groupBy(F.col(key).alias("_hash")).agg(F.min(order).alias("_claim"))
    marked = df.join(claims, F.when(F.col("_base") == "ok", F.col(key)).eqNullSafe(F.col("_hash")) & (F.col("_base") == "ok"), "left")
    status = F.when((F.col("_base") == "ok") & (F.col(order) != F.col("_claim")), "duplicate").otherwise(F.col("_base"))
    return marked.withColumn("status", status).drop("_base", "_hash", "_claim")


def status_counts(images: DataFrame) -> DataFrame:
    """(status, n) of images with ``status`` and ``has_exif``, and as "no_exif" how many kept ones have none."""
    n = images.groupBy("status").agg(F.count("*").alias("n"))
    bare = images.agg(F.lit("no_exif").alias("status"), F.count_if((F.col("status") == "ok") & ~F.coalesce("has_exif", F.lit(False))).alias("n"))
    return n.unionByName(bare)
