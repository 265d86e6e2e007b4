"""SimHash near-duplicate groups by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import connected_components, cut, ship, stored, text_or_empty, without

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
_BLOCK = 65_536
#: Fingerprints that meet on a variant are compared with one another up to this many.
FEW = 8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint as an unsigned integer; zero without words.

    Words are runs of what is not ASCII white space, with A-Z in lower case; shingles of
    ``shingle`` words, repeats included, are hashed with XXH64 (seed 42).
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for a in range(0, n, _BLOCK):  # a very long text needs no more memory than a block
        part = words[a : a + _BLOCK + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], ["doc_id", "locator", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, locator, fp): the fingerprint of each row's whole text as a signed 64-bit integer.

    The locator is a hash of the text that, with the id, finds the row again.
    """
    ship(docs.sparkSession)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("locator"), text.alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, locator long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(bits: list[int], radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)]


def half_ball(radius: int) -> list[tuple[int, int]]:
    """(keep, flip) masks: a fingerprint's variants are ``(fp & keep) ^ flip``.

    Half of an odd radius is not whole: two balls of radius (radius-1)/2 meet only up to
    radius-1.  So the bits are cut into three blocks and each block in turn is left out: two
    fingerprints that differ in 1 to radius bits differ in at most radius-1 bits outside some
    block, and their balls over the other bits meet.
    """
    half = radius // 2
    if radius % 2 == 0:
        return [(_signed((1 << BITS) - 1), _signed(f)) for f in _flips(list(range(BITS)), half)]
    blocks = [list(range(BITS))[i * BITS // 3 : (i + 1) * BITS // 3] for i in range(3)]
    out = []
    for block in blocks:
        mask = sum(1 << b for b in block)
        # the left-out bits are set alike, which tells the three kinds of key apart
        out += [(_signed(((1 << BITS) - 1) ^ mask), _signed(f | mask)) for f in _flips([b for b in range(BITS) if b not in block], half)]
    return out


def _table(values: list[tuple[int, ...]], names: tuple[str, ...]):
    """A constant array of structs, folded to one literal when the query is planned."""
    rows = ",".join("{" + ",".join(f'"{n}":{v}' for n, v in zip(names, row)) + "}" for row in values)
    return F.from_json(F.lit(f"[{rows}]"), f"array<struct<{','.join(f'{n}:bigint' for n in names)}>>")


def _met(fps: DataFrame, radius: int) -> DataFrame:
    """(variant, fp, crowded, near): fingerprints that meet others on a variant.

    ``near`` holds those of the up to ``FEW`` fingerprints before this one on the variant, and the
    first there, that are within the radius; the variant is crowded if more than ``FEW`` meet on it.
    Fingerprints that meet others by accident only, and few of them, are left out.
    """
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt by number: a few megabytes of fingerprints become very many variants
    dealt = fps.select("fp").repartition(parts, "fp").distinct()
    variants = dealt.select("fp", F.explode(_table(half_ball(radius), ("keep", "flip"))).alias("m")).select(F.col("m.keep").bitwiseAND(F.col("fp")).bitwiseXOR(F.col("m.flip")).alias("variant"), "fp")
    same = Window.partitionBy("variant").orderBy("fp")
    # with FEW neighbours on each side in view, the count is exact up to FEW + 1
    met = variants.withColumn("n", F.count("*").over(same.rowsBetween(-FEW, FEW))).where("n > 1")
    seen = met.withColumns({"before": F.collect_list("fp").over(same.rowsBetween(-FEW, -1)), "first": F.first("fp").over(same.rowsBetween(Window.unboundedPreceding, 0))})
    near = F.filter(F.array_union("before", F.array("first")), lambda x: (x != F.col("fp")) & (F.bit_count(x.bitwiseXOR(F.col("fp"))) <= radius))
    return cut(seen.select("variant", "fp", (F.col("n") > FEW).alias("crowded"), near.alias("near")).where("crowded or size(near) > 0"))


def _starred(busy: DataFrame, radius: int) -> DataFrame:
    """Edges that connect exactly those of ``busy`` (fp) that are within the radius of each other.

    Each emits its full 64-bit variants within both halves of the radius, 1 and 2 (2,081 at radius
    3).  Whoever meets a fingerprint that is within the smaller half of a variant is within the
    radius of it; each is linked to the least such, so pairs are never enumerated.
    """
    parts = int(busy.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small, large = radius // 2, radius - radius // 2
    inner = {_signed(f) for f in _flips(list(range(BITS)), small)}
    ball = [(_signed(f), int(_signed(f) in inner)) for f in _flips(list(range(BITS)), large)]
    around = busy.repartition(parts, "fp").select("fp", F.explode(_table(ball, ("flip", "near"))).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m.flip")).alias("variant"), "fp", F.when(F.col("m.near") == 1, F.col("fp")).alias("centre"))
    starred = around.withColumn("centre", F.min("centre").over(Window.partitionBy("variant"))).where("centre is not null and centre <> fp")
    return starred.select(F.col("centre").alias("a"), F.col("fp").alias("b")).distinct()


def _linked(fps: DataFrame, radius: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(edges, groups, more): edges of fingerprints compared where they meet, the components
    (node, component) that these make, and what edges crowded variants add to them, if any can."""
    met = _met(fps, radius)
    edges = cut(met.select("fp", F.explode("near").alias("a")).select("a", F.col("fp").alias("b")).distinct())
    groups = connected_components(edges)
    crowded = met.where("crowded").select("variant", "fp")
    root = F.coalesce("component", "fp")
    rooted = crowded.join(groups, F.col("fp") == F.col("node"), "left").select("variant", "fp", root.alias("root"))
    apart = rooted.groupBy("variant").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select("variant")
    busy = cut(crowded.join(apart, "variant", "left_semi").select("fp").distinct())
    return edges, groups, None if busy.isEmpty() else cut(_starred(busy, radius))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct ``fp`` within ``radius`` bits of each other.

    Every fingerprint emits its half-radius variants (131 at radius 3) and rows meet on the
    variant.  Up to ``FEW`` fingerprints that share a variant are compared with one another (most
    such meetings are accidents).  Where more meet, each is compared with the ``FEW`` before it and
    with the first: a group of near copies mostly becomes one component that way.  Only where
    fingerprints of different components still meet on such a variant, so that a link may be
    missing, do these emit their full balls (see ``_starred``).  Rows stay linear in the number of
    fingerprints, and no link is lost; windows look at neighbours only and spill.
    """
    edges, _, more = _linked(fps, radius)
    return edges if more is None else edges.union(more).distinct()


def components(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, component) of the fingerprints that ``links`` connects."""
    _, groups, more = _linked(fps, radius)
    return groups if more is None else connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def _grouped(docs: DataFrame, radius: int, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, locator, fp), and (fp, root, low): the group of each fingerprint that has one,
    and its least doc_id."""
    rows = cut(fingerprints(docs, shingle, id_col, text_col))
    lowest = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    in_group = components(lowest, radius).select(F.col("node").alias("fp"), F.col("component").alias("root")).join(lowest, "fp")
    group_low = in_group.groupBy("root").agg(F.min("low").alias("group_low"))
    linked = in_group.join(group_low, "root").select("fp", "root", "group_low")
    return rows, stored(lowest.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("group_low", "low").alias("component_id")), "simhash-names")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fp, component_id (smallest doc_id reachable over links).

    Equal fingerprints are collapsed before anything is emitted, so copies never multiply.  Null
    and empty texts have fingerprint zero and are linked like any other; rows with a null id get
    their component too (null only if it has no other id); repeated rows are rows; other columns
    are ignored; an empty table gives no rows.
    """
    rows, named = _grouped(docs, radius, shingle, id_col, text_col)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Names that no table has.
_GONE_ID, _GONE_TEXT = "__lodestone_id", "__lodestone_text"


def keep_first(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with its columns as it was: the one with the smallest id, and of rows
    with that id the one whose text has the least hash.

    What goes is told by id and text, so a row that shares its id with a near copy of something
    stays.  Rows with a null id stay, and so do rows that repeat the survivor's id and text.  Columns
    may have any names but those that begin with ``__lodestone_``.
    """
    rows, named = _grouped(docs, radius, shingle, id_col, text_col)
    members = rows.where("doc_id is not null").join(named.select("fp", "root"), "fp").select("root", F.struct("doc_id", "locator").alias("at"))
    first = members.groupBy("root").agg(F.min("at").alias("first"))
    gone = stored(members.join(first, "root").where("at <> first").select(F.col("at.doc_id").alias(_GONE_ID), F.col("at.locator").alias(_GONE_TEXT)).distinct(), "simhash-gone")
    hashed = F.xxhash64(text_or_empty(text_col))
    return without(docs, gone, hashed, _GONE_TEXT, (F.col(f"`{id_col}`") == F.col(_GONE_ID)) & (hashed == F.col(_GONE_TEXT)))
