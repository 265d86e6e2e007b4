"""The trie of conversations' prefixes: what turns they share, and what sharing saves."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, ship, stored

#: Ids that are put in order together before they are digested.
_TOGETHER = 4096
_NODE = ["depth", "h1", "h2"]
#: The digest of no ids.
NOTHING = hashlib.sha256(b"").hexdigest()


def _within(df: DataFrame, key: list[str], order: list[Column], wanted) -> DataFrame:
    """``df`` with running values over the rows of each key in order; no key is one task's alone.

    Rows are dealt by ranges of (key, order) and kept in the shared folder.  A range computes over its
    own rows; only keys that lie in several ranges, two a range at most, need what their earlier
    ranges hold, and that little table is broadcast.  ``wanted`` gives, by name, (aggregate,
    column, how to put the earlier and the own value together, whole): a running value, or where
    ``whole`` is set, that of all the key's rows.
    """
    dealt = cut(df.repartitionByRange(*[F.col(c) for c in key], *order).withColumn("part", F.spark_partition_id()))
    totals = [f(c).alias(n) for n, (f, c, _, _) in wanted.items()]
    parts = dealt.groupBy(*key, "part").agg(*totals)
    span = Window.partitionBy(*key)
    several = parts.withColumn("several", F.min("part").over(span) < F.max("part").over(span)).where("several")
    earlier = span.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    named = {n: (F.sum if f is F.count else f)(n) for n, (f, _, _, _) in wanted.items()}
    carried = several.select(*key, "part", *[named[n].over(span if wanted[n][3] else earlier).alias(f"{n}_before") for n in wanted])
    own = Window.partitionBy(*key, "part")
    running = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    there = dealt.select("*", *[f(c).over(own if whole else running).alias(n) for n, (f, c, _, whole) in wanted.items()])
    met = there.join(F.broadcast(carried), [*key, "part"], "left")
    put = [F.when(F.col(f"{n}_before").isNull(), F.col(n)).otherwise(join(F.col(f"{n}_before"), F.col(n))).alias(n) for n, (_, _, join, _) in wanted.items()]
    return met.select(*df.columns, *put)


def _add(a, b):
    return a + b


def _xor(a, b):
    return a.bitwiseXOR(b)


def number_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """Each turn as a short row: conv_id, position (from 1), r1, r2, tokens.

    Turns go by number, null first; turns that share one go by a hash of role and text.  ``r1`` and
    ``r2`` are 128 bits of hash that stand for role and text (null: empty) from here on.  ``tokens``
    says what a turn weighs, by default its text's code points.  Rows without a conversation's
    id belong to none and are left out; other columns are ignored.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    weight = F.char_length(text) if tokens is None else tokens
    short = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("r1"), F.xxhash64(F.lit("again"), role, text).alias("r2"), weight.cast("long").alias("tokens"))
    order = [F.asc_nulls_first("turn"), F.asc("r1"), F.asc("r2")]
    placed = _within(short, ["conv_id"], order, {"position": (F.count, F.lit(1), _add, False)})
    return placed.select("conv_id", "position", "r1", "r2", "tokens")


def _digests(batches):
    """SHA-256 of each node's ids as they stream by; only a running digest is held."""
    now, running = None, None

    def told(key):
        return pa.RecordBatch.from_pydict({"depth": pa.array([key[0]], pa.int64()), "h1": pa.array([key[1]], pa.int64()), "h2": pa.array([key[2]], pa.int64()), "ends_sha256": [running.hexdigest()]})

    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids"))):
            if key != now:
                if now is not None:
                    yield told(now)
                now, running = key, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
    if now is not None:
        yield told(now)


def _ends(paths: DataFrame) -> DataFrame:
    """(depth, h1, h2, ends_sha256): a digest of the ids that end at each node.

    Ids are put in order and joined by blocks of a fixed range of ids; a node's blocks then stream
    in order through one digest, which by its nature reads them one after the other.
    """
    block = F.floor(F.col("conv_id") / _TOGETHER)
    blocks = paths.where("depth = length").groupBy(*_NODE, block.alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return blocks.repartition(*_NODE).sortWithinPartitions(*_NODE, "block").select(*_NODE, "ids").mapInArrow(_digests, "depth long, h1 long, h2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One row a distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    ``turns`` is as ``number_turns`` gives it, positions from 1 without gaps; ``members`` (conv_id)
    may name conversations without turns too.  A prefix is known by 128 bits: the exclusive or of
    hashes of its turns with their places.  It is owned by its smallest member, so with its depth
    ``conv_id`` names it; what a conversation owns is a suffix of its path, as
    members only become fewer.  Windows over (prefix, conversation), dealt by ranges so that a hot
    prefix is many tasks' work, mark what is owned, and from where: one row a conversation.
    Each member of a prefix then adds its tokens from there to the place where its own suffix begins (the
    tokens of all its turns below, less those it owns), and one if its last node is its own
    and has no children; one aggregate by prefix sums these up.  No subtree is ever walked.

    Ids are distinct conversations.  An empty table without members gives no rows.
    """
    ship(turns.sparkSession)
    every = turns.select("conv_id").distinct() if members is None else members.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id is not null").union(turns.select("conv_id")).distinct()
    root = every.select("conv_id", F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("z1"), F.lit(0).cast("long").alias("z2"), F.lit(0).cast("long").alias("tokens"))
    place = turns.select("conv_id", F.col("position").cast("long").alias("position"), F.xxhash64("position", "r1", "r2").alias("z1"), F.xxhash64(F.lit("again"), "position", "r1", "r2").alias("z2"), "tokens")
    along = _within(
        root.union(place),
        ["conv_id"],
        [F.asc("position")],
        {"h1": (F.bit_xor, F.col("z1"), _xor, False), "h2": (F.bit_xor, F.col("z2"), _xor, False), "upto": (F.sum, F.col("tokens"), _add, False), "length": (F.max, F.col("position"), F.greatest, True)},
    )
    steps = along.select("conv_id", F.col("position").alias("depth"), "h1", "h2", "upto", (F.col("upto") - F.col("tokens")).alias("before"), "length")
    paths = stored(
        _within(steps, _NODE, [F.asc("conv_id")], {"place": (F.count, F.lit(1), _add, False), "owner": (F.min, F.col("conv_id"), F.least, True), "deepest": (F.max, F.col("length"), F.greatest, True)}),
        "trie-paths",
    )
    last = (F.col("depth") == F.col("length")) & (F.col("deepest") == F.col("depth"))
    owners = paths.where("place = 1").groupBy("conv_id").agg(F.min("depth").alias("own_from"), F.min_by("before", "depth").alias("own_before"), F.max(last.cast("long")).alias("leaf"))
    told = paths.join(owners, "conv_id", "left")
    shared = F.when(F.col("own_from").isNull(), F.col("total")).otherwise(F.greatest(F.col("own_before"), F.col("before")))
    whole = paths.where("depth = length").select("conv_id", F.col("upto").alias("total"))
    told = told.join(whole, "conv_id").withColumn("saved", shared - F.col("before"))
    nodes = told.groupBy(*_NODE).agg(
        F.min("owner").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.count_if((F.col("own_from") <= F.col("depth") + 1) & (F.col("length") > F.col("depth"))).alias("n_children"),
        F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_conv_id"))
    out = nodes.join(_ends(paths), _NODE, "left").join(above, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def with_shared_beginnings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns rebuilt so that conversations share beginnings, and all conversations' ids.

    Conversation c begins with the first h turns of conversation c - c % 100, all if it has fewer,
    and goes on with its own turns after its first h; h is the CRC-32 of the decimal id modulo 6.
    ``turns`` is as ``number_turns`` gives it.
    """
    convs = turns.select("conv_id").distinct().select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    first = turns.where("conv_id % 100 = 0 and position <= 5").groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("position", "r1", "r2", "tokens"))).alias("first"))
    begun = convs.join(first, "base", "left").select("conv_id", "h", F.filter(F.coalesce("first", F.array().cast("array<struct<position:long,r1:long,r2:long,tokens:long>>")), lambda t: t["position"] <= F.col("h")).alias("first"))
    begun = cut(begun)
    heads = begun.select("conv_id", F.explode("first").alias("t")).select("conv_id", "t.position", "t.r1", "t.r2", "t.tokens")
    rest = turns.join(begun.select("conv_id", "h", F.size("first").alias("n")), "conv_id").where("position > h").select("conv_id", (F.col("position") - F.col("h") + F.col("n")).alias("position"), "r1", "r2", "tokens")
    return heads.union(rest), begun.select("conv_id")
