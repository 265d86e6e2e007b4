"""What several corpus operators share: membership filters, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.membership import membership, with_membership
from lodestone.shipping import ship
from lodestone.storage import cut, new_folder, remove, shared_dir, stored

__all__ = ["ASCII_SPACE", "connected_components", "cut", "membership", "new_folder", "remove", "shared_dir", "ship", "stored", "text_or_empty", "with_membership", "without"]

#: White space of the contracts: space and U+0009 to U+000D.
ASCII_SPACE = r"[\x20\x09-\x0D]"


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


_FLAG = "__lodestone_flag"
#: A table of ids and hashes of at most this many rows (some 5 MB) is broadcast.
BROADCAST_ROWS = 200_000


def without(docs: DataFrame, gone: DataFrame, hashed: Column, key: str, same: Column) -> DataFrame:
    """``docs`` anti-joined with ``gone`` (stored) on ``same``, which must imply that ``hashed`` of
    a document equals ``key`` of the row that removes it.

    A few rows are broadcast.  Beyond that, only documents that the filter cannot clear meet the
    others in a shuffle, so the texts of a corpus with few copies stay where they are.
    """
    if gone.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(gone), same, "left_anti")
    flagged = with_membership(docs, hashed, membership(gone, key), _FLAG)
    clear = flagged.where(~F.col(_FLAG)).drop(_FLAG)
    return clear.unionByName(flagged.where(F.col(_FLAG)).drop(_FLAG).join(gone, same, "left_anti"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): the smallest node each node reaches over undirected ``edges(a, b)``.

    Each round hooks every node to its smallest neighbour, follows two pointers, and contracts the
    edges onto the parents; parents that are not roots yet keep an edge to theirs, so nothing is
    lost.  Rounds grow with the logarithm of the longest chain.  Only aggregates with a map-side
    part and equi-joins (which adaptive execution splits when a hub is hot) are used; no component
    or neighbour list is ever gathered.  Self-loops and null ends are ignored.
    """
    shared_dir(edges.sparkSession)
    live = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    labels = live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("component", F.col("node"))
    first = True
    while first or not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")))
        step = hook.select(F.col("node").alias("n2"), F.col("up").alias("up2"))
        jump = hook.join(step, F.col("up") == F.col("n2"), "left").select("node", F.coalesce("up2", "up").alias("up"))
        jump = cut(jump)
        at_a = jump.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        at_b = jump.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = live.join(at_a, "a").join(at_b, "b").select(F.col("ua").alias("x"), F.col("ub").alias("y"))
        chain = jump.join(at_a.select(F.col("a").alias("n2"), F.col("ua").alias("up2")), F.col("up") == F.col("n2")).select(F.col("up").alias("x"), F.col("up2").alias("y"))
        live = cut(
            moved.union(chain).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        to = jump.select(F.col("node").alias("n2"), F.col("up").alias("up2"))
        labels = cut(labels.join(to, F.col("component") == F.col("n2"), "left").select("node", F.coalesce("up2", "component").alias("component")))
        first = False
    return labels
