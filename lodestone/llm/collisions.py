"""Nearest neighbours by inner product with collision-counting hashing over sorted projections."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import comb, erf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import BROADCAST_ROWS, cut, ship, stored
from lodestone.llm.lattice import unit_rows

#: Single projections, half a window's width in units of the radius, the share of vectors at the
#: radius that must pass the collision threshold, and the seed of the projections.
PROJECTIONS, HALF_WIDTH, PASSES, SEED = 64, 1.0, 0.97, 11
#: Radii of virtual rehashing: distances of unit vectors whose cosines fall by steps.
RADII = np.sqrt(2 - 2 * np.array([0.99, 0.96, 0.9, 0.8, 0.7, 0.6, 0.5, 0.42, 0.34, 0.26, 0.18, 0.1, 0.0, -0.2, -1.0]))
#: Components that a chunk of sorted arrays may hold (8 MB in double precision), and queries that meet it at once.
CHUNK, TOGETHER = 1 << 20, 4096
#: Cells at most, and components of their centres at most (8 MB): what is sent to every task.
MOST_CELLS, MOST_CENTRE = 1024, 1 << 20
#: Queries whose neighbours are searched in all cells to see how many cells a search must visit,
#: and the share of those neighbours that must lie in these cells.
SAMPLE, IN_CELLS = 256, 0.98


@lru_cache(maxsize=8)
def threshold(projections: int = PROJECTIONS, half_width: float = HALF_WIDTH, passes: float = PASSES) -> int:
    """The collisions that a vector at the radius has with probability ``passes`` at least."""
    p = erf(half_width / 2**0.5)
    left, k = 0.0, 0
    while True:
        left += comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if left > 1 - passes:
            return max(k, 1)
        k += 1


def _vectors(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1).astype(np.float64)


class Sorted:
    """A chunk's vectors with one sorted array a projection.

    Inner products become distances of unit vectors: with M the largest norm of the chunk, x turns into
    x/M and one more component that makes its length 1, and a query into its direction.
    """

    def __init__(self, x: np.ndarray, projections: int = PROJECTIONS, seed: int = SEED):
        self.x = x
        self.scale = float(np.abs(x).max()) or 1.0
        y = x / self.scale
        norms = np.sqrt((y * y).sum(axis=1))
        self.most = float(norms.max()) or 1.0
        y = y / self.most
        rest = np.sqrt(np.maximum(0.0, 1 - (norms / self.most) ** 2))
        basis = np.random.default_rng((seed, x.shape[1])).standard_normal((x.shape[1] + 1, projections))
        hashed = (y @ basis[:-1] + rest[:, None] * basis[-1]).T
        self.basis = basis[:-1]
        self.order = np.argsort(hashed, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(hashed, self.order, axis=1)

    def search(self, queries: np.ndarray, bounds: np.ndarray, k: int, low: np.ndarray, half_width: float = HALF_WIDTH, passes: float = PASSES) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (rows, scores) of its k nearest found, ties to the least ``low``.

        Windows round the query's projections start narrow and are widened radius by radius; a
        vector in enough of them is a candidate, and its product is computed from the vectors as
        they are.  The search ends once k candidates lie within the radius.  A query that knows k
        vectors of inner product ``bounds`` starts at that radius and ends there.
        """
        size = np.abs(queries).max(axis=1, keepdims=True)
        norm = np.sqrt(((queries / size) ** 2).sum(axis=1))
        unit = queries / size / norm[:, None]
        with np.errstate(over="ignore"):
            reach = bounds / size[:, 0] / norm / self.scale / self.most  # the cosine that a vector must have
        out = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        free, bound = np.flatnonzero(np.isneginf(reach)), np.flatnonzero((reach <= 1 + 1e-9) & ~np.isneginf(reach))
        for rows, radii in ((free, np.broadcast_to(RADII, (len(free), len(RADII)))), (bound, np.sqrt(np.maximum(0.0, 2 - 2 * reach[bound]))[:, None] * (1 + 1e-9) + 1e-9)):
            for a in range(0, len(rows), 256):
                part = rows[a : a + 256]
                for q, found in zip(part, self._widened(unit[part], radii[a : a + 256], k, half_width, passes)):
                    with np.errstate(over="ignore", invalid="ignore"):
                        scores = (self.x[found] * queries[q]).sum(axis=1)
                    best = np.lexsort((low[found], -scores))[:k]
                    out[q] = found[best], scores[best]
        return out

    def _widened(self, unit: np.ndarray, radii: np.ndarray, k: int, half_width: float, passes: float):
        """The rows that may be among each query's k nearest, by windows of its radii in turn."""
        n, least = len(self.x), threshold(len(self.values), half_width, passes)
        hashed, reach = (unit @ self.basis).T[:, :, None], half_width * radii
        reach = np.where(radii >= RADII[-1], np.inf, reach)
        low = np.stack([np.searchsorted(v, h - reach) for v, h in zip(self.values, hashed)]).astype(np.int32)
        high = np.stack([np.searchsorted(v, h + reach, side="right") for v, h in zip(self.values, hashed)]).astype(np.int32)
        for q in range(len(unit)):
            counts, fresh = np.zeros(n, np.int64), np.ones(n, bool)
            found, near = [], []
            target = unit[q] / self.scale / self.most
            before = None
            for j, r in enumerate(radii[q]):
                a, b = low[:, q, j].tolist(), high[:, q, j].tolist()
                if before is None:
                    pieces = [o[x:y] for o, x, y in zip(self.order, a, b)]
                else:
                    pieces = [o[x:y] for o, x, y in zip(self.order, a, before[0])] + [o[x:y] for o, x, y in zip(self.order, before[1], b)]
                before = a, b
                counts += np.bincount(np.concatenate(pieces), minlength=n)
                now = np.flatnonzero((counts >= least) & fresh)
                fresh[now] = False
                found.append(now)
                near.append(self.x[now] @ target)
                if radii.shape[1] > 1 and sum(int((s >= 1 - r * r / 2).sum()) for s in near) >= k:
                    break
            rows, rough = np.concatenate(found), np.concatenate(near)
            if len(rows) > k:  # a product's last bits depend on what it was computed with
                edge = np.partition(rough, len(rows) - k)[len(rows) - k]
                rows = rows[rough >= edge - 1e-12]
            yield rows


def _searched(k: int, dtype: str, asked: str):
    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        qids, cids, lows, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            cid, low = (left.column(c).to_numpy() for c in ("cid", "low"))
            bounds = right.column("bound").to_numpy()
            for q, (rows, s) in zip(right.column("qid").to_numpy(), Sorted(_vectors(left.column("vec"), dtype)).search(_vectors(right.column("qvec"), asked), bounds, k, low)):
                lows.append(low[rows])
                qids.append(np.full(len(rows), q))
                cids.append(cid[rows])
                scores.append(s)
        return pa.table({"qid": np.concatenate(qids), "cid": np.concatenate(cids), "low": np.concatenate(lows), "score": np.concatenate(scores)})

    return group


def _packed(dtype: str):
    """Vectors as bytes: (cid, low, dim, vec)."""

    def run(batches):
        for batch in batches:
            vectors = batch.column("vector")
            flat, at = vectors.flatten().to_numpy(zero_copy_only=False).astype(dtype), np.concatenate([[0], np.cumsum(np.diff(vectors.offsets.to_numpy()))])
            out = [pa.array([flat[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()), pa.array(np.diff(at), pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("low"), *out], ["cid", "low", "vec", "dim"])

    return run


def _by_dim(batch, dtype: str):
    """(dim, rows, their vectors) of a batch with ``dim`` and ``vec``."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        yield int(dim), rows, _vectors(batch.column("vec").take(pa.array(rows)), dtype)


def _into_cells(centres: dict[int, np.ndarray], dtype: str, visits: int):
    """With each vector's ``visits`` nearest cells by direction, and how near they come (from 0)."""

    def run(batches):
        for batch in batches:
            for dim, rows, x in _by_dim(batch, dtype):
                c = centres.get(dim)
                cells = np.zeros((len(x), 1), np.int32) if c is None else np.argsort(-(unit_rows(x) @ c.T), axis=1, kind="stable")[:, :visits].astype(np.int32)
                part = batch.take(pa.array(np.repeat(rows, cells.shape[1])))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells.ravel()), pa.array(np.tile(np.arange(cells.shape[1], dtype=np.int32), len(x)))], [*part.schema.names, "cell", "nth"])

    return run


def _true_cells(centres: dict[int, np.ndarray], dtype: str, sample: dict[int, np.ndarray], k: int):
    """For each sampled query the task's k best products, and which of the query's cells holds each."""

    def run(batches):
        places = {d: np.argsort(np.argsort(-(unit_rows(q) @ centres[d].T), axis=1, kind="stable"), axis=1) for d, q in sample.items()}
        for batch in batches:
            for dim, rows, x in _by_dim(batch, dtype):
                if dim not in sample:
                    continue
                cells = (unit_rows(x) @ centres[dim].T).argmax(axis=1)
                scores = sample[dim] @ x.T
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                n, at = best.shape
                query = np.repeat(np.arange(n), at)
                yield pa.RecordBatch.from_pydict({"dim": pa.array(np.full(n * at, dim, np.int32)), "query": pa.array(query.astype(np.int32)), "score": pa.array(np.take_along_axis(scores, best, 1).ravel()), "nth": pa.array(places[dim][query, cells[best.ravel()]].astype(np.int32))})

    return run


@dataclass
class Index:
    """An index of vectors: equal vectors once (``classes``: cid, low, dim, vec, cell, chunk), their
    rows (``members``: cid, vec_id, the ``k`` + 1 least a class), and the cells' centres by width."""

    classes: DataFrame
    members: DataFrame
    chunks: DataFrame
    centres: dict[int, np.ndarray]
    dtype: str
    k: int


def _usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    good = rows.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("vector"))
    return good.select("vec_id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("again"), "vector").alias("h2"))


def _kind(table: DataFrame, vector_col: str) -> str:
    # single-precision components are sent as they are; all arithmetic is in double precision
    kind = table.schema[vector_col].dataType
    return "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"


def build_index(table: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", chunk: int = CHUNK) -> Index:
    """Indexes every vector for searches of up to ``k`` neighbours.

    Equal vectors are collapsed into one class (two vectors are equal if 128 bits of hash are), of
    which the k + 1 least ids are kept, as no search can give more.  Classes lie in the cell of the centre whose
    direction is nearest; centres are a bounded sample of the vectors (``MOST_CELLS``, by
    hash), and a cell that outgrows a chunk is cut into several by hash, so that sorted arrays
    stay small however hot a cell is.
    """
    spark = table.sparkSession
    ship(spark)
    dtype, good = _kind(table, vector_col), _usable(table, id_col, vector_col)
    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = good.select("h1", "h2", "vec_id").distinct().withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    classes = good.groupBy("h1", "h2").agg(F.any_value("vector").alias("vector"), F.min("vec_id").alias("low"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "collision-classes")
    members = stored(few.join(classes.select("h1", "h2", "cid"), ["h1", "h2"]).select("cid", "vec_id"), "collision-members")
    packed = stored(classes.select("cid", "low", "vector").mapInArrow(_packed(dtype), "cid long, low long, vec binary, dim int"), "collision-vectors")
    n, widest = packed.agg(F.count("*"), F.max("dim")).first()
    cells = min(-(-2 * n * (widest or 1) // chunk), MOST_CELLS, MOST_CENTRE // (widest or 1)) or 1
    drawn: dict[int, list] = {}
    for r in packed.orderBy(F.xxhash64("cid", F.lit(SEED)), "cid").limit(int(cells)).select("dim", "vec").collect():
        drawn.setdefault(r["dim"], []).append(np.frombuffer(r["vec"], dtype))
    centres = {d: unit_rows(np.array(v, np.float64)) for d, v in drawn.items()}
    homes = packed.mapInArrow(_into_cells(centres, dtype, 1), "cid long, low long, vec binary, dim int, cell int, nth int").drop("nth")
    homes = stored(homes, "collision-cells")
    chunks = cut(homes.groupBy("dim", "cell").agg(F.ceil(F.count("*") * F.first("dim") / chunk).cast("int").alias("chunks")))
    dealt = homes.join(_little(chunks), ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")).drop("chunks")
    return Index(stored(dealt, "collision-index"), members, chunks, centres, dtype, k)


def cells_to_visit(index: Index, queries: DataFrame, asked: str, sample: int = SAMPLE, share: float = IN_CELLS) -> int:
    """How many of its nearest cells a query must visit so that ``share`` of its neighbours lie there.

    It is measured: ``sample`` queries, by hash, meet all vectors, and the cells of their true
    neighbours are looked up.
    """
    most = max((len(c) for c in index.centres.values()), default=1)
    if most == 1:
        return 1
    drawn: dict[int, list] = {}
    for r in queries.where(F.col("dim").isin(*index.centres)).orderBy(F.xxhash64("qid", F.lit(SEED)), "qid").limit(sample).select("dim", "qvec").collect():
        drawn.setdefault(r["dim"], []).append(np.frombuffer(r["qvec"], asked))
    if not drawn:
        return 1
    sampled = {d: np.array(v, np.float64) for d, v in drawn.items()}
    true = index.classes.select("vec", "dim").mapInArrow(_true_cells(index.centres, index.dtype, sampled, index.k), "dim int, query int, score double, nth int")
    best = true.withColumn("place", F.row_number().over(Window.partitionBy("dim", "query").orderBy(F.desc("score")))).where(F.col("place") <= index.k)
    counts = best.groupBy("nth").count().orderBy("nth").collect()  # a row a cell at most
    total, upto = sum(r["count"] for r in counts), 0
    for r in counts:
        upto += r["count"]
        if upto >= share * total:
            return r["nth"] + 1
    return most


def _little(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast, if that few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _meet(index: Index, visits: DataFrame, k: int, asked: str) -> DataFrame:
    """(qid, cid, low, score): what each query finds in each chunk of the cells that it visits."""
    place = ["dim", "cell", "chunk", "part"]
    load = cut(visits.groupBy("dim", "cell").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts")).join(index.chunks, ["dim", "cell"]))
    load = _little(load)
    dealt = visits.join(load, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*place, "qid", "qvec", "bound")
    there = index.classes.join(load.drop("chunks"), ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*place, "cid", "low", "vec")
    return there.groupBy(*place).cogroup(dealt.groupBy(*place)).applyInArrow(_searched(k, index.dtype, asked), "qid long, cid long, low long, score double")


def search(index: Index, queries: DataFrame, k: int | None = None, visits: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest vectors found, without its own id.

    Nearness is the inner product in double precision of the vectors as they are; ties go to the
    smaller vec_id.  A query first searches the chunks of its nearest cell, which bounds what a nearer
    vector must have, and then the chunks of further cells within that bound (see
    ``Sorted.search``); how many cells is measured (``cells_to_visit``) unless given.  Equal
    queries are searched once.  A chunk and a bounded part of its queries are one group.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
    rows with a null id; vectors of different lengths never meet.  Rows that repeat an id and a
    vector are one; an id with several vectors is several candidates and its queries each
    vector's.  Products that overflow are infinite.  Empty tables give no rows.
    """
    k = index.k if k is None else k
    if k > index.k:
        raise ValueError(f"the index serves up to {index.k} neighbours")
    ship(queries.sparkSession)
    kind, asked = _kind(queries, vector_col), _usable(queries, id_col, vector_col)
    distinct = asked.groupBy("h1", "h2").agg(F.any_value("vector").alias("vector")).withColumn("cid", F.monotonically_increasing_id())
    named = stored(distinct, "collision-queries")
    packed = named.select("cid", F.lit(0).cast("long").alias("low"), "vector").mapInArrow(_packed(kind), "cid long, low long, vec binary, dim int")
    packed = stored(packed.select(F.col("cid").alias("qid"), F.col("vec").alias("qvec"), "dim"), "collision-query-vectors")
    visits = cells_to_visit(index, packed, kind) if visits is None else visits
    to = packed.select("qid", F.col("qvec").alias("vec"), "dim").mapInArrow(_into_cells(index.centres, kind, visits), "qid long, vec binary, dim int, cell int, nth int")
    to = stored(to.withColumnRenamed("vec", "qvec"), "collision-visits")
    first = cut(_meet(index, to.where("nth = 0").withColumn("bound", F.lit(float("-inf"))), k + 1, kind))
    found = first
    if visits > 1:
        best = Window.partitionBy("qid").orderBy(F.desc("score"))
        known = first.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k + 1).select("qid", F.col("score").alias("known"))
        further = to.where("nth > 0").join(known, "qid", "left").withColumn("bound", F.coalesce("known", F.lit(float("-inf")))).drop("known")
        found = first.union(_meet(index, further, k + 1, kind))
    top = found.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "low"))).where(F.col("nth") <= k + 1).select("qid", "cid", "score")
    ids = top.join(index.members, "cid").withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= k + 1)
    lists = ids.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))), lambda s: F.struct(s["vec_id"].alias("vec_id"), s["score"].alias("score"))).alias("near"))
    each = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().join(named.select("h1", "h2", F.col("cid").alias("qid")), ["h1", "h2"])
    own = each.join(lists, "qid").select("query_id", F.slice(F.filter("near", lambda s: s["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("rank", "s")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "s.vec_id", "s.score")
