"""Near-duplicate vectors by E8 lattice hashing, with cosines verified in double precision."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import connected_components, cut, new_folder, remove, ship, stored

COSINE = 0.95
#: Tables, neighbouring cells probed in each, cells a unit of length, seed of the projections:
#: what small tables of vectors get (see ``plan``).
TABLES, PROBES, SCALE, SEED = 4, 6, 6.0, 7
#: The share of pairs at the threshold that a plan must find, and what it costs to send a vector
#: to a cell, in comparisons of two vectors.
RECALL, SEND = 0.98, 200
#: Vectors compared at once; a larger cell is cut into blocks and every pair of blocks is compared.
BLOCK = 512


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8, the steps to neighbouring cells."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a, b in product((1.0, -1.0), repeat=2):
                v = np.zeros(8)
                v[i], v[j] = a, b
                out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    r = np.rint(x)
    gap = x - r
    odd = np.nonzero(r.sum(axis=1).astype(np.int64) & 1)[0]
    worst = np.abs(gap[odd]).argmax(axis=1)
    r[odd, worst] += np.where(gap[odd, worst] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The closest point of E8 = D8 united with D8 + 1/2 to each row; the first at a tie."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _key(points: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit name of a lattice point; equal names of different points only add candidates."""
    doubled = np.rint(2 * points).astype(np.int64)
    key = np.full(points.shape[:-1], table + 1, dtype=np.int64)
    with np.errstate(over="ignore"):
        for k in range(8):
            key = (key ^ doubled[..., k]) * np.int64(0x5851F42D4C957F2D) + np.int64(0x14057B7EF767814F)
            key ^= key >> np.int64(29)
    return key


class Lattice:
    def __init__(self, dim: int, tables: int, probes: int, scale: float, seed: int):
        rng = np.random.default_rng((seed, dim))
        width = max(dim, 8)
        self.maps = [(np.linalg.qr(rng.standard_normal((width, 8)))[0][:dim] * scale * np.sqrt(width / max(dim, 1)) * np.sqrt(dim / 64), rng.random(8)) for _ in range(tables)]
        self.probes = probes
        self.roots = _roots()

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + probes): each row's home cell, then the nearest neighbouring cells."""
        out = np.empty((len(unit), len(self.maps), 1 + self.probes), dtype=np.int64)
        for t, (basis, offset) in enumerate(self.maps):
            x = unit @ basis + offset
            home = nearest_e8(x)
            far = ((x - home)[:, None, :] - self.roots[None]) ** 2
            near = np.argsort(far.sum(axis=2), axis=1, kind="stable")[:, : self.probes]
            out[:, t, 0] = _key(home, t)
            out[:, t, 1:] = _key(home[:, None, :] + self.roots[near], t)
        return out


def _pairs_at(cosine: float, n: int, dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = unit_rows(rng.standard_normal((n, dim)))
    b = rng.standard_normal((n, dim))
    b = unit_rows(b - (a * b).sum(axis=1, keepdims=True) * a)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


#: Widths at which rates are measured; a width takes those of the largest of these not beyond it.
#: In up to eight dimensions a projection keeps every distance, so that a pair at the threshold is as far
#: apart in each table; in more, some tables bring it nearer, and from 64 on rates hardly change.
WIDTHS = (1, 2, 3, 4, 6, 8, 9, 10, 11, 12, 14, 16, 20, 24, 32, 48, 64)


def width_class(dim: int) -> int:
    return max(w for w in WIDTHS if w <= max(dim, 1))


@lru_cache(maxsize=512)
def _table_rates(cosine: float, probes: int, scale: float, dim: int, n: int = 4000) -> tuple[float, float]:
    """For one table of vectors so wide: how often a pair at the threshold meets, over several
    projections, and how often two random vectors do."""
    if dim == 1:  # a unit vector is one of two
        return 1.0, 0.5
    meet, chance, times = 0.0, 0.0, 4
    for t in range(times):
        cells = Lattice(dim, 1, probes, scale, SEED + t)
        a, b = (cells.keys(x)[:, 0] for x in _pairs_at(cosine, n // times, dim, 8 + t))
        meet += ((b == a[:, :1]).any(axis=1) | (a == b[:, :1]).any(axis=1)).mean() / times
        homes, sizes = np.unique(a[:, 0], return_counts=True)
        at = np.minimum(np.searchsorted(homes, a), len(homes) - 1)
        chance += (np.where(homes[at] == a, sizes[at], 0).sum() - len(a)) / (len(a) * (len(a) - 1.0)) / times
    return float(meet), float(chance)


@lru_cache(maxsize=512)
def plan(n: int, cosine: float = COSINE, probes: int = PROBES, recall: float = RECALL, dim: int = 64) -> tuple[int, float]:
    """(tables, scale) for ``n`` vectors of ``dim`` components.

    With a fixed scale the cells fill up as vectors come in, and comparisons grow with the square
    of their number.  A finer lattice keeps cells small but finds fewer pairs a table, so it needs
    more tables for the same recall.  For each scale the tables follow from the recall at the
    threshold, where pairs are hardest to find, as measured at this width, and the cheapest scale is
    taken: vectors sent plus pairs compared.
    """
    best = None
    for scale in SCALE * 1.2 ** np.arange(14):
        meet, chance = _table_rates(cosine, probes, float(scale), width_class(dim))
        if meet < 0.02:
            break
        tables = max(TABLES if scale == SCALE else 1, int(np.ceil(np.log(1 - recall) / np.log(1 - min(meet, 0.999)))))
        cost = tables * ((1 + probes) * SEND + n * max(chance, 1e-9))
        if best is None or cost < best[0]:
            best = cost, tables, float(scale)
        elif cost > 3 * best[0]:
            break
    return best[1:]


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows over their norms, scaled first so that neither huge nor tiny components overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hash_rows(plans: dict[int, tuple[int, float]], probes: int, seed: int, step: int = 1024):
    """``plans`` gives tables and scale by ``width_class``."""
    made: dict[int, Lattice] = {}

    def run(batches):
        for batch in batches:
            vectors = batch.column("vector")
            lengths = np.diff(vectors.offsets.to_numpy())
            ids = batch.column("cid").to_numpy()
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for dim in np.unique(lengths):
                if int(dim) not in made:
                    tables, scale = plans[width_class(int(dim))]
                    made[int(dim)] = Lattice(int(dim), tables, probes, scale, seed)
                lattice = made[int(dim)]
                rows = np.nonzero(lengths == dim)[0]
                for a in range(0, len(rows), step):
                    part = rows[a : a + step]
                    x = np.stack([flat[starts[r] : starts[r] + dim] for r in part])
                    keys = lattice.keys(unit_rows(x))
                    packed = keys.reshape(len(part), -1)
                    yield pa.RecordBatch.from_pydict({"cid": pa.array(ids[part]), "dim": pa.array(np.full(len(part), dim, np.int32)), "keys": pa.array([row.tobytes() for row in packed], pa.binary()), "cells": pa.array(list(packed), pa.list_(pa.int64()))})

    return run


def _meet(ki: np.ndarray, kj: np.ndarray) -> np.ndarray:
    """For pairs of key arrays, the cell at which a pair is counted: in the first table in which
    one's home is a cell of the other, the lesser such home.  (pairs, 2): table and cell."""
    home_i, home_j = ki[:, :, 0], kj[:, :, 0]
    in_j = (kj == home_i[:, :, None]).any(axis=2)
    in_i = (ki == home_j[:, :, None]).any(axis=2)
    first = (in_i | in_j).argmax(axis=1)
    rows = np.arange(len(ki))
    big = np.iinfo(np.int64).max
    a = np.where(in_j[rows, first], home_i[rows, first], big)
    b = np.where(in_i[rows, first], home_j[rows, first], big)
    return np.stack([first, np.minimum(a, b)], axis=1)


def _leaders(links: np.ndarray) -> np.ndarray:
    """Each row's component in a block's symmetric boolean link matrix, named by its first row."""
    name = np.full(len(links), -1)
    for i in range(len(links)):
        if name[i] < 0 and links[i].any():
            seen = links[i].copy()
            seen[i] = True
            front = seen.copy()
            while front.any():
                front = links[front].any(axis=0) & ~seen
                seen |= front
            name[seen] = i
    return name


def _links(cosine: float, each: int, dtype: str, table: int, cell: int, rows: list[tuple]):
    """What a group's links are: (classes linked, each one's leader, weights), None without any.

    A row is (cid, mult, home, side, vec, keys); pairs on one side only are compared elsewhere.
    """
    cid, mult, home, side, vec, keys = (np.array(c) if k < 4 else c for k, c in enumerate(zip(*rows)))
    x = unit_rows(np.stack([np.frombuffer(v, dtype) for v in vec]).astype(np.float64))
    near = x @ x.T >= cosine
    near &= home[:, None] | home[None, :]
    if (side != side[0]).any():  # two blocks: only pairs across
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    near |= near.T
    linked = np.nonzero(near.any(axis=1))[0]
    if not len(linked):
        return None
    name = _leaders(near)
    weight = np.zeros(len(cid), dtype=np.int64)
    all_keys = np.stack([np.frombuffer(k, "<i8").reshape(-1, each) for k in keys])
    i, j = np.nonzero(np.triu(near))
    for a in range(0, len(i), 65_536):
        p, q = i[a : a + 65_536], j[a : a + 65_536]
        at = _meet(all_keys[p], all_keys[q])
        here = (at[:, 0] == table) & (at[:, 1] == cell)
        np.add.at(weight, p[here], mult[q[here]])
        np.add.at(weight, q[here], mult[p[here]])
    return cid[linked], cid[name[linked]], weight[linked]


_FOUND = "cid long, leader long, weight long"
_ROW = ("cid", "mult", "home", "vec", "keys")


def _told(found):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["cid", "leader", "weight"])


def _compare(cosine: float, each: int, dtype: str):
    """For rows that come cell by cell, each cell small."""

    def flush(key, rows):
        found = _links(cosine, each, dtype, key[1], key[2], rows) if len(rows) > 1 else None
        if found is not None:
            yield _told(found)

    def run(batches):
        now, rows = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in _CELL))
            for key, (cid, mult, home, vec, names) in zip(keys, zip(*(batch.column(c).to_pylist() for c in _ROW))):
                if key != now:
                    if rows:
                        yield from flush(now, rows)
                    now, rows = key, []
                rows.append((cid, mult, home, 0, vec, names))
        if rows:
            yield from flush(now, rows)

    return run


#: Blocks of crowded cells that a worker keeps.
_KEPT = 8


def _compare_blocks(path: str, cosine: float, each: int, dtype: str):
    """For pairs of stored blocks (dim, table, cell, a, b): a task reads two at a time."""

    def run(batches):
        from pyarrow import dataset, fs

        files, at = fs.FileSystem.from_uri(path)
        kept: dict[tuple, list] = {}

        def block(dim: int, table: int, cell: int, side: int) -> list:
            key = (dim, table, cell, side)
            rows = kept.pop(key, None)
            if rows is None:
                folder = f"{at}/dim={dim}/table={table}/cell={cell}/side={side}"
                there = files.get_file_info(folder).type == fs.FileType.Directory
                columns = dataset.dataset(folder, filesystem=files, format="parquet").to_table(columns=list(_ROW)) if there else None
                rows = list(zip(*(columns.column(c).to_pylist() for c in _ROW))) if there else []
            while len(kept) >= _KEPT:
                del kept[next(iter(kept))]
            kept[key] = rows
            return rows

        for batch in batches:
            for dim, table, cell, a, b in zip(*(batch.column(c).to_pylist() for c in (*_CELL, "a", "b"))):
                sides = [(0, block(dim, table, cell, a))] + ([(1, block(dim, table, cell, b))] if a != b else [])
                rows = [(cid, mult, home, side, vec, keys) for side, part in sides for cid, mult, home, vec, keys in part]
                found = _links(cosine, each, dtype, table, cell, rows) if len(rows) > 1 and all(part for _, part in sides) else None
                if found is not None:
                    yield _told(found)

    return run


_CELL = ("dim", "table", "cell")


def _pack_vectors(dtype: str):
    def run(batches):
        for batch in batches:
            vectors = batch.column("vector")
            flat, at = vectors.flatten().to_numpy(zero_copy_only=False).astype(dtype), np.concatenate([[0], np.cumsum(np.diff(vectors.offsets.to_numpy()))])
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("mult"), pa.array([flat[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], ["cid", "mult", "vec"])

    return run


def _class_column(size):
    """``width_class`` as a column."""
    out = F.lit(WIDTHS[0])
    for w in WIDTHS[1:]:
        out = F.when(size >= w, F.lit(w)).otherwise(out)
    return out


def near_vectors(table: DataFrame, cosine: float = COSINE, tables: int | None = None, probes: int = PROBES, scale: float | None = None, seed: int = SEED, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Equal vectors are collapsed into one class with a count, so copies never multiply (two vectors
    are equal if 128 bits of hash are).  Each table projects a class's unit vector to eight random
    dimensions and decodes it to an E8 point, its home cell; the class also visits the nearest
    neighbouring cells.  Classes that meet, at least one of them at home, are compared in double
    precision.  A cell with more than ``block`` classes is cut into blocks by hash, which are stored
    once; each pair of blocks is a row that a task reads the two for, so nothing is copied and no
    task holds more than a few blocks.  A group gives counts and, for connectivity, one edge a linked
    class, never all pairs.  A pair that meets more than once is counted at one place only.  How many
    tables there are and how fine the lattice is follow from the number of classes and the vectors'
    width (``plan``).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
    vectors of different lengths do not link.  Rows are vectors: repeated rows link with each
    other; a null id is allowed (its component is its class's or component's least id, null if it
    has none, and it is not kept then).  Other columns are ignored; an empty table gives no rows.
    Measured recall: see the README.
    """
    spark = table.sparkSession
    ship(spark)
    kind = table.schema[vector_col].dataType
    # single-precision components are sent as they are; all arithmetic is in double precision
    dtype = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.where(fine).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("vector"))
    good = good.select("vec_id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("again"), "vector").alias("h2"))
    bad = rows.where(~fine)
    classes = stored(good.groupBy("h1", "h2").agg(F.any_value("vector").alias("vector"), F.min("vec_id").alias("low"), F.count("*").alias("mult")).withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    n = classes.count()
    present = [r[0] for r in classes.select(_class_column(F.size("vector")).alias("w")).distinct().collect()]  # a row a class of widths
    plans = {}
    for w in present:
        planned = plan(n, cosine, probes, dim=w) if tables is None or scale is None else (tables, scale)
        plans[w] = tables or planned[0], scale or planned[1]
    hashed = stored(classes.select("cid", "vector").mapInArrow(_hash_rows(plans, probes, seed), "cid long, dim int, keys binary, cells array<long>"), "vector-keys")
    each = 1 + probes
    entries = hashed.select("cid", "dim", F.posexplode("cells").alias("at", "cell")).select("cid", "dim", F.floor(F.col("at") / each).cast("int").alias("table"), (F.col("at") % each == 0).alias("home"), "cell")
    cells = stored(
        entries.groupBy(*_CELL).agg(F.count("*").alias("n"), F.max("home").alias("lived_in")).where("n > 1 and lived_in").select(*_CELL, F.ceil(F.col("n") / block).cast("int").alias("chunks")),
        "vector-cells",
    )
    payload = classes.select("cid", "mult", "vector").mapInArrow(_pack_vectors(dtype), "cid long, mult long, vec binary").join(hashed.select("cid", "keys"), "cid")
    met = entries.join(cells.where("chunks = 1").drop("chunks"), [*_CELL]).join(payload, "cid").select(*_CELL, *_ROW)
    found = cut(met.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(_compare(cosine, each, dtype), _FOUND))
    crowded = cells.where("chunks > 1")
    pairs = crowded.agg(F.sum(F.expr("chunks * (chunks + 1) div 2"))).first()[0]
    if pairs:
        path = new_folder(spark, "vector-blocks")
        side = F.pmod(F.xxhash64("cid", "table"), F.col("chunks")).cast("int")
        there = entries.join(crowded, [*_CELL]).withColumn("side", side).join(payload, "cid").select(*_CELL, "side", *_ROW)
        there.repartition(*_CELL, "side").sortWithinPartitions(*_CELL, "side").write.partitionBy(*_CELL, "side").parquet(path)
        each_pair = crowded.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("b", F.explode(F.sequence(F.col("a"), F.col("chunks") - 1)))
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(pairs // 64, 100_000))
        dealt = each_pair.select(*_CELL, "a", "b").repartition(tasks, *_CELL, "a", "b").sortWithinPartitions(*_CELL, "a", "b")
        found = found.union(cut(dealt.mapInArrow(_compare_blocks(path, cosine, each, dtype), _FOUND)))
        remove(spark, path)
    groups = connected_components(found.select(F.col("cid").alias("a"), F.col("leader").alias("b")))
    named = groups.select(F.col("node").alias("cid"), "component").join(classes.select("cid", "low"), "cid")
    lowest = named.groupBy("component").agg(F.min("low").alias("group_low"))
    linked = named.join(lowest, "component").select("cid", "group_low")
    weights = found.groupBy("cid").agg(F.sum("weight").alias("weight"))
    told = classes.join(linked, "cid", "left").join(weights, "cid", "left")
    told = stored(told.select("h1", "h2", (F.col("mult") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"), F.coalesce("group_low", "low").alias("component_id")), "vector-results")
    out = good.select("vec_id", "h1", "h2").join(told, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = bad.select("vec_id", F.lit(0).cast(T.LongType()).alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
