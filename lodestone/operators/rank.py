"""Class prototypes and nearest-prototype ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.geo import boosted
from lodestone.functions.vectors import EPSILON, doubles, l2_normalise, reported
from lodestone.shipping import ship
from lodestone.storage import cut, new_folder

#: Prototypes a block: at 1,792 doubles each a block is about 58 MB.
BLOCK = 4096
#: Components that a task's partial sums may hold before they are passed on (32 MB).
_HELD = 4_000_000
#: Blocks that a Python worker keeps, most recently used last.
_KEPT = 4


def _rows_of(column) -> list[tuple[int, np.ndarray]]:
    """(row, vector) of a list column's vectors that are there and hold no nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at, there = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    gaps = np.concatenate([[0], np.cumsum(~values.is_valid().to_numpy(zero_copy_only=False))])
    return [(i, flat[a:b]) for i, (a, b) in enumerate(zip(at, at[1:])) if there[i] and b > a and gaps[a] == gaps[b]]


def _unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), EPSILON)


def _partial_sums(batches):
    """Sums of unit vectors by class and length, as rows; a task holds ``_HELD`` components at most."""
    sums: dict[tuple[int, int], list] = {}
    held = 0

    def rows():
        keys = list(sums)
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([sums[k][1] for k in keys], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["class_idx", "n", "sums"])

    for batch in batches:
        labels = batch.column(0).to_pylist()
        found: dict[tuple[int, int], list] = {}
        for i, v in _rows_of(batch.column(1)):
            found.setdefault((labels[i], len(v)), []).append(v)
        for key, vectors in found.items():
            if key not in sums:
                sums[key] = [0, np.zeros(key[1])]
                held += key[1]
            sums[key][0] += len(vectors)
            sums[key][1] += _unit(vectors).sum(axis=0)
        if held > _HELD:
            yield rows()
            sums, held = {}, 0
    if sums:
        yield rows()


def prototypes(df: DataFrame, classes: DataFrame | None = None, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(class_idx, proto): the normalised mean of each class's normalised vectors.

    Each task adds up its unit vectors by class, so what is shuffled is a row a task, class and
    component.  Vectors that are null, empty or hold nulls are left out.  With ``classes``
    (class_idx), a class without vectors gets a zero prototype.
    """
    ship(df.sparkSession)
    vectors = df.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("class_idx"), doubles(F.col(vector)).alias("v"))
    partial = vectors.mapInArrow(_partial_sums, "class_idx int, n long, sums array<double>")
    parts = partial.select("class_idx", "n", F.posexplode("sums").alias("pos", "x"))
    means = parts.groupBy("class_idx", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
    lists = means.groupBy("class_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    found = lists.select("class_idx", l2_normalise(F.transform("p", lambda s: s["x"])).alias("proto"))
    if classes is None:
        return found
    width = found.agg(F.max(F.size("proto")).alias("width"))
    zero = F.transform(F.sequence(F.lit(1), F.coalesce("width", F.lit(1))), lambda _: F.lit(0.0))
    return classes.select(F.col("class_idx").cast("int")).distinct().crossJoin(F.broadcast(width)).join(found, "class_idx", "left").select("class_idx", F.coalesce("proto", zero).alias("proto"))


def _store_blocks(protos: DataFrame, block: int) -> tuple[str, list[int]]:
    """Prototypes as Parquet in the shared folder, a folder a block of classes; (path, blocks)."""
    path = new_folder(protos.sparkSession, "prototypes")
    numbered = protos.select(F.floor(F.col("class_idx") / block).alias("b"), "class_idx", "proto")
    numbered.repartition("b").sortWithinPartitions("b", "class_idx").write.partitionBy("b").parquet(path)
    stored = protos.sparkSession.read.schema("class_idx int, proto array<double>, b bigint").parquet(path)
    return path, sorted(r["b"] for r in stored.select("b").distinct().collect())


_blocks: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}


def _block(path: str, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(classes in order, their unit prototypes) of a stored block, kept by the worker."""
    from pyarrow import dataset, fs

    found = _blocks.pop((path, b), None)
    if found is None:
        files, at = fs.FileSystem.from_uri(path)
        rows = dataset.dataset(f"{at}/b={b}", filesystem=files, format="parquet").to_table(columns=["class_idx", "proto"])
        rows = rows.sort_by("class_idx")
        good = _rows_of(rows.column("proto"))
        classes = rows.column("class_idx").to_numpy()[[i for i, _ in good]]
        found = classes, _unit([v for _, v in good])
    while len(_blocks) >= _KEPT:
        del _blocks[next(iter(_blocks))]
    _blocks[path, b] = found
    return found


def _score(path: str, blocks: list[int], top: int | None):
    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), _rows_of(batch.column(1))
            if not rows:
                continue
            x = _unit([v for _, v in rows])
            sims, classes = np.empty((len(rows), 0)), np.empty((len(rows), 0), np.int32)
            for b in blocks:
                names, protos = _block(path, b)
                sims = np.hstack([sims, x @ protos.T])
                classes = np.hstack([classes, np.broadcast_to(names, (len(rows), len(names)))])
                if top is not None and sims.shape[1] > top:
                    # blocks come in order of their classes: a stable sort gives ties to the least class
                    best = np.argsort(-sims, axis=1, kind="stable")[:, :top]
                    sims, classes = np.take_along_axis(sims, best, 1), np.take_along_axis(classes, best, 1)
            k = sims.shape[1]
            owner = np.repeat(np.array([ids[i] for i, _ in rows], dtype=object), k)
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(classes.ravel(), pa.int32()), pa.array(sims.ravel())], ["query_id", "class_idx", "sim"])

    return run


def similarities(queries: DataFrame, protos: DataFrame, top: int | None = None, query_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, class_idx, sim) of every query with every class, or with its ``top`` nearest.

    Prototypes are stored once in the shared folder; a worker loads a block at a time and keeps a
    few.  Queries stay where they are and meet each block as one matrix product, so neither side
    is shuffled, broadcast or copied into the other's rows; with ``top``, only that many rows a
    query leave the task.  Queries without a vector, or whose vector holds nulls, are left out.
    """
    ship(queries.sparkSession)
    shaped = queries.select(F.col(query_id).cast("long").alias("query_id"), doubles(F.col(vector)).alias("v"))
    return shaped.mapInArrow(_score(*_store_blocks(protos, block), top), "query_id long, class_idx int, sim double")


def ranked(scores: DataFrame, score: Column | str = "sim", name: str = "rank") -> DataFrame:
    s = F.col(score) if isinstance(score, str) else score
    return scores.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(s.desc(), F.col("class_idx"))))


def top_k(queries: DataFrame, protos: DataFrame, k: int = 3, **kw) -> DataFrame:
    """(query_id, class_idx, sim, rank), the k nearest classes; ties go to the least class."""
    return ranked(similarities(queries, protos, top=k, **kw)).where(F.col("rank") <= k)


#: Components of the cells' centres at most (16 MB), which every task gets.
_CENTRES = 1 << 21
#: What a bound on a cosine may be short of by rounding.
_SLACK = 1e-9


def _nearest_centre(centres: np.ndarray):
    def run(batches):
        for batch in batches:
            rows = _rows_of(batch.column(1))
            if not rows:
                continue
            ids = batch.column(0).to_numpy()[[i for i, _ in rows]]
            sims = _unit([v for _, v in rows]) @ centres.T
            cell = sims.argmax(axis=1)
            lists = pa.array([v for _, v in rows], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), lists, pa.array(cell.astype(np.int32)), pa.array(sims[np.arange(len(rows)), cell])], ["id", "v", "cell", "near"])

    return run


class CellBlocks:
    """Prototypes stored in blocks of neighbours, with what a block's cosines can be at most.

    Every prototype lies in the cell of the centre nearest to it; a block is a part of a cell, and
    ``least`` the smallest cosine of its prototypes with the centre.  For a query at angle t to the
    centre, no prototype of the block is nearer than t less the block's angle.
    """

    def __init__(self, path: str, centres: np.ndarray, blocks: list[tuple[int, int, float]]):
        self.path, self.centres = path, centres
        self.blocks = [b for b, _, _ in blocks]
        self.cells = np.array([c for _, c, _ in blocks], np.int64)
        self.angles = np.arccos(np.clip([least for _, _, least in blocks], -1.0, 1.0))

    @classmethod
    def store(cls, protos: DataFrame, block: int = BLOCK) -> CellBlocks:
        """Centres are a bounded sample of the prototypes, by hash."""
        spark = protos.sparkSession
        ship(spark)
        good = protos.where("class_idx is not null").select(F.col("class_idx").cast("int").alias("id"), "proto")
        n, width = good.agg(F.count("*"), F.max(F.size("proto"))).first()
        cells = max(1, min(-(-4 * n // block), _CENTRES // max(width or 1, 1)))
        drawn = [r["proto"] for r in good.orderBy(F.xxhash64("id"), "id").limit(cells).collect()]
        drawn = [v for v in drawn if v and None not in v and any(v)]
        centres = _unit(drawn) if drawn else np.ones((1, max(width or 1, 1)))
        dealt = good.mapInArrow(_nearest_centre(centres), "id int, v array<double>, cell int, near double")
        place = cut(dealt)
        chunks = place.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
        numbered = place.join(F.broadcast(chunks), "cell")  # a row a cell
        b = F.col("cell").cast("long") * (1 << 20) + F.pmod(F.xxhash64("id"), F.col("chunks"))
        numbered = numbered.select(b.alias("b"), "cell", "near", F.col("id").alias("class_idx"), F.col("v").alias("proto"))
        path = new_folder(spark, "prototype-cells")
        numbered.repartition("b").sortWithinPartitions("b", "class_idx").write.partitionBy("b").parquet(path)
        stored = spark.read.schema("cell int, near double, class_idx int, proto array<double>, b bigint").parquet(path)
        told = stored.groupBy("b", "cell").agg(F.min("near").alias("least")).orderBy("b").collect()  # a row a block
        return cls(path, centres, [(r["b"], r["cell"], r["least"]) for r in told])

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """(queries, blocks): what each block's cosines with each unit query can be at most."""
        angle = np.arccos(np.clip(x @ self.centres.T, -1.0, 1.0))[:, self.cells]
        return np.cos(np.maximum(angle - self.angles, 0.0)) + _SLACK

    def nearest(self, x: np.ndarray, k: int, load=_block) -> tuple[np.ndarray, np.ndarray, int]:
        """(similarities, classes, how many blocks were read) of each unit query's k nearest.

        Blocks come by their bounds; one is read for those queries whose k-th nearest so far it may
        still beat, or equal with a lesser class.
        """
        sims, classes = np.full((len(x), k), -np.inf), np.full((len(x), k), np.iinfo(np.int32).max, np.int32)
        bounds, read = self.bounds(x), 0
        for at in np.argsort(-bounds.max(axis=0), kind="stable"):
            open_ = np.flatnonzero(bounds[:, at] >= sims[:, -1])
            if not len(open_):
                continue
            names, protos = load(self.path, self.blocks[at])
            read += 1
            both = np.hstack([sims[open_], x[open_] @ protos.T])
            ids = np.hstack([classes[open_], np.broadcast_to(names, (len(open_), len(names)))])
            best = np.lexsort((ids, -both), axis=1)[:, :k]
            sims[open_], classes[open_] = np.take_along_axis(both, best, 1), np.take_along_axis(ids, best, 1)
        return sims, classes, read


def _nearest_in(cells: CellBlocks, k: int):
    def run(batches):
        for batch in batches:
            rows = _rows_of(batch.column(1))
            if not rows:
                continue
            ids = batch.column(0).to_numpy()[[i for i, _ in rows]]
            sims, classes, _ = cells.nearest(_unit([v for _, v in rows]), k)
            there = np.isfinite(sims)
            place = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), sims.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[there.ravel()]), pa.array(classes[there]), pa.array(sims[there]), pa.array(place[there])], ["query_id", "class_idx", "sim", "rank"])

    return run


def top_k_of_many(queries: DataFrame, protos: DataFrame, k: int = 3, query_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """As ``top_k``, for very many classes: exact, but only blocks that can matter are read.

    Queries are brought together by the centre nearest to them, so that those of a batch need the
    same blocks; then each batch reads blocks by what their cosines can be at most, until none
    can change its answer (see ``CellBlocks``).  How many that spares depends on how the classes lie.
    """
    cells = CellBlocks.store(protos, block)
    if not cells.blocks:
        return queries.sparkSession.createDataFrame([], "query_id long, class_idx int, sim double, rank int")
    shaped = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), doubles(F.col(vector)).alias("v"))
    near = shaped.mapInArrow(_nearest_centre(cells.centres), "id long, v array<double>, cell int, near double")
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gathered = near.repartitionByRange(parts, "cell", F.xxhash64("id")).sortWithinPartitions("cell").select("id", "v")
    return gathered.mapInArrow(_nearest_in(cells, k), "query_id long, class_idx int, sim double, rank int")


def geo_rerank(scores: DataFrame, hits: DataFrame, active: DataFrame, boost: float = 0.05) -> DataFrame:
    """Scores with ``raw_rank``, ``rank`` after the boost, ``in_range`` and ``geo_boosted``.

    ``hits`` has (query_id, class_idx) in range, ``active`` (query_id) the queries with usable
    coordinates.  Similarities stay raw; no class is filtered out; a class is boosted if it is in
    range and ranks strictly better than before.
    """
    marked = hits.select("query_id", "class_idx").distinct().withColumn("hit", F.lit(True))
    on = active.select("query_id").distinct().withColumn("geo_filtered", F.lit(True))
    joined = scores.join(marked, ["query_id", "class_idx"], "left").join(on, "query_id", "left").withColumn("geo_filtered", F.coalesce("geo_filtered", F.lit(False)))
    joined = joined.withColumn("in_range", F.coalesce("hit", F.lit(False)) & F.col("geo_filtered")).drop("hit")
    both = ranked(ranked(joined, "sim", "raw_rank"), boosted(F.col("sim"), F.col("in_range"), boost), "rank")
    return both.withColumn("geo_boosted", F.col("in_range") & (F.col("rank") < F.col("raw_rank")))


def rank_of_label(ranks: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, label, rank, sim): where each query's true class ranks."""
    return ranks.join(truth, (ranks["query_id"] == truth["query_id"]) & (ranks["class_idx"] == truth["label"])).select(ranks["query_id"], "label", "rank", "sim")


def signals(scores: DataFrame) -> DataFrame:
    """(query_id, top1, max_sim, top2_sim, gap) a query: the signals of a calibration record."""
    two = ranked(scores).where("rank <= 2")
    out = two.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("class_idx"))).alias("top1"), F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("max_sim"), F.max(F.when(F.col("rank") == 2, F.col("sim"))).alias("top2_sim"))
    return out.withColumn("gap", F.col("max_sim") - F.col("top2_sim"))


def known_correct(top1: Column, known_label: Column) -> Column:
    """True or false for a query of a known class, null for others."""
    return F.when(known_label >= 0, top1 == known_label)


def response(ranks: DataFrame, species: DataFrame, k: int = 3, inference_ms: str | None = None) -> DataFrame:
    """(query_id, results, response): the ranked answer of each query, with raw similarities to 4 places.

    ``results`` is the list alone, ``response`` the whole answer as JSON: the list, how long the
    inference took (``inference_ms`` names a column in milliseconds; else null), and whether
    coordinates took part (``geo_filtered`` of the ranks, where there is one).
    """
    taken = F.floor(F.max(inference_ms)).cast("long") if inference_ms else F.lit(None).cast("long")
    active = F.coalesce(F.bool_or("geo_filtered"), F.lit(False)) if "geo_filtered" in ranks.columns else F.lit(False)
    rows = ranks.where(F.col("rank") <= k).join(species, "class_idx")
    item = F.struct("rank", "species_name", "common_name", "taxon_id", reported(F.col("sim")).alias("similarity"), "geo_boosted")
    answer = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"), taken.alias("inference_ms"), active.alias("geo_filtered"))
    whole = F.to_json(F.struct(F.col("items").alias("results"), "inference_ms", "geo_filtered"), {"ignoreNullFields": "false"})
    return answer.select("query_id", F.to_json("items").alias("results"), whole.alias("response"))
