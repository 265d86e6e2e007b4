"""Retrieval and evaluation queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geo as G
from lodestone.functions import text as X
from lodestone.functions import vectors as V
from lodestone.operators import evaluate as E
from lodestone.operators import geo
from lodestone.operators import rank as R
from lodestone.plans.base import OBSERVATIONS, SIMS, observations, query, table

BOOST = 0.05
_RANKS = f"{SIMS}, ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, class_idx) AS rank FROM sims)"
_TRUTH = f"{_RANKS}, truth AS (SELECT query_id, label, rank, sim FROM ranks WHERE class_idx = label)"
_CELLS = f"{OBSERVATIONS}, cells AS (SELECT slug, floor(lat)::BIGINT AS clat, floor(lon)::BIGINT AS clon, count(*) AS n FROM obs WHERE lat IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2)"
_GEO = f"""{SIMS}, {OBSERVATIONS},
ccells AS (SELECT DISTINCT (user_id % 10)::INTEGER AS class_idx, floor(lat)::BIGINT AS clat, floor(lon)::BIGINT AS clon FROM obs WHERE lat IS NOT NULL),
spot AS (SELECT v.vec_id AS query_id, o.lat, o.lon FROM embeddings v JOIN obs o ON o.event_id = v.vec_id WHERE v.vec_id % 5 = 0),
hit AS (SELECT DISTINCT a.query_id, c.class_idx FROM spot a JOIN ccells c ON abs(c.clat - floor(a.lat)) <= 1 AND abs(c.clon - floor(a.lon)) <= 1 WHERE a.lat IS NOT NULL),
g AS (SELECT s.*, h.class_idx IS NOT NULL AS in_range, coalesce(a.lat IS NOT NULL, false) AS geo_filtered FROM sims s LEFT JOIN hit h ON s.query_id = h.query_id AND s.class_idx = h.class_idx LEFT JOIN spot a ON a.query_id = s.query_id),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, class_idx) AS raw_rank,
 row_number() OVER (PARTITION BY query_id ORDER BY sim + CASE WHEN in_range THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END DESC, class_idx) AS rank FROM g)"""
_PER_CLASS = f"{_TRUTH}, c AS (SELECT label, count(*) AS n, count(*) FILTER (rank = 1) AS correct1, count(*) FILTER (rank <= 3) AS correct3 FROM truth GROUP BY 1)"
_SIGNALS = f"""{_RANKS}, s AS (SELECT query_id, any_value(label) AS label, max(class_idx) FILTER (rank = 1) AS top1, max(sim) FILTER (rank = 1) AS max_sim, max(sim) FILTER (rank = 2) AS top2_sim FROM ranks GROUP BY 1),
k AS (SELECT *, CASE WHEN label < 8 THEN top1 = label END AS correct FROM s)"""


def folds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0")


def _scores(spark: SparkSession, d: str, top: int | None = None) -> DataFrame:
    train, val = folds(spark, d)
    return R.similarities(val, R.prototypes(train), top)


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return folds(spark, d)[1].select(F.col("vec_id").alias("query_id"), "label")


def ranks_of_truth(spark: SparkSession, d: str) -> DataFrame:
    return R.rank_of_label(R.ranked(_scores(spark, d)), _truth(spark, d))


def reranked(spark: SparkSession, d: str) -> DataFrame:
    obs = observations(spark, d)
    cells = geo.cell_counts(obs.withColumn("class_idx", (F.col("user_id") % 10).cast("int")), slug="class_idx")
    at = _truth(spark, d).join(obs.select(F.col("event_id").alias("query_id"), "lat", "lon"), "query_id")
    hits = geo.in_range(at, cells, "query_id", slug="class_idx")
    return R.geo_rerank(_scores(spark, d), hits, at.where(G.usable(F.col("lat"), F.col("lon"))), BOOST)


@query(f"WITH {OBSERVATIONS} SELECT event_id, floor(lat / 0.5::DOUBLE)::BIGINT AS clat, floor(lon / 0.5::DOUBLE)::BIGINT AS clon FROM obs WHERE lat IS NOT NULL")
def geo_cell(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).where(G.usable(F.col("lat"), F.col("lon")))
    return o.select("event_id", G.cell(F.col("lat"), 0.5).alias("clat"), G.cell(F.col("lon"), 0.5).alias("clon"))


@query("""WITH u AS (SELECT vec_id, [x::DOUBLE / greatest(sqrt(list_sum([y::DOUBLE * y::DOUBLE FOR y IN embedding])), 1e-8) FOR x IN embedding] AS e FROM embeddings)
SELECT vec_id, round(e[1], 6) + 0 AS first, round(e[64], 6) + 0 AS last, round(list_sum(e), 6) + 0 AS total FROM u""")
def l2_normalise(spark: SparkSession, d: str) -> DataFrame:
    unit = table(spark, d, "embeddings").select("vec_id", V.l2_normalise(V.doubles(F.col("embedding"))).alias("e"))
    return unit.select("vec_id", F.round(F.get("e", F.lit(0)), 6).alias("first"), F.round(F.get("e", F.lit(63)), 6).alias("last"), F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {SIMS} SELECT query_id, max(sim) < 0.1 AS abstain, round(greatest(0, least(1, max(sim))), 2) AS shown FROM sims GROUP BY 1")
def abstain_flag(spark: SparkSession, d: str) -> DataFrame:
    best = _scores(spark, d, top=1)
    return best.select("query_id", (F.col("sim") < 0.1).alias("abstain"), F.round(X.clamp(F.col("sim"), 0.0, 1.0), 2).alias("shown"))


@query(f"WITH {SIMS} SELECT query_id, class_idx, round(sim, 4) + 0 AS sim FROM sims")
def all_pairs_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("query_id", "class_idx", V.reported(F.col("sim")).alias("sim"))


@query(f"""WITH {_CELLS}, pts AS (SELECT event_id, floor(lat)::BIGINT AS a, floor(lon)::BIGINT AS b FROM obs WHERE lat IS NOT NULL)
SELECT DISTINCT event_id, slug FROM pts JOIN cells ON abs(clat - a) <= 1 AND abs(clon - b) <= 1""")
def geo_neighbour_join(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    return geo.in_range(o.drop("slug"), geo.cell_counts(o, minimum=2), "event_id")


@query(f"WITH {_CELLS} SELECT slug, clat, clon, n FROM cells")
def geo_index_build(spark: SparkSession, d: str) -> DataFrame:
    return geo.cell_counts(observations(spark, d), minimum=2)


@query(f"WITH {_CELLS} SELECT slug, count(*) AS n_cells, string_agg(clat || ':' || clon, ',' ORDER BY clat, clon) AS cells FROM cells GROUP BY 1")
def geo_index_nested(spark: SparkSession, d: str) -> DataFrame:
    nested = geo.nested_index(geo.cell_counts(observations(spark, d), minimum=2))
    text = F.array_join(F.transform("cells", lambda c: F.concat_ws(":", F.get(c, F.lit(0)).cast("string"), F.get(c, F.lit(1)).cast("string"))), ",")
    return nested.select("slug", F.size("cells").cast("long").alias("n_cells"), text.alias("cells"))


@query(f"WITH {SIMS} SELECT class_idx, generate_subscripts(proto, 1) - 1 AS dim, round(unnest(proto), 6) + 0 AS x FROM p")
def class_prototypes(spark: SparkSession, d: str) -> DataFrame:
    protos = R.prototypes(folds(spark, d)[0])
    return protos.select("class_idx", F.posexplode("proto").alias("dim", "x")).select("class_idx", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query(f"WITH {_RANKS} SELECT query_id, class_idx, rank, round(sim, 4) + 0 AS similarity FROM ranks WHERE rank <= 3")
def topk_nearest(spark: SparkSession, d: str) -> DataFrame:
    train, val = folds(spark, d)
    return R.top_k(val, R.prototypes(train)).select("query_id", "class_idx", F.col("rank").cast("long").alias("rank"), V.reported(F.col("sim")).alias("similarity"))


@query(f"WITH {_RANKS} SELECT query_id, class_idx, rank, round(sim, 4) + 0 AS similarity FROM ranks WHERE rank <= 3")
def topk_of_many(spark: SparkSession, d: str) -> DataFrame:
    """The same by bounds on blocks of neighbouring prototypes, here of two classes each."""
    train, val = folds(spark, d)
    return R.top_k_of_many(val, R.prototypes(train), block=2).select("query_id", "class_idx", F.col("rank").cast("long").alias("rank"), V.reported(F.col("sim")).alias("similarity"))


@query(f"WITH {_GEO} SELECT query_id, class_idx, rank, round(sim, 4) + 0 AS similarity, in_range AND rank < raw_rank AS geo_boosted, geo_filtered FROM rr WHERE rank <= 3")
def geo_rerank(spark: SparkSession, d: str) -> DataFrame:
    return reranked(spark, d).where("rank <= 3").select("query_id", "class_idx", F.col("rank").cast("long").alias("rank"), V.reported(F.col("sim")).alias("similarity"), "geo_boosted", "geo_filtered")


@query(f"WITH {_TRUTH} SELECT query_id, label, rank, round(sim, 4) + 0 AS sim FROM truth")
def rank_of_truth(spark: SparkSession, d: str) -> DataFrame:
    return ranks_of_truth(spark, d).select("query_id", "label", F.col("rank").cast("long").alias("rank"), V.reported(F.col("sim")).alias("sim"))


@query(f"WITH {_PER_CLASS} SELECT label, n, correct1, correct3, round(correct1 / n, 6) AS top1, round(correct3 / n, 6) AS top3 FROM c")
def class_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return E.class_accuracy(ranks_of_truth(spark, d)).withColumn("top1", F.round("top1", 6)).withColumn("top3", F.round("top3", 6))


@query(f"""WITH {_PER_CLASS} SELECT n_nationkey AS label, coalesce(n, 0) AS n, coalesce(correct1, 0) AS correct1, coalesce(correct3, 0) AS correct3, round(correct1 / n, 6) AS top1, round(correct3 / n, 6) AS top3
 FROM nation LEFT JOIN c ON n_nationkey = label""")
def accuracy_of_every_class(spark: SparkSession, d: str) -> DataFrame:
    classes = table(spark, d, "nation").select(F.col("n_nationkey").alias("class_idx"))
    return E.class_accuracy(ranks_of_truth(spark, d), classes).withColumn("top1", F.round("top1", 6)).withColumn("top3", F.round("top3", 6))


@query(f"""WITH {_PER_CLASS} SELECT sum(n)::BIGINT AS n, count(*) AS classes, round(sum(correct1) / sum(n), 6) AS micro_top1, round(sum(correct3) / sum(n), 6) AS micro_top3,
 round(avg(correct1 / n), 6) AS macro_top1, round(avg(correct3 / n), 6) AS macro_top3 FROM c""")
def micro_macro(spark: SparkSession, d: str) -> DataFrame:
    out = E.micro_macro(E.class_accuracy(ranks_of_truth(spark, d)))
    return out.select("n", "classes", *[F.round(c, 6).alias(c) for c in ("micro_top1", "micro_top3", "macro_top1", "macro_top3")])


@query(f"""WITH {_GEO} SELECT count(*) AS n, count(*) FILTER (geo_filtered) AS n_with_coords, count(*) FILTER (rank < raw_rank) AS rank_improved, count(*) FILTER (rank > raw_rank) AS rank_worsened,
 round(avg((rank = 1)::INTEGER) - avg((raw_rank = 1)::INTEGER), 6) AS delta_top1, round(coalesce(avg((rank = 1)::INTEGER) FILTER (geo_filtered), 0), 6) AS coords_top1 FROM rr WHERE class_idx = label""")
def geo_rank_delta(spark: SparkSession, d: str) -> DataFrame:
    truth = _truth(spark, d)
    r = reranked(spark, d).join(truth, "query_id").where("class_idx = label")
    out = E.rank_movement(r)
    return out.withColumn("delta_top1", F.round("delta_top1", 6)).withColumn("coords_top1", F.round("coords_top1", 6))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    known = F.when(F.col("label") < 8, F.col("label")).otherwise(-1)
    s = R.signals(_scores(spark, d, top=2)).join(_truth(spark, d), "query_id")
    return s.withColumn("correct", R.known_correct(F.col("top1"), known))


@query(f"WITH {_SIGNALS} SELECT query_id, top1, round(max_sim, 4) + 0 AS max_sim, round(top2_sim, 4) + 0 AS top2_sim, round(max_sim - top2_sim, 4) + 0 AS gap, correct FROM k")
def calibration_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("query_id", "top1", *[F.round(c, 4).alias(c) for c in ("max_sim", "top2_sim", "gap")], "correct")


@query(f"""WITH {_SIGNALS} SELECT label, count(max_sim) AS n, round(avg(max_sim), 6) AS mean, round(quantile_cont(max_sim, 0.5), 6) AS median, round(quantile_cont(max_sim, 0.05), 6) AS p5,
 round(quantile_cont(max_sim, 0.95), 6) AS p95 FROM k GROUP BY 1""")
def calibration_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = E.percentiles(_signals(spark, d), "label", "max_sim")
    return out.select("label", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p5", "p95")])


@query(f"""WITH {_SIGNALS}, f AS (SELECT coalesce(correct, false) AS ok, correct IS NOT NULL AS known, max_sim >= 0.15 AS stays FROM k)
SELECT round(count(*) FILTER (ok) / nullif(count(*) FILTER (known), 0), 6) AS accuracy_before, round(count(*) FILTER (ok AND NOT stays) / nullif(count(*) FILTER (ok), 0), 6) AS correct_rejected,
 round(count(*) FILTER (known AND NOT ok AND NOT stays) / nullif(count(*) FILTER (known AND NOT ok), 0), 6) AS incorrect_rejected, round(count(*) FILTER (ok AND stays) / nullif(count(*) FILTER (known AND stays), 0), 6) AS accuracy_accepted,
 round(count(*) FILTER (known AND NOT stays) / nullif(count(*) FILTER (known), 0), 6) AS false_rejection, round(count(*) FILTER (NOT known AND stays) / nullif(count(*) FILTER (NOT known), 0), 6) AS out_of_scope_accepted FROM f""")
def abstention_curve(spark: SparkSession, d: str) -> DataFrame:
    out = E.abstention(_signals(spark, d), 0.15)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""WITH {_SIGNALS}, f AS (SELECT max_sim, correct IS NOT NULL AS known FROM k)
SELECT round(sum(CASE WHEN a.max_sim > b.max_sim THEN 1.0 WHEN a.max_sim = b.max_sim THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*), 6) AS auc FROM f a, f b WHERE a.known AND NOT b.known""")
def calibration_auc(spark: SparkSession, d: str) -> DataFrame:
    return E.auc(_signals(spark, d).withColumn("known", F.col("correct").isNotNull())).select(F.round("auc", 6).alias("auc"))
