"""What the registered queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations with coordinates made by integer arithmetic."""
    e = F.col("event_id")
    lat = F.when(e % 10 != 0, (e * 7919) % 400 / F.lit(10.0) - F.lit(20.0))
    lon = (e * 104729) % 600 / F.lit(10.0) - F.lit(30.0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("slug"), lat.alias("lat"), lon.alias("lon"))


#: The same in SQL.
OBSERVATIONS = """obs AS (SELECT event_id, user_id, event_type AS slug, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ((event_id * 7919) % 400) / 10.0::DOUBLE - 20.0::DOUBLE END AS lat,
 ((event_id * 104729) % 600) / 10.0::DOUBLE - 30.0::DOUBLE AS lon FROM events)"""
#: Prototypes of the training fold and similarities of the validation fold.
SIMS = """u AS (SELECT vec_id, label, [x::DOUBLE / greatest(sqrt(list_sum([y::DOUBLE * y::DOUBLE FOR y IN embedding])), 1e-8) FOR x IN embedding] AS e FROM embeddings),
m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM u WHERE vec_id % 5 <> 0) GROUP BY 1, 2),
r AS (SELECT label, list(x ORDER BY pos) AS v FROM m GROUP BY 1),
p AS (SELECT label AS class_idx, [x / greatest(sqrt(list_sum([y * y FOR y IN v])), 1e-8) FOR x IN v] AS proto FROM r),
sims AS (SELECT u.vec_id AS query_id, u.label, p.class_idx, list_dot_product(u.e, p.proto) AS sim FROM u, p WHERE u.vec_id % 5 = 0)"""
