"""Accuracy, calibration and abstention over ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.curate import running_total


def class_accuracy(ranks: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(label, n, correct1, correct3, top1, top3) from (label, rank).

    With ``classes``, a class without rows has n = 0 and null rates; without, it is left out.
    """
    rank = F.col("rank")
    out = ranks.groupBy("label").agg(F.count("*").alias("n"), F.count_if(rank == 1).alias("correct1"), F.count_if(rank <= 3).alias("correct3"))
    if classes is not None:
        out = classes.select(F.col("class_idx").alias("label")).join(out, "label", "left").na.fill(0, ["n", "correct1", "correct3"])
    return out.withColumn("top1", F.try_divide("correct1", "n")).withColumn("top3", F.try_divide("correct3", "n"))


def micro_macro(per_class: DataFrame) -> DataFrame:
    """One row: micro rates over all rows, macro rates over classes with rows."""
    zero = F.lit(0.0)
    return per_class.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.count_if(F.col("n") > 0).alias("classes"),
        F.coalesce(F.try_divide(F.sum("correct1"), F.sum("n")), zero).alias("micro_top1"),
        F.coalesce(F.try_divide(F.sum("correct3"), F.sum("n")), zero).alias("micro_top3"),
        F.coalesce(F.avg("top1"), zero).alias("macro_top1"),
        F.coalesce(F.avg("top3"), zero).alias("macro_top3"),
    )


def rank_movement(ranks: DataFrame) -> DataFrame:
    """One row from (raw_rank, rank, geo_filtered) of true labels: how the re-ranking moved them."""
    active = F.col("geo_filtered")
    return ranks.agg(
        F.count("*").alias("n"),
        F.count_if(active).alias("n_with_coords"),
        F.count_if(F.col("rank") < F.col("raw_rank")).alias("rank_improved"),
        F.count_if(F.col("rank") > F.col("raw_rank")).alias("rank_worsened"),
        (F.coalesce(F.avg((F.col("rank") == 1).cast("double")), F.lit(0.0)) - F.coalesce(F.avg((F.col("raw_rank") == 1).cast("double")), F.lit(0.0))).alias("delta_top1"),
        F.coalesce(F.avg(F.when(active, (F.col("rank") == 1).cast("double"))), F.lit(0.0)).alias("coords_top1"),
    )


def percentiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, median, p5, p95), exact and linearly interpolated.

    Equal values are counted first; ranges of (group, value) and a prefix sum over them say how many
    values of its group come before each, so no group's values meet in one task.  Missing values
    (null, NaN) do not count; a group without any has n = 0 and nulls.
    """
    v = F.col(value).cast("double")
    rows = df.select(F.col(group).alias("g"), F.when(~F.isnan(v), v).alias("v"))
    totals = rows.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    counted = rows.where("v is not null").groupBy("g", "v").agg(F.count("*").alias("c"))
    counted = running_total(counted, ["g", "v"], F.col("c"), "before")
    starts = counted.groupBy("g").agg(F.min("before").alias("base"), F.sum("c").alias("n"))
    at = counted.join(starts.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h"))).select("g", "v", (F.col("before") - F.col("base")).alias("low"), (F.col("before") - F.col("base") + F.col("c")).alias("high"), "n")
    cuts = {"median": 0.5, "p5": 0.05, "p95": 0.95}
    picked = []
    for name, p in cuts.items():
        place = F.lit(p) * (F.col("n") - 1)
        for side, index in (("a", F.floor(place)), ("b", F.ceil(place))):
            picked.append(F.max(F.when((F.col("low") <= index) & (index < F.col("high")), F.col("v"))).alias(f"{name}_{side}"))
        picked.append(F.max(place - F.floor(place)).alias(f"{name}_w"))
    found = at.groupBy(F.col("g").alias("h")).agg(*picked)
    rates = [(F.col(f"{c}_a") + (F.col(f"{c}_b") - F.col(f"{c}_a")) * F.col(f"{c}_w")).alias(c) for c in cuts]
    return totals.join(found, F.col("g").eqNullSafe(F.col("h")), "left").select(F.col("g").alias(group), "n", "mean", *rates)


def abstention(df: DataFrame, threshold: float = 0.60) -> DataFrame:
    """One row from (max_sim, correct) where ``correct`` is null out of scope.

    Rates are null where nothing is counted.
    """
    known, stays = F.col("correct").isNotNull(), F.col("max_sim") >= threshold
    right = F.coalesce(F.col("correct"), F.lit(False))
    count = F.count_if
    return df.agg(
        F.try_divide(count(right), count(known)).alias("accuracy_before"),
        F.try_divide(count(right & ~stays), count(right)).alias("correct_rejected"),
        F.try_divide(count(known & ~right & ~stays), count(known & ~right)).alias("incorrect_rejected"),
        F.try_divide(count(right & stays), count(known & stays)).alias("accuracy_accepted"),
        F.try_divide(count(known & ~stays), count(known)).alias("false_rejection"),
        F.try_divide(count(~known & stays), count(~known)).alias("out_of_scope_accepted"),
    )


def auc(df: DataFrame, score: str = "max_sim", positive: str = "known") -> DataFrame:
    """One row: the area under the ROC curve, by Mann-Whitney rank sums with mid-ranks for ties.

    Scores are first counted, then added up by ranges of the score.
    """
    counted = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    counted = running_total(counted, score, F.col("q"), "below")
    won = counted.withColumn("won", F.col("p") * (F.col("below") + F.col("q") / 2.0))
    return won.agg(F.try_divide(F.sum("won"), F.sum("p").cast("double") * F.sum("q")).alias("auc"))
