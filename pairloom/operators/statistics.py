"""Rank statistics over (run, model, score) tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.ranks import attach
from pairloom.functions.scalars import nan_to_null, strip
from pairloom.functions.special import chi2_sf, studentized_range_ppf, studentized_range_sf

PAIR_BLOCK = 1000


def stat_records(seed_rows: DataFrame, scope: str) -> DataFrame:
    """(seed, model_config, f1): ``embedding + model`` or the strategy; missing f1 or blank names are left out."""
    named = {
        "model_embedding": F.when(
            (strip(F.col("model_type")) != "") & (strip(F.col("embedding_name")) != ""),
            F.concat_ws(" + ", strip(F.col("embedding_name")), strip(F.col("model_type"))),
        ),
        "ensemble_strategy": F.when(strip(F.col("strategy")) != "", strip(F.col("strategy"))),
    }
    if scope not in named:
        raise ValueError(f"unknown scope: {scope}")
    return seed_rows.select(
        F.col("seed").try_cast("int").alias("seed"), named[scope].alias("model_config"), nan_to_null(F.col("f1")).alias("f1")
    ).dropna()


def score_matrix(rows: DataFrame, run: str = "seed", model: str = "model_config", score: str = "f1") -> DataFrame:
    """Mean score per (run_id, model_id) over usable rows."""
    usable = rows.select(
        F.col(run).try_cast("int").alias("run_id"), F.nullif(strip(F.col(model).cast("string")), F.lit("")).alias("model_id"),
        nan_to_null(F.col(score)).alias("score"),
    ).dropna()
    return usable.groupBy("run_id", "model_id").agg(F.avg("score").alias("score"))


def complete_runs(scores: DataFrame) -> DataFrame:
    """Runs that have every model; dropping incomplete rows first leaves no column incomplete."""
    models = scores.select("model_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    full = scores.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == models).select("run_id")
    return scores.join(full, "run_id", "left_semi")


def rank_matrix(scores: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """Average-tie rank of each model inside its run, 1 being best."""
    order = F.col("score").desc() if higher_is_better else F.col("score").asc()
    place = F.rank().over(Window.partitionBy("run_id").orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy("run_id", "score"))
    return scores.withColumn("rank", place + (ties - 1) / 2)


def average_ranks(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("model_id").agg(F.avg("rank").alias("avg_rank")).orderBy("avg_rank", "model_id")


def friedman_facts(scores: DataFrame) -> DataFrame:
    """One row (num_runs, num_models, statistic): the tie-corrected chi-square, NULL where undefined."""
    ranks = rank_matrix(complete_runs(scores))
    ties = ranks.groupBy("run_id", "score").agg(F.count(F.lit(1)).alias("t")).agg(
        F.sum(F.pow("t", 3) - F.col("t")).alias("_ties")
    )
    sums = ranks.groupBy("model_id").agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n")).agg(
        F.sum(F.col("r") * F.col("r")).alias("_ss"), F.count(F.lit(1)).alias("num_models"), F.max("n").alias("num_runs")
    )
    tie_sum = ties.select("_ties").scalar()
    k, n = F.col("num_models").cast("double"), F.col("num_runs").cast("double")
    correction = 1.0 - F.col("_ties") / (n * k * (k * k - 1.0))
    raw = 12.0 / (n * k * (k + 1.0)) * F.col("_ss") - 3.0 * n * (k + 1.0)
    enough = (k >= 3) & (n >= 2) & (correction > 0)
    return sums.withColumn("_ties", tie_sum).select(
        F.coalesce("num_runs", F.lit(0)).alias("num_runs"), "num_models", F.when(enough, raw / correction).alias("statistic")
    )


def friedman(scores: DataFrame, alpha: float = 0.05, scope: str = "model_embedding") -> DataFrame:
    """One row with statistic, p-value, significance and status; the p-value needs only three scalars."""
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must lie between 0 and 1")
    facts = friedman_facts(scores).first()
    runs, models, statistic = facts["num_runs"], facts["num_models"], facts["statistic"]
    p_value, status = None, "ok"
    if models < 2 or runs < 2:
        status = "insufficient_data"
    elif models < 3:
        status = "insufficient_models_for_friedman"
    elif statistic is not None:
        p_value = chi2_sf(statistic, models - 1)
    significant = p_value is not None and p_value < alpha
    row = (scope, statistic if status == "ok" else None, p_value, models, runs, alpha, significant, status)
    return scores.sparkSession.createDataFrame(
        [row], "scope string, statistic double, p_value double, num_models long, num_runs long, alpha double, "
               "significant boolean, status string",
    )


def critical_difference(num_models: int, num_runs: int, alpha: float = 0.05) -> float:
    if num_models < 2 or num_runs < 1:
        return float("nan")
    q = studentized_range_ppf(1.0 - alpha, num_models) / math.sqrt(2.0)
    return q * math.sqrt(num_models * (num_models + 1.0) / (6.0 * num_runs))


def nemenyi(avg_ranks: DataFrame, num_runs: int, alpha: float = 0.05) -> DataFrame:
    """All model pairs with rank difference, p-value and significance.

    Every pair of models is in the result by definition; models meet in blocks, so that no task or row holds all of them.
    """
    models = avg_ranks.count()
    if models < 2:
        raise ValueError(f"Nemenyi test needs at least 2 models, got {models}")
    limit = critical_difference(models, num_runs, alpha)
    error = math.sqrt(models * (models + 1.0) / (6.0 * num_runs))

    @F.pandas_udf("double")
    def tail(diff: pd.Series) -> pd.Series:
        # ranks are multiples of a fraction, so few differences are distinct
        known = {d: studentized_range_sf(d / error * math.sqrt(2.0), models) for d in diff.unique()}
        return diff.map(known)

    blocks = -(-models // PAIR_BLOCK)
    left = avg_ranks.select(F.col("model_id").alias("model_a"), F.col("avg_rank").alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    right = avg_ranks.select(F.col("model_id").alias("model_b"), F.col("avg_rank").alias("_b"), F.pmod(F.hash("model_id"), F.lit(blocks)).alias("_block"))
    met = left.join(right, "_block").where("model_b > model_a")
    return met.select("model_a", "model_b", F.abs(F.col("_a") - F.col("_b")).alias("rank_diff")).select(
        "model_a", "model_b", tail("rank_diff").alias("p_value"), "rank_diff",
        F.lit(limit).alias("critical_difference"), (F.col("rank_diff") > limit).alias("significant"),
    ).orderBy("p_value", "model_a", "model_b")


def nemenyi_after_friedman(scores: DataFrame, alpha: float = 0.05, force: bool = False) -> DataFrame | None:
    """The pair table, only when the Friedman test is significant."""
    test = friedman(scores, alpha).first()
    if not (force or test["significant"]):
        return None
    return nemenyi(average_ranks(rank_matrix(complete_runs(scores))), test["num_runs"], alpha)
