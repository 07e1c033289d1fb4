"""Parameter trials and their result tables."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions.hashing import uniform
from pairloom.functions.scalars import nan_to_null


def _draw(name: str, spec: Mapping, seed: int) -> Column | None:
    """Sampled value as text: categorical pick, inclusive integers, uniform or log-uniform."""
    u = uniform(seed, F.col("trial"), F.lit(name))
    if "values" in spec:
        values = list(spec["values"])
        if not values:
            return None
        texts = F.array(*[F.lit(v if isinstance(v, str) else json.dumps(v, sort_keys=True)) for v in values])
        return F.element_at(texts, F.floor(u * len(values)).cast("int") + 1)
    if "min" not in spec or "max" not in spec:
        return None
    kind = str(spec.get("distribution", "uniform"))
    if kind == "int_uniform":
        low, high = int(spec["min"]), int(spec["max"])
        return (F.lit(low) + F.floor(u * (high - low + 1))).cast("long").cast("string")
    low, high = float(spec["min"]), float(spec["max"])
    if kind in ("log_uniform", "log_uniform_values"):
        low, high = math.log(low), math.log(high)
        return F.exp(F.lit(low) + u * (high - low)).cast("string")
    return (F.lit(low) + u * (high - low)).cast("string")


def sweep_trials(spark: SparkSession, space: Mapping[str, Mapping], n_trials: int, seed: int = 42) -> DataFrame:
    """Random search as (trial, param, value) rows; every draw depends on seed, trial and name only."""
    draws = {name: _draw(name, spec, seed) for name, spec in space.items()}
    cells = [F.struct(F.lit(n).alias("param"), v.alias("value")) for n, v in draws.items() if v is not None]
    return spark.range(max(1, n_trials)).withColumnRenamed("id", "trial").select("trial", F.inline(F.array(*cells)))


def trial_params(trials: DataFrame) -> list[dict]:
    """Trial settings for the driver's fit loop, in trial order."""
    rows = trials.groupBy("trial").agg(F.map_from_entries(F.collect_list(F.struct("param", "value"))).alias("p")).orderBy("trial")

    def plain(text: str):
        try:
            return json.loads(text)
        except json.JSONDecodeError:
            return text

    return [{k: plain(v) for k, v in r["p"].items()} for r in rows.collect()]


def grid_trials(settings: DataFrame, runs: int = 1) -> DataFrame:
    """(combo, run, param, value) of the cartesian product of a table of settings (param, value), repeated ``runs`` times.

    Parameters count in name order, the last one fastest, and values in text order; a combination is a number whose digits are
    the places of its values, so the product is spread over tasks and only the number of values per parameter comes to the driver.
    """
    lists = settings.select("param", F.col("value").cast("string").alias("value")).where("value is not null").groupBy("param").agg(F.sort_array(F.collect_set("value")).alias("values"))
    sizes = {r["param"]: r["n"] for r in lists.select("param", F.size("values").alias("n")).orderBy("param").collect()}
    names, strides, total = list(sizes), {}, 1
    for name in reversed(names):
        strides[name] = total
        total *= sizes[name]
    spark = settings.sparkSession
    if not names:
        return spark.createDataFrame([], "combo long, run long, param string, value string")
    combos = spark.range(total).withColumnRenamed("id", "combo").select("combo", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))).alias("run"), F.posexplode(F.array(*map(F.lit, names))).alias("_i", "param"))
    stride, size = (F.get(F.array(*(F.lit(d[n]).cast("long") for n in names)), F.col("_i")) for d in (strides, sizes))
    placed = combos.withColumn("_at", (F.floor(F.col("combo") / stride) % size).cast("int"))
    return placed.join(lists, "param").select("combo", "run", "param", F.get("values", F.col("_at")).alias("value"))


def _first_best(rows: DataFrame, key: str, score: Column, order_col: str) -> DataFrame:
    scored = rows.withColumn("_score", nan_to_null(score)).where("_score is not null")
    line = Window.partitionBy(key).orderBy(F.col("_score").desc(), F.col(order_col))
    return scored.withColumn("_rn", F.row_number().over(line)).where("_rn = 1").drop("_rn")


def best_per_embedding(trial_rows: DataFrame, order_col: str = "trial") -> DataFrame:
    """Best classifier per embedding by validation f1; the first wins a tie."""
    return _first_best(trial_rows, "embedding_name", F.col("validation_f1"), order_col).select(
        "embedding_name", "model_type", F.col("_score").alias("validation_f1"), *_config(trial_rows)
    ).orderBy("embedding_name")


def best_config_per_embedding(trial_rows: DataFrame, order_col: str = "trial") -> DataFrame:
    """Best configuration per embedding; ``f1`` falls back to ``macro_f1``."""
    score = F.coalesce("validation_f1", "validation_macro_f1")
    return _first_best(trial_rows, "embedding_name", score, order_col).select(
        "embedding_name", *_config(trial_rows), F.col("_score").alias("score")
    )


def best_per_classifier(trial_rows: DataFrame, metric: str = "validation_f1", order_col: str = "trial") -> DataFrame:
    """Best embedding and metric of each classifier."""
    return _first_best(trial_rows, "model_type", F.col(metric), order_col).select(
        "model_type", F.col("embedding_name").alias("best_embedding"), F.col("_score").alias("best_metric"), *_config(trial_rows)
    ).orderBy("model_type")


def global_best(trial_rows: DataFrame, metric: str = "validation_f1", order_col: str = "trial") -> DataFrame:
    return _first_best(trial_rows.withColumn("_all", F.lit(1)), "_all", F.col(metric), order_col).select(
        "model_type", "embedding_name", F.col("_score").alias("best_metric"), *_config(trial_rows)
    )


def _config(rows: DataFrame) -> list[str]:
    return ["config"] if "config" in rows.columns else []


def sweep_summary_pivot(trial_rows: DataFrame, models: Sequence[str]) -> DataFrame:
    """Embedding x classifier table of the largest validation f1."""
    score = nan_to_null(F.coalesce("validation_f1", "validation_macro_f1"))
    return trial_rows.withColumn("_f1", score).where("_f1 is not null").groupBy("embedding_name").pivot(
        "model_type", list(models)
    ).agg(F.max("_f1")).orderBy("embedding_name")


def sweep_full_table(trial_rows: DataFrame, final_rows: DataFrame | None = None, seed_used: int | None = None) -> DataFrame:
    """Trials and final fits in one flat table.

    Rows hold ``validation`` and ``test`` structs (accuracy, precision, recall, f1, macro_f1, roc_auc,
    pr_auc, tp, tn, fp, fn, confusion_matrix); counts come from the test struct where there is one.
    """
    rows = trial_rows if final_rows is None else trial_rows.unionByName(final_rows, allowMissingColumns=True)
    source = F.coalesce("test", "validation")
    cm = source["confusion_matrix"]
    square = (F.size(cm) == 2) & (F.size(cm[0]) == 2) & (F.size(cm[1]) == 2)
    complete = source["tp"].isNotNull() & source["tn"].isNotNull() & source["fp"].isNotNull() & source["fn"].isNotNull()

    def count(name: str, i: int, j: int) -> Column:
        return F.when(complete, source[name].cast("double")).when(square, cm[i][j].cast("double")).alias(name.upper())

    seed = F.col("seed_used") if "seed_used" in rows.columns else F.lit(None)
    return rows.select(
        "model_type", "embedding_name",
        *[F.col(f"validation.{m}").alias(f"validation_{m}") for m in ("accuracy", "precision", "recall")],
        F.coalesce("validation.f1", "validation.macro_f1").alias("validation_f1"),
        *[F.col(f"test.{m}").alias(f"test_{m}") for m in ("accuracy", "precision", "recall")],
        F.coalesce("test.f1", "test.macro_f1").alias("test_f1"),
        F.col("test.roc_auc").alias("test_roc_auc"), F.col("test.pr_auc").alias("test_pr_auc"),
        count("tp", 1, 1), count("tn", 0, 0), count("fp", 0, 1), count("fn", 1, 0),
        F.coalesce(seed.cast("int"), F.lit(seed_used).cast("int")).alias("seed_used"),
    )
