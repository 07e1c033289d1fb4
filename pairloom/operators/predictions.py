"""Prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.ranks import attach
from pairloom.functions.scalars import serialize_label
from pairloom.operators.ensembles import class_probability, decision


def prediction_rows(samples: DataFrame, probs: DataFrame, classes: Sequence, problem_type: str = "binary",
                    thresholds: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Tall rows (accession, true, predicted, probability of the predicted class, model, embedding, seed).

    ``thresholds`` has one row per (model_type, embedding_name); without it 0.5 applies.
    """
    key = ["model_type", "embedding_name"]
    rows = probs.join(samples.select("accession", "true_label"), "accession")
    if thresholds is not None:
        rows = attach(rows, thresholds, key, ["threshold"])
    limit = F.coalesce("threshold", F.lit(0.5)) if thresholds is not None else F.lit(0.5)
    rows = rows.withColumn("_i", decision(F.col("probs"), problem_type, limit))
    names = F.array(*[F.lit(str(c)) for c in classes])
    if problem_type == "multilabel":
        on = F.filter(F.transform(F.col("_i"), lambda x, i: F.when(x == 1, F.get(names, i))), lambda v: v.isNotNull())
        label, probability = F.to_json(on), F.array_max("probs")
    else:
        label = F.element_at(names, F.col("_i") + 1)
        probability = class_probability(F.col("probs"), label, classes, F.col("_i"))
    return rows.select(
        "accession", F.col("true_label").cast("string").alias("true_label"), label.alias("predicted_label"),
        probability.alias("prediction_probability"), *key, F.lit(seed).alias("seed"),
    )


def predictions_wide(rows: DataFrame, expected: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """One row per accession (and ``by``, such as the seed) with ``pred_`` and ``missing_reason_`` columns for every expected model.

    The pivot columns are the expected models, so one aggregation does it; which models are there at all is found in one more.
    """
    model = F.struct(F.col("model_type").alias("m"), F.col("embedding_name").alias("v"))
    available = rows.select(model.alias("_m")).distinct().agg(F.collect_list("_m").alias("_have"))
    out = []
    for model, view in expected:
        mine = (F.col("model_type") == model) & (F.col("embedding_name") == view)
        out.append(F.max(F.when(mine, F.col("predicted_label"))).alias(f"pred_{model}__{view}"))
    wide = attach(rows.groupBy(*by, "accession").agg(F.min("true_label").alias("true_label"), *out), available, (), ["_have"])
    for model, view in expected:
        known = F.array_contains("_have", F.struct(F.lit(model).alias("m"), F.lit(view).alias("v")))
        wide = wide.withColumn(f"missing_reason_{model}__{view}", F.when(known, "").otherwise("model_not_available"))
    return wide.drop("_have").withColumn("dataset_split", F.lit("test"))


def dataset_snapshot(samples: DataFrame) -> DataFrame:
    """(accession, label, dataset_split) without the zero-shot holdout."""
    return samples.where("split <> 'zero_shot'").select(
        "accession", serialize_label(F.col("labels")).alias("label"), F.col("split").alias("dataset_split")
    )
