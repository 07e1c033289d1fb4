"""Probabilities, decisions, member selection, weighting and voting."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.ranks import attach
from pairloom.functions.scalars import argmax_index
from pairloom.operators.metrics import macro_metrics, multilabel_metrics

PROBLEMS = ("binary", "multiclass", "multilabel")


def _check_problem(problem_type: str) -> None:
    if problem_type not in PROBLEMS:
        raise ValueError(f"unsupported problem type: {problem_type}")


def probs_canonical(probs: DataFrame, problem_type: str, col: str = "probs") -> DataFrame:
    """Binary one-column probabilities become [1 - p, p]; other shapes must already fit."""
    _check_problem(problem_type)
    p = F.col(col)
    if problem_type == "binary":
        shaped = F.when(F.size(p) == 1, F.array(1.0 - p[0], p[0])).when(F.size(p) == 2, p)
    else:
        shaped = F.when(F.size(p) >= (2 if problem_type == "multiclass" else 1), p)
    bad = F.raise_error(F.format_string(f"{problem_type} probabilities cannot have %d columns", F.size(p)))
    return probs.withColumn(col, F.coalesce(shaped, bad.cast("array<double>")))


def threshold_resolve(models: DataFrame, default: float = 0.5, by_classifier: Mapping[str, float] | None = None,
                      by_pair: Mapping[str, float] | None = None) -> DataFrame:
    """Threshold per (model_type, embedding_name): pair, then classifier, then default."""
    def looked_up(table: Mapping[str, float] | None, key: Column) -> Column:
        if not table:
            return F.lit(None).cast("double")
        entries = [F.lit(x) for k, v in table.items() for x in (k, float(v))]
        return F.try_element_at(F.create_map(*entries), key)

    pair = F.concat_ws("::", "model_type", "embedding_name")
    return models.withColumn("threshold", F.coalesce(
        looked_up(by_pair, pair), looked_up(by_classifier, F.col("model_type")), F.lit(float(default))
    ))


def decision(probs: Column, problem_type: str, threshold: Column) -> Column:
    """Class index, or for multilabel a 0/1 array."""
    _check_problem(problem_type)
    if problem_type == "binary":
        return (probs[1] >= threshold).cast("int")
    if problem_type == "multiclass":
        return argmax_index(probs)
    return F.transform(probs, lambda p: (p >= threshold).cast("int"))


def decide(probs: DataFrame, problem_type: str, threshold: float | str = 0.5, out: str = "pred") -> DataFrame:
    """``threshold`` is a number or the name of a column."""
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    return probs.withColumn(out, decision(F.col("probs"), problem_type, limit))


def ensemble_select(model_rows: DataFrame, embeddings: Sequence[str] | None = None,
                    classifiers: Sequence[str] | None = None, top_k_per_embedding: int | None = None,
                    top_k_per_classifier: int | None = None, order_col: str = "row_order") -> DataFrame:
    """Members by name, then the best k per embedding, then the best k per classifier, without repeats."""
    out = model_rows
    if embeddings:
        out = out.where(F.col("embedding_name").isin(list(embeddings)))
    if classifiers:
        out = out.where(F.col("model_type").isin(list(classifiers)))
    best_first = [F.col("validation_f1").desc_nulls_last(), F.col(order_col)]
    for key, k in (("embedding_name", top_k_per_embedding), ("model_type", top_k_per_classifier)):
        if k:
            place = F.row_number().over(Window.partitionBy(key).orderBy(*best_first))
            out = out.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
    identity = ["model_type", "embedding_name", "artifact_path"]
    first = F.row_number().over(Window.partitionBy(*identity).orderBy(F.col(order_col)))
    return out.withColumn("_place", first).where("_place = 1").drop("_place")


def weights_uniform(models: DataFrame) -> DataFrame:
    ids = models.select("model_id").distinct()
    return attach(ids, ids.agg(F.count(F.lit(1)).alias("_n")), (), ["_n"]).select(
        "model_id", (F.lit(1.0) / F.col("_n")).alias("weight")
    )


def validation_scores(val_probs: DataFrame, problem_type: str, n_classes: int) -> DataFrame:
    """Macro-F1 per model: arg-max decisions, or 0.5 per class for multilabel."""
    _check_problem(problem_type)
    if problem_type == "multilabel":
        return multilabel_metrics(
            decide(val_probs, "multilabel", 0.5), ["model_id"], "y", "pred"
        ).select("model_id", F.col("f1").alias("score"))
    ruled = val_probs.withColumn("pred", argmax_index(F.col("probs")))
    return macro_metrics(ruled, ["model_id"], "y", "pred").select("model_id", F.col("f1").alias("score"))


def weights_validation(val_probs: DataFrame, problem_type: str, n_classes: int) -> DataFrame:
    """Weights in proportion to the (non-negative) validation score."""
    scores = validation_scores(val_probs, problem_type, n_classes).withColumn("score", F.greatest("score", F.lit(0.0)))
    total = attach(scores, scores.agg(F.sum("score").alias("_total")), (), ["_total"])
    weight = F.when(F.col("_total") > 0, F.col("score") / F.col("_total")).otherwise(
        F.raise_error("sum of weights must be positive").cast("double")
    )
    return total.select("model_id", weight.alias("weight"))


#: Weight vectors that are counted at a time.
TRIAL_BLOCK = 256


def dirichlet_trials(model_ids: Sequence[str], n_trials: int, seed: int) -> np.ndarray:
    """(trials, models) weights: normalized exponentials of md5 uniforms, i.e. Dirichlet(1)."""
    def draw(trial: int, model: str) -> float:
        head = int(hashlib.md5(f"{seed}:{trial}:{model}".encode()).hexdigest()[:8], 16)
        return -math.log((head + 0.5) / 4294967296.0)

    raw = np.array([[draw(t, m) for m in model_ids] for t in range(n_trials)])
    return raw / raw.sum(axis=1, keepdims=True)


def trial_counts(val_probs: DataFrame, model_ids: Sequence[str], weights: np.ndarray, problem_type: str,
                 n_classes: int) -> DataFrame:
    """(trial, label, tp, fp, fn) of every weight vector over the validation samples.

    One matrix product per Arrow batch; only trials x classes count rows leave a batch.
    """
    _check_problem(problem_type)
    members = len(model_ids)
    many = problem_type == "multilabel"
    cells = [
        F.max(F.when(F.col("model_id") == m, F.col("probs")[c].cast("double"))).alias(f"_p{i}_{c}")
        for i, m in enumerate(model_ids) for c in range(n_classes)
    ]
    wide = val_probs.where(F.col("model_id").isin(list(model_ids))).groupBy("accession").agg(
        *cells, F.max("y").alias("y"), F.count(F.lit(1)).alias("_n")
    ).where(F.col("_n") == members)
    flat = wide.select(
        F.array(*[F.col(f"_p{i}_{c}") for i in range(members) for c in range(n_classes)]).alias("p"),
        (F.col("y").cast("array<int>") if many else F.array(F.col("y").cast("int"))).alias("y"),
    )
    trials = len(weights)

    def count(batches):
        for batch in batches:
            if not len(batch):
                continue
            probs = np.stack(batch["p"].to_numpy()).reshape(len(batch), members, n_classes)
            truth_rows = np.stack(batch["y"].to_numpy())
            truth = truth_rows.astype(bool) if many else np.eye(n_classes, dtype=bool)[truth_rows[:, 0]]
            for start in range(0, trials, TRIAL_BLOCK):
                block = range(start, min(trials, start + TRIAL_BLOCK))
                tallies = np.zeros((len(block), 3, n_classes), dtype=np.int64)
                for at, trial in enumerate(block):
                    blend = np.tensordot(weights[trial], probs, axes=(0, 1))
                    if many:
                        pred = blend >= 0.5
                    elif problem_type == "binary":
                        pred = np.eye(2, dtype=bool)[(blend[:, 1] >= 0.5).astype(int)]
                    else:
                        pred = np.eye(n_classes, dtype=bool)[blend.argmax(axis=1)]
                    tallies[at] = (truth & pred).sum(0), (~truth & pred).sum(0), (truth & ~pred).sum(0)
                yield pd.DataFrame({
                    "trial": np.repeat(np.array(block), n_classes), "label": np.tile(np.arange(n_classes), len(block)),
                    **{name: tallies[:, i].ravel() for i, name in enumerate(("tp", "fp", "fn"))},
                })

    partial = flat.mapInPandas(count, "trial int, label int, tp long, fp long, fn long")
    return partial.groupBy("trial", "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def weights_random_search(val_probs: DataFrame, model_ids: Sequence[str], problem_type: str, n_classes: int,
                          n_trials: int = 256, l2: float = 0.0, seed: int = 42,
                          include_uniform: bool = False) -> DataFrame:
    """Best of random weight vectors by macro-F1 minus l2 times the squared norm; the first best wins.

    ``y`` holds class indices (for multilabel 0/1 arrays).
    """
    model_ids = list(model_ids)
    if len(model_ids) < 2:
        raise ValueError("weight search needs at least two models")
    weights = dirichlet_trials(model_ids, max(32, n_trials), seed)
    if include_uniform:
        weights = np.vstack([np.full((1, len(model_ids)), 1.0 / len(model_ids)), weights])
    counts = trial_counts(val_probs, model_ids, weights, problem_type, n_classes)
    seen = F.col("tp") + F.col("fp") + F.col("fn")
    scored = counts if problem_type == "multilabel" else counts.where(seen > 0)
    f1 = F.when(seen == 0, 0.0).otherwise(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    # one row a trial, next to the counts; the plan does not grow with the trials
    table = val_probs.sparkSession.createDataFrame(
        pd.DataFrame({"trial": range(len(weights)), "norm": (weights * weights).sum(axis=1), "weights": weights.tolist()}), "trial int, norm double, weights array<double>")
    loss = -F.round(F.col("f1") - max(0.0, l2) * F.col("norm"), 12)
    best = scored.groupBy("trial").agg(F.avg(f1).alias("f1")).join(table, "trial").agg(
        F.min(F.struct(loss.alias("loss"), "trial", "weights")).alias("_b")).where("_b is not null")
    pairs = F.arrays_zip(F.array(*[F.lit(m) for m in model_ids]).alias("model_id"), F.col("_b.weights").alias("weight"))
    return best.select(F.col("_b.trial").alias("trial"), (-F.col("_b.loss")).alias("score"), F.inline(pairs))


def soft_vote(probs: DataFrame, weights: DataFrame, problem_type: str, n_classes: int, threshold: float = 0.5) -> DataFrame:
    """Weighted mean probabilities per sample and the decision at a fixed threshold."""
    weighted = attach(probs_canonical(probs, problem_type), weights, ["model_id"], ["weight"]).where("weight is not null")
    blend = [F.sum(F.col("weight") * F.col("probs")[i]).alias(f"_p{i}") for i in range(n_classes)]
    voted = weighted.groupBy("accession").agg(*blend).select(
        "accession", F.array(*[F.col(f"_p{i}") for i in range(n_classes)]).alias("probs")
    )
    return decide(voted, problem_type, threshold)


def _majority(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent ``pred`` per key; the smallest label wins a tie."""
    counted = votes.groupBy(*keys, "pred").agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), "pred")).alias("_b")).select(
        *keys, F.col("_b.pred").alias("pred")
    )


def majority_global(preds: DataFrame) -> DataFrame:
    return _majority(preds, ["accession"])


def majority_by_embedding(preds: DataFrame) -> DataFrame:
    """A majority inside each embedding, then a majority of those."""
    return _majority(_majority(preds, ["accession", "embedding_name"]), ["accession"])


def majority_by_classifier(preds: DataFrame) -> DataFrame:
    return _majority(_majority(preds, ["accession", "model_type"]), ["accession"])


def ensemble_summary(weights: DataFrame, scores: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Validation score and weight of every member, with its description where given."""
    out = scores.select("model_id", F.col("score").alias("validation_score")).join(
        weights.select("model_id", "weight"), "model_id", "left"
    )
    return out if members is None else out.join(members, "model_id", "left")


def class_probability(probs: Column, predicted: Column, classes: Sequence, raw_index: Column | None = None) -> Column:
    """Probability of the predicted class; else at the raw index; else the largest."""
    spot = F.array_position(F.array(*[F.lit(str(c)) for c in classes]), predicted.cast("string"))
    named = F.try_element_at(probs, F.when(spot > 0, spot.cast("int")))
    indexed = F.lit(None).cast("double") if raw_index is None else F.try_element_at(
        probs, F.when(raw_index >= 0, (raw_index + 1).cast("int"))
    )
    return F.coalesce(named, indexed, F.array_max(probs))


def ensemble_predictions(votes: DataFrame, samples: DataFrame, strategy: str, seed: int, classes: Sequence) -> DataFrame:
    """Tall prediction rows of one strategy; votes carry ``pred`` as class index and ``probs``."""
    value = F.element_at(F.array(*[F.lit(str(c)) for c in classes]), F.col("pred") + 1)
    return votes.join(samples.select("accession", "true_label"), "accession").select(
        "accession", F.col("true_label").cast("string").alias("true_label"), value.alias("predicted_label"),
        class_probability(F.col("probs"), value, classes, F.col("pred")).alias("prediction_probability"),
        F.lit(strategy).alias("strategy"), F.lit(seed).alias("seed"),
    )
