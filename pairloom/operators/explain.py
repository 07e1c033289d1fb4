"""Feature importance and saliency."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.hashing import pri
from pairloom.functions.ranks import attach, dist_rank
from pairloom.functions.scalars import spread
from pairloom.operators.training import Fitted, batch_predict


def importance_coef(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """|coefficient|, averaged over classes where there are several."""
    model = fitted.model
    if fitted.model_type == "SVM":
        rows = [abs(float(c)) for c in model.coefficients.toArray()]
    else:
        rows = [float(x) for x in abs(model.coefficientMatrix.toArray()).mean(axis=0)]
    return spark.createDataFrame(list(enumerate(rows)), "feature int, importance double")


def importance_tree(spark: SparkSession, fitted: Fitted) -> DataFrame:
    rows = [(i, float(x)) for i, x in enumerate(fitted.model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature int, importance double")


def _margins(fitted: Fitted):
    """Of a linear model: a row's margins, the coefficients as an array of (by feature) arrays (by margin), and the class that margins
    give; None for other models."""
    model = fitted.model
    if hasattr(model, "coefficientMatrix"):
        table, bias = model.coefficientMatrix.toArray(), [model.intercept] if len(fitted.classes) == 2 else list(getattr(model, "bias", getattr(model, "interceptVector", [])))
    elif fitted.model_type == "SVM" and hasattr(model, "coefficients"):
        table, bias = model.coefficients.toArray()[None, :], [model.intercept]
    else:
        return None
    if len(table) != len(bias):
        return None

    @F.pandas_udf("array<double>")
    def margins(vec: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(vec.to_numpy()).astype(float) @ table.T + np.array(bias, dtype=float))) if len(vec) else pd.Series([], dtype=object)

    names = F.array(*[F.lit(c) for c in fitted.classes])

    def decided(m):
        if len(table) > 1:
            return F.element_at(names, F.array_position(m, F.array_max(m)).cast("int"))
        if fitted.platt is not None:  # the margin at which the calibrated probability is one half
            slope, start = float(fitted.platt.coefficients[0]), float(fitted.platt.intercept)
            z = F.lit(start) + F.lit(slope) * m[0]
            return F.when(z >= 0, names[1]).otherwise(names[0])
        return F.when(m[0] >= 0, names[1]).otherwise(names[0])

    weights = F.from_json(F.lit(json.dumps(table.T.tolist())), "array<array<double>>")  # features x margins numbers, as large as the model
    return margins(F.col("vec")), weights, decided


def importance_permutation(fitted: Fitted, df: DataFrame, label: str = "label", features: Sequence[int] | None = None,
                           n_repeats: int = 10, seed: int = 42) -> DataFrame:
    """Mean and population deviation of the accuracy lost when one feature is shuffled.

    A shuffle is a self-join on two exact ranks: the row at position i of the shuffled order takes the
    value of the row at position i of the base order.
    """
    width = df.select(F.size("vec").alias("w")).first()["w"]
    wanted = list(range(width)) if features is None else list(features)
    rows = df.select("accession", label, F.col("vec").cast("array<double>").alias("vec"))
    base = dist_rank(rows, [pri("base", F.col("accession")), F.col("accession")], hashed=True, rank_col="_r")
    shuffles = rows.select("accession").select(
        "accession", F.explode(F.array(*[F.lit(f) for f in wanted])).alias("feature")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("repeat"))
    order = [pri(seed, F.col("feature"), F.col("repeat"), F.col("accession")), F.col("accession")]
    shuffled = dist_rank(shuffles, order, by=["feature", "repeat"], hashed=True, rank_col="_r")
    values = base.select("_r", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col("vec")[f].alias("_value")) for f in wanted
    ])).alias("_v")).select("_r", "_v.*")
    # the swapped numbers of a row meet as one short list, so its vector is joined once and copied only while it is scored
    drawn = shuffled.join(values, ["feature", "_r"]).groupBy("accession").agg(F.collect_list(F.struct("feature", "repeat", "_value")).alias("_s"))
    joined = rows.join(drawn, "accession")
    hit = (F.col("predicted_label") == F.col(label)).cast("double")
    linear = _margins(fitted)
    if linear is not None:
        # one changed feature moves a margin by coefficient * (new - old): a number a feature and repeat, and no copy of the vector
        margins, weights, decide_label = linear
        moved = joined.select(label, margins.alias("_m"), F.expr("transform(_s, s -> struct(s.feature, s.repeat, s._value - vec[s.feature] as _by))").alias("_s"))
        moved = moved.select(label, "_m", F.inline("_s"))
        steps = F.element_at(weights, F.col("feature") + 1)
        shifted = F.zip_with(F.col("_m"), F.zip_with(steps, F.array_repeat("_by", F.size("_m")), lambda w, by: w * by), lambda m, d: m + d)
        scored = moved.select(label, "feature", "repeat", shifted.alias("_m")).withColumn("predicted_label", decide_label(F.col("_m")))
    else:
        swapped = joined.select("accession", label, "vec", F.inline("_s")).withColumn("vec", F.transform(
            "vec", lambda x, i: F.when(i == F.col("feature"), F.col("_value")).otherwise(x)
        ))
        scored = batch_predict(fitted, swapped)
    after = scored.groupBy("feature", "repeat").agg(F.avg(hit).alias("_acc"))
    before = batch_predict(fitted, rows).agg(F.avg(hit).alias("_base"))
    drop = F.col("_base") - F.col("_acc")
    return attach(after, before, (), ["_base"]).groupBy("feature").agg(
        F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("std")
    )


def importance_auto(fitted: Fitted, df: DataFrame, label: str = "label", **kwargs) -> DataFrame:
    """Coefficients, else tree importances, else permutation."""
    if hasattr(fitted.model, "coefficientMatrix") or fitted.model_type == "SVM" and hasattr(fitted.model, "coefficients"):
        return importance_coef(df.sparkSession, fitted)
    if hasattr(fitted.model, "featureImportances"):
        return importance_tree(df.sparkSession, fitted)
    return importance_permutation(fitted, df, label, **kwargs)


def top_features(importances: DataFrame, n: int = 10) -> DataFrame:
    return importances.orderBy(F.col("importance").desc(), "feature").limit(n)


def _logistic(coefficients: Sequence[float], intercept: float):
    w = F.array(*[F.lit(float(c)) for c in coefficients])
    dot = F.aggregate(F.zip_with("vec", w, lambda x, c: x.cast("double") * c), F.lit(0.0), lambda a, x: a + x)
    return w, dot, F.lit(float(intercept))


def saliency_gradient(df: DataFrame, coefficients: Sequence[float], intercept: float = 0.0) -> DataFrame:
    """Exact input gradient p(1-p)w of a logistic model."""
    w, dot, b = _logistic(coefficients, intercept)
    out = df.withColumn("_p", 1.0 / (1.0 + F.exp(-(dot + b))))
    slope = spread(F.col("_p") * (1.0 - F.col("_p")), w)
    return out.withColumn("saliency", F.zip_with(w, slope, lambda c, s: c * s)).drop("_p")


def saliency_integrated(df: DataFrame, coefficients: Sequence[float], intercept: float = 0.0, steps: int = 50) -> DataFrame:
    """Path integral of the gradient from the zero vector, trapezoid rule over ``steps`` points.

    Along the path the gradient is a scalar times w, so only that scalar is integrated.
    """
    w, dot, b = _logistic(coefficients, intercept)
    out = df.withColumn("_z", dot)
    grid = F.sequence(F.lit(0), F.lit(steps - 1))

    # logits along the path, then p(1-p) at each point
    logits = F.zip_with(grid, F.array_repeat(F.col("_z"), steps), lambda i, z: z * i.cast("double") / (steps - 1) + b)
    points = F.transform(logits, lambda t: F.exp(-F.abs(t)))
    slopes = F.transform(points, lambda e, i: e / ((1.0 + e) * (1.0 + e)) * F.when((i == 0) | (i == steps - 1), 0.5).otherwise(1.0))
    path = F.aggregate(slopes, F.lit(0.0), lambda acc, s: acc + s) / (steps - 1)
    pull = F.zip_with("vec", w, lambda x, c: x.cast("double") * c)
    return out.withColumn("saliency", F.zip_with(pull, spread(path, F.col("vec")), lambda x, s: x * s)).drop("_z")


def salient_dims(saliency: DataFrame, n: int = 10) -> DataFrame:
    """Mean saliency over samples, the n largest by absolute value."""
    mean = saliency.agg(Summarizer.mean(array_to_vector(F.col("saliency").cast("array<double>"))).alias("_m"))
    return mean.select(F.posexplode(vector_to_array("_m")).alias("dimension", "saliency")).orderBy(
        F.abs("saliency").desc(), "dimension"
    ).limit(n)
