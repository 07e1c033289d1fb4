"""Classifier fits on Spark ML, grids and sweeps over views, and batch scoring."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from pairloom.functions.ranks import attach
from pairloom.functions.scalars import spread
from pairloom.operators.ensembles import decide, decision
from pairloom.operators.labels import class_list, multilabel_binarize
from pairloom.operators.linear import Linear, LinearModel, fit_linear, shares
from pairloom.operators.metrics import binary_metrics, macro_metrics, metrics_clean, multilabel_metrics, ranking_metrics, weighted_metrics
from pairloom.operators.neighbours import train_knn
from pairloom.operators.sweeps import sweep_trials, trial_params
from pairloom.operators.vectors import l2_normalize, standard_scale
from pairloom.session import shared_dir

# Settings of the original parameter names and the Spark ML parameters that stand for them.
LR_PARAMS = {"max_iter": "maxIter", "tol": "tol", "fit_intercept": "fitIntercept"}
RF_PARAMS = {
    "n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "criterion": "impurity",
    "max_features": "featureSubsetStrategy", "max_samples": "subsamplingRate", "bootstrap": "bootstrap",
}
GBT_PARAMS = {
    "n_estimators": "maxIter", "max_depth": "maxDepth", "learning_rate": "stepSize", "subsample": "subsamplingRate",
    "min_child_weight": "minInstancesPerNode", "colsample_bytree": "featureSubsetStrategy",
}
# What the estimators start from where a setting isn't given; trees of any depth are trees of Spark's largest depth.
DEFAULTS = {
    "LR": {"maxIter": 100, "tol": 1e-4}, "SVM": {"maxIter": 100, "tol": 1e-6}, "RF": {"numTrees": 100, "maxDepth": 30},
    "GBT": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3},
}
OTHER_PARAMS = {
    "LR": {"C", "penalty", "l1_ratio", "class_weight"}, "SVM": {"C", "class_weight", "kernel"}, "RF": {"class_weight"}, "GBT": set(),
    "MLP": {"epochs", "num_epochs", "hidden_layers_mode", "custom_hidden_layers", "num_hidden_layers"}, "KNN": {"n_neighbors", "weights", "metric", "p"},
}
# Settings that may stand in a group of their own, and those that say how a fit runs, not what it gives.
GROUPS = {"SVM": "kernel_config", "RF": "bootstrap_config", "KNN": "p_metric", "MLP": "custom_layer_config"}
RUNTIME = {
    "n_jobs", "random_state", "seed", "verbose", "solver", "device", "tree_method", "probability", "eval_metric", "algorithm", "leaf_size", "shrinking", "cache_size",
}
# Settings of the sweep spaces that Spark's fits have no counterpart for, and the value at which each says nothing.
UNUSED = {
    "RF": {"min_samples_split": 2},
    "SVM": {"gamma": None, "degree": None, "coef0": None},
    "MLP": {
        "dropout_rate": 0.0, "activation_function": "Sigmoid", "use_batch_norm": False, "output_activation": None, "initialization": None, "optimizer_group": None,
        "optimizer_name": None, "learning_rate": None, "early_stopping_patience": None, "criterion_name": "CrossEntropyLoss", "batch_size": None,
    },
}
CALIBRATION_FOLDS = 3


@dataclass
class Fitted:
    """A fitted classifier: Spark ML model(s), its classes and the view it was trained on."""

    model_type: str
    classes: list
    model: Model | Neighbours | LinearModel
    platt: Model | None = None
    view: str | None = None
    params: dict = field(default_factory=dict)


@dataclass
class Neighbours:
    """What a k-nearest-neighbour classifier keeps: its training rows and how they vote."""

    rows: DataFrame
    k: int
    metric: str
    weights: str


def class_weights(samples: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights: n / (classes * count of the class)."""
    counts = samples.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    facts = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).alias("_f"))
    total = facts.select("_f").scalar()
    return counts.select("label", (total["n"] / (total["k"] * F.col("n"))).alias("weight"))


def flat_params(kind: str, params: Mapping | None) -> dict:
    """Settings with their group spread out; a setting that is neither used nor known to have no counterpart is an error."""
    flat = dict(params or {})
    group = flat.pop(GROUPS.get(kind, ""), None)
    if kind != "MLP" or flat.get("hidden_layers_mode", "custom") == "custom":
        flat.update(group or {})
    if flat.get("max_iter") == -1:  # no limit
        flat["max_iter"] = 2 ** 31 - 1
    if flat.get("class_weight") == "balanced_subsample":  # balanced over all rows instead of over each tree's draw
        flat["class_weight"] = "balanced"
    names = {"LR": LR_PARAMS, "SVM": LR_PARAMS, "RF": RF_PARAMS, "GBT": GBT_PARAMS}.get(kind, {})
    unknown = {k for k, v in flat.items() if v is not None} - set(names) - OTHER_PARAMS[kind] - RUNTIME - set(UNUSED.get(kind, {}))
    if unknown:
        raise ValueError(f"{kind} can't take {sorted(unknown)}")
    if flat.get("class_weight") not in (None, "balanced"):
        raise ValueError(f"class_weight {flat['class_weight']!r} is not supported")
    if kind == "SVM" and flat.get("kernel", "linear") != "linear":
        raise ValueError("only linear kernels are supported")
    return flat


def dropped_settings(kind: str, params: Mapping | None) -> list[str]:
    """Names of the given settings that a fit leaves aside although they say something, and of those it can only follow in part."""
    kind = kind_of(kind)
    given = dict(params or {})
    flat = flat_params(kind, given)
    lost = [k for k, neutral in UNUSED.get(kind, {}).items() if flat.get(k) is not None and flat[k] != neutral]
    return sorted(lost + (["class_weight"] if given.get("class_weight") == "balanced_subsample" else []))


def _value(name: str, value):
    if name == "impurity":
        return {"log_loss": "entropy"}.get(value, value)
    if name == "featureSubsetStrategy":
        return {"sqrt": "sqrt", "log2": "log2", "auto": "auto"}.get(value, "all" if value in (None, 1.0) else str(value))
    if name == "minInstancesPerNode":
        return max(1, int(-(-value // 1)))
    return value


def _mapped(params: Mapping, names: Mapping[str, str]) -> dict:
    return {names[k]: _value(names[k], v) for k, v in params.items() if k in names and v is not None}


def hidden_layers(params: Mapping, input_size: int) -> list[int]:
    """Custom sizes, or a chain that doubles up to half the input size."""
    if params.get("hidden_layers_mode", "quadratic_increase") == "custom":
        return [int(x) for x in params["custom_hidden_layers"]]
    layers = int(params.get("num_hidden_layers", 2))
    return [max(1, input_size // 2 ** (layers - i)) for i in range(layers)]


def _ready(features: DataFrame, classes: Sequence, label: str) -> DataFrame:
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    return features.select(
        "*", array_to_vector(F.col("vec").cast("array<double>")).alias("_features"), index.cast("double").alias("_label")
    )


def kind_of(model_type: str) -> str:
    kind = model_type.upper()
    return {"XGB": "GBT", "KNN-2": "KNN"}.get(kind, kind)


def train_model(features: DataFrame, model_type: str, params: Mapping | None = None, label: str = "label",
                classes: Sequence | None = None, seed: int = 42) -> Fitted:
    """Fit one classifier on one view; ``features`` has ``vec`` and the label column.

    The penalty of LR and SVM is that of C (1 unless given) over the summed loss: 1 / (C n) on the mean loss, on the features as they
    are. The margin of a binary SVM becomes a probability by a logistic curve fitted on margins of rows its machine has not seen.
    """
    kind = kind_of(model_type)
    if kind not in OTHER_PARAMS:
        raise ValueError(f"unsupported model type: {model_type}")
    params = flat_params(kind, params)
    classes = list(classes) if classes is not None else class_list(features, label)
    if kind == "KNN":
        metric = {1: "manhattan", 2: "euclidean"}.get(params.get("p", 2)) if params.get("metric", "minkowski") == "minkowski" else params["metric"]
        if metric is None:
            raise ValueError(f"unsupported distance: p = {params['p']}")
        rows = features.select("accession", F.col(label).cast("string").alias("label"), "vec")
        return Fitted(model_type.upper(), classes, Neighbours(rows, int(params.get("n_neighbors", 5)), metric, params.get("weights", "uniform")), params=params)
    train = _ready(features, classes, label)
    common = {"featuresCol": "_features", "labelCol": "_label"}
    if params.get("class_weight") == "balanced":
        train = attach(train, class_weights(features, label).select(F.col("label").alias(label), F.col("weight").alias("_w")), [label], ["_w"])
        common["weightCol"] = "_w"
    platt = None
    each = {"featuresCol": "_features", "labelCol": "_label", "rawPredictionCol": "rawPrediction"}
    if kind in ("LR", "SVM"):
        settings = {"regParam": 1.0 / (float(params.get("C") or 1.0) * max(1, features.count())), "standardization": False, **DEFAULTS[kind], **_mapped(params, LR_PARAMS)}
    if kind == "LR":
        mix = {"l1": 1.0, "elasticnet": float(params.get("l1_ratio") or 0.5)}.get(params.get("penalty"), 0.0)
        model = LogisticRegression(**common, **settings, elasticNetParam=mix).fit(train)
    elif kind == "RF":
        # each row keeps its node of every tree, so a pass doesn't walk all trees again from their roots
        shared_dir(features.sparkSession)  # where the nodes are checkpointed, so that their lineage stays short
        model = RandomForestClassifier(seed=seed, cacheNodeIds=True, **common, **{**DEFAULTS["RF"], **_mapped(params, RF_PARAMS)}).fit(train)
    elif kind == "GBT":
        booster = GBTClassifier(seed=seed, featuresCol="_features", labelCol="_label", **{**DEFAULTS["GBT"], **_mapped(params, GBT_PARAMS)})
        model = booster.fit(train) if len(classes) == 2 else OneVsRest(classifier=booster, **each).fit(train)
    elif kind == "SVM":
        machine = LinearSVC(**common, **settings)
        if len(classes) == 2:
            model = machine.fit(train)
            folded = train.withColumn("_fold", F.pmod(F.xxhash64("vec"), F.lit(CALIBRATION_FOLDS)))
            parts = [_margin(machine.fit(folded.where(F.col("_fold") != i)).transform(folded.where(F.col("_fold") == i))) for i in range(CALIBRATION_FOLDS)]
            platt = LogisticRegression(**{**common, "featuresCol": "_margin"}).fit(reduce(DataFrame.unionByName, parts))
        else:
            model = OneVsRest(classifier=machine, **each).fit(train)
    else:
        width = train.select(F.size("vec").alias("w")).first()["w"]
        layers = [width, *hidden_layers(params, width), max(2, len(classes))]
        model = MultilayerPerceptronClassifier(
            layers=layers, seed=seed, featuresCol="_features", labelCol="_label", maxIter=int(params.get("epochs") or params.get("num_epochs") or 100)
        ).fit(train)
    return Fitted(model_type.upper(), classes, model, platt, params=params)


def train_lr(features: DataFrame, params: Mapping | None = None, label: str = "label") -> Fitted:
    return train_model(features, "LR", params, label)


def train_rf(features: DataFrame, params: Mapping | None = None, label: str = "label") -> Fitted:
    return train_model(features, "RF", params, label)


def train_gbt(features: DataFrame, params: Mapping | None = None, label: str = "label") -> Fitted:
    return train_model(features, "GBT", params, label)


def train_linear_svm(features: DataFrame, params: Mapping | None = None, label: str = "label") -> Fitted:
    return train_model(features, "SVM", params, label)


def train_mlp(features: DataFrame, params: Mapping | None = None, label: str = "label") -> Fitted:
    return train_model(features, "MLP", params, label)


def one_vs_rest(features: DataFrame, model_type: str, classes: Sequence, params: Mapping | None = None,
                labels: str = "labels") -> dict:
    """Multilabel: one binary model per class over the ``labels`` array; logistic models are fitted together, one pass a step."""
    if kind_of(model_type) == "LR":
        flat = flat_params("LR", params)
        rows = features.select("vec", F.array(*[F.array_contains(labels, F.lit(c)).cast("int") for c in classes]).alias("target"))
        models = fit_linear(rows, [_linear_task(flat, i) for i in range(len(classes))])
        return {c: Fitted(model_type.upper(), [0, 1], m, params=flat) for c, m in zip(classes, models)}
    return {
        c: train_model(features.withColumn("_is", F.array_contains(labels, F.lit(c)).cast("int")), model_type, params, "_is", [0, 1])
        for c in classes
    }


def _linear_task(flat: Mapping, target: int = 0) -> Linear:
    """A logistic fit's settings as ``train_model`` reads them."""
    mix = {"l1": 1.0, "elasticnet": float(flat.get("l1_ratio") or 0.5)}.get(flat.get("penalty"), 0.0)
    mapped = {**DEFAULTS["LR"], **_mapped(flat, LR_PARAMS)}
    return Linear(float(flat.get("C") or 1.0), mix, flat.get("class_weight") == "balanced", int(mapped["maxIter"]), float(mapped["tol"]),
                  bool(mapped.get("fitIntercept", True)), target)


def predict_multilabel(models: Mapping, df: DataFrame) -> DataFrame:
    """``probs`` with the positive probability of every class model, in order."""
    out = df
    if models and all(isinstance(m.model, LinearModel) for m in models.values()):
        scored = df.withColumn("_all", shares([m.model for m in models.values()], F.col("vec")))
        return scored.withColumn("probs", F.transform("_all", lambda p: p[1])).drop("_all")
    for i, fitted in enumerate(models.values()):
        out = batch_predict_proba(fitted, out).withColumn(f"_p{i}", F.col("probs")[1]).drop("probs")
    names = [f"_p{i}" for i in range(len(models))]
    return out.withColumn("probs", F.array(*names)).drop(*names)


def _margin(scored: DataFrame) -> DataFrame:
    return scored.withColumn("_margin", array_to_vector(F.array(vector_to_array("rawPrediction")[1]))).drop(
        "rawPrediction", "prediction"
    )


def _softmax(raw: Column) -> Column:
    """Class shares of one-vs-rest scores."""
    squashed = F.transform(raw, lambda x: 1.0 / (1.0 + F.exp(-x)))
    total = F.aggregate(squashed, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(squashed, spread(total, squashed), lambda x, t: x / t)


def batch_predict_proba(fitted: Fitted, df: DataFrame) -> DataFrame:
    """``df`` plus ``probs``; a stateless transform, so it also applies to a streaming DataFrame (but for neighbours)."""
    if isinstance(fitted.model, Neighbours):
        return _neighbour_proba(fitted, df)
    if isinstance(fitted.model, LinearModel):
        return df.withColumn("probs", shares([fitted.model], F.col("vec"))[0])
    ready = df.withColumn("_features", array_to_vector(F.col("vec").cast("array<double>")))
    scored = fitted.model.transform(ready)
    if fitted.platt is not None:
        scored = fitted.platt.transform(_margin(scored))
    if "probability" in scored.columns:
        probs = vector_to_array("probability")
    else:
        probs = _softmax(vector_to_array("rawPrediction"))
    return scored.select(*df.columns, probs.alias("probs"))


def _neighbour_proba(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Vote shares of the k nearest training rows; ``df`` needs an accession."""
    own = fitted.model
    votes = train_knn(own.rows, df.select("accession", "vec").dropDuplicates(["accession"]), own.k, own.metric, own.weights)
    shares = votes.groupBy("accession").agg(F.map_from_entries(F.collect_list(F.struct("label", "prob"))).alias("_votes"))
    probs = F.array(*[F.coalesce(F.try_element_at("_votes", F.lit(str(c))), F.lit(0.0)) for c in fitted.classes])
    joined = df.withColumn("_accession", F.col("accession").cast("string")).join(shares.withColumnRenamed("accession", "_accession"), "_accession", "left")
    return joined.withColumn("probs", probs).select(*df.columns, "probs")


def batch_predict(fitted: Fitted, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``df`` plus ``probs`` and the predicted class: of two classes the second from ``threshold`` on, else the likeliest."""
    names = F.array(*[F.lit(c) for c in fitted.classes])
    kind = "binary" if len(fitted.classes) == 2 else "multiclass"
    return batch_predict_proba(fitted, df).withColumn("predicted_label", F.element_at(names, decision(F.col("probs"), kind, F.lit(float(threshold))) + 1))


def normalize(features: DataFrame, mode: str = "none") -> DataFrame:
    if mode == "none":
        return features
    if mode == "l2":
        return l2_normalize(features)
    if mode == "standard":
        return standard_scale(features)
    raise ValueError(f"unknown normalization: {mode}")


def view_metrics(scored: DataFrame, classes: Sequence, label: str = "label", average: str = "macro", by: Sequence[str] = ("split",)) -> DataFrame:
    """Tall metrics per split: binary with areas, or averaged over classes (macro or weighted by support)."""
    if average not in ("macro", "weighted"):
        raise ValueError(f"unknown average: {average}")
    by = list(by)
    if len(classes) == 2:
        wide = binary_metrics(scored, by, label, "predicted_label", pos_label=classes[-1]).join(
            ranking_metrics(scored.withColumn("_s", F.col("probs")[1]), by, label, "_s", classes[-1]), by, "left"
        )
        names = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "TP", "TN", "FP", "FN"]
    else:
        wide = (macro_metrics if average == "macro" else weighted_metrics)(scored, by, label, "predicted_label")
        names = ["accuracy", "precision", "recall", "f1"]
    return metrics_clean(wide, by, names, prefix="")


def multilabel_view_metrics(models: Mapping, rows: DataFrame, label: str, threshold: float) -> DataFrame:
    """Tall metrics per split of one model per class."""
    scored = decide(predict_multilabel(models, rows), "multilabel", threshold)
    wide = multilabel_metrics(multilabel_binarize(scored, label, list(models), "_y"), ["split"], "_y", "pred")
    return metrics_clean(wide, ["split"], ["precision", "recall", "f1", "micro_f1"], prefix="")


def _held(df: DataFrame) -> tuple[DataFrame, bool]:
    """The frame cached, and whether it was cached here, so that it is ours to drop."""
    return (df, False) if df.is_cached else (df.persist(), True)


def _threshold(thresholds: Mapping[str, float] | None, kind: str, view: str) -> float:
    """Of ``model::view``, then of the model, then of ``default``, then one half."""
    given = thresholds or {}
    return float(next((given[k] for k in (f"{kind}::{view}", kind, "default") if k in given), 0.5))


RESULT = "model_type string, view string, split string, metric string, value double"


def _fit_and_score(train: DataFrame, scored: DataFrame, kind: str, view: str, params: Mapping | None, label: str, classes: Sequence, seed: int,
                   threshold: float, average: str):
    """(models, tall rows) of one cell of the grid; array labels get one model per class."""
    if isinstance(train.schema[label].dataType, ArrayType):
        fitted = one_vs_rest(train, kind, classes, params, label)
        for part in fitted.values():
            part.view = view
        rows = multilabel_view_metrics(fitted, scored, label, threshold)
    else:
        fitted = train_model(train, kind, params, label, classes, seed)
        fitted.view = view
        rows = view_metrics(batch_predict(fitted, scored, threshold), classes, label, average)
    return fitted, [(kind, view, r["split"], r["metric"], r["value"]) for r in rows.collect()]


def _classes(df: DataFrame, label: str) -> list:
    many = isinstance(df.schema[label].dataType, ArrayType)
    return class_list(df.select(F.explode(label).alias(label)) if many else df, label)


def train_matrix(features: DataFrame, model_types: Sequence[str], params: Mapping[str, Mapping] | None = None,
                 label: str = "label", normalization: str = "none", evaluate_test: bool = False,
                 views: Iterable[str] | None = None, parallelism: int = 4, seed: int = 42,
                 fit_splits: Sequence[str] = ("train",), thresholds: Mapping[str, float] | None = None,
                 metrics_average: str = "macro") -> tuple[DataFrame, dict[tuple[str, str], Fitted | dict]]:
    """Every model type on every view: tall (model_type, view, split, metric, value) rows and the models.

    Fits are independent Spark jobs, submitted by a small thread pool. A label column of arrays makes every cell multilabel: one
    binary model per class. ``thresholds`` decide binary and multilabel classes, by ``model::view``, model or ``default``.
    """
    params = params or {}
    ready, ours = _held(normalize(features, normalization))
    views = sorted(views) if views is not None else class_list(ready, "view")
    classes = _classes(ready, label)
    score_splits = ["val", "validation"] + (["test"] if evaluate_test else [])

    def one(job: tuple[str, str]):
        kind, view = job
        mine = ready.where(F.col("view") == view)
        train, scored = mine.where(F.col("split").isin(list(fit_splits))), mine.where(F.col("split").isin(score_splits))
        return job, *_fit_and_score(train, scored, kind, view, params.get(kind), label, classes, seed, _threshold(thresholds, kind, view), metrics_average)

    jobs = [(kind, view) for kind in model_types for view in views]
    with ThreadPool(parallelism) as pool:
        done = pool.map(one, jobs)
    if ours:
        ready.unpersist()
    table = features.sparkSession.createDataFrame([row for _, _, part in done for row in part], RESULT)
    return table, {job: fitted for job, fitted, _ in done}


def final_retrain(features: DataFrame, best: Mapping[str, tuple[str, Mapping]], label: str = "label",
                  normalization: str = "none", seed: int = 42, thresholds: Mapping[str, float] | None = None,
                  metrics_average: str = "macro") -> tuple[DataFrame, dict[str, Fitted | dict]]:
    """Refit each view's best configuration on train plus val and score test.

    Scores on the refitted rows are reported as split ``refit_train_val``, not as validation.
    """
    ready, ours = _held(normalize(features, normalization))
    classes = _classes(ready, label)
    rows, models = [], {}
    for view, (kind, params) in best.items():
        mine = ready.where(F.col("view") == view)
        fit_rows = mine.where(F.col("split").isin("train", "val", "validation"))
        named = F.when(F.col("split") == "test", "test").otherwise("refit_train_val")
        scored = mine.where("split <> 'zero_shot'").withColumn("split", named)
        models[view], part = _fit_and_score(fit_rows, scored, kind, view, params, label, classes, seed, _threshold(thresholds, kind, view), metrics_average)
        rows += part
    if ours:
        ready.unpersist()
    return features.sparkSession.createDataFrame(rows, RESULT), models


def _linear_trials(ready: DataFrame, settings: Sequence[Mapping], view: str, label: str, classes: Sequence) -> list[tuple]:
    """(trial, view, metric, value) of all logistic trials on a view: fitted together and scored in one pass over the held-out rows."""
    mine = ready.where(F.col("view") == view)
    names = F.array(*[F.lit(c) for c in classes])
    rows = mine.where("split = 'train'").select("vec", F.array((F.array_position(names, F.col(label)) - 1).cast("int")).alias("target"))
    models = fit_linear(rows, [_linear_task(flat_params("LR", p)) for p in settings], len(classes))
    scored = mine.where(F.col("split").isin("val", "validation")).select("split", label, F.posexplode(shares(models, F.col("vec"))).alias("trial", "probs"))
    kind = "binary" if len(classes) == 2 else "multiclass"
    scored = scored.withColumn("predicted_label", F.element_at(names, decision(F.col("probs"), kind, F.lit(0.5)) + 1))
    found = view_metrics(scored, classes, label, by=("trial", "split"))
    return [(r["trial"], view, r["metric"], r["value"]) for r in found.orderBy("trial").collect()]


def sweep_run(features: DataFrame, model_type: str, space: Mapping[str, Mapping], n_trials: int, metric: str = "f1",
              goal: str = "maximize", label: str = "label", normalization: str = "none", seed: int = 42,
              parallelism: int = 4) -> tuple[DataFrame, dict]:
    """(trial, model_type, view, metric, value, config, dropped) rows and the best finite trial; the first wins a tie.

    Trials of a logistic model on a view are one fit: every pass over its rows serves all of them. Other trials are independent Spark
    jobs of a small thread pool. ``dropped`` names the trial's settings that Spark's fits have no counterpart for.
    """
    spark = features.sparkSession
    settings = trial_params(sweep_trials(spark, space, n_trials, seed))
    lost = [",".join(dropped_settings(model_type, p)) for p in settings]
    ready, ours = _held(normalize(features, normalization))
    views, classes = class_list(ready, "view"), _classes(ready, label)
    together = kind_of(model_type) == "LR" and not isinstance(ready.schema[label].dataType, ArrayType)

    def one(job: tuple[int, str]) -> list[tuple]:
        trial, view = job
        if together:
            return _linear_trials(ready, settings, view, label, classes)
        table, _ = train_matrix(ready, [model_type], {model_type: settings[trial]}, label, "none", False, [view], 1, seed)
        return [(trial, r["view"], r["metric"], r["value"]) for r in table.collect()]

    with ThreadPool(parallelism) as pool:
        done = pool.map(one, [(trial, view) for trial in ([0] if together else range(len(settings))) for view in views], 1)
    found = sorted((row for part in done for row in part), key=lambda r: r[0])
    best = None
    for trial, view, name, value in found:
        if name == metric and value is not None:
            gain = value if goal == "maximize" else -value
            if best is None or gain > best["gain"]:
                best = {"gain": gain, "trial": trial, "view": view, "value": value, "params": settings[trial]}
    if ours:
        ready.unpersist()
    rows = [(trial, model_type, view, name, value, str(sorted(settings[trial].items())), lost[trial]) for trial, view, name, value in found]
    out = spark.createDataFrame(rows, "trial int, model_type string, view string, metric string, value double, config string, dropped string")
    return out, best or {}
