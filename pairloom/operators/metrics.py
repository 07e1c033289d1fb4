"""Classification metrics over tall (keys, truth, prediction[, score]) tables.

Everything except the ranking metrics is derived from the confusion counts, which are combined
map-side: however large the group, classes squared rows leave each task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.ranks import prefix_sums
from pairloom.functions.scalars import coerce_binary_label, nan_to_null

CLIP = 1e-15


def _ratio(num: Column, den: Column) -> Column:
    """Quotient with zero for an empty denominator."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def _f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def confusion_matrix(df: DataFrame, keys: Sequence[str], y_true: str = "true_label",
                     y_pred: str = "predicted_label", labels: Sequence | None = None) -> DataFrame:
    """(keys, true_label, predicted_label, n); ``labels`` restricts both axes."""
    scoped = df.where(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull())
    if labels is not None:
        scoped = scoped.where(F.col(y_true).isin(list(labels)) & F.col(y_pred).isin(list(labels)))
    return scoped.groupBy(*keys, F.col(y_true).alias("true_label"), F.col(y_pred).alias("predicted_label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def binary_counts(df: DataFrame, keys: Sequence[str], y_true: str = "true_label", y_pred: str = "predicted_label",
                  pos_label=None) -> DataFrame:
    """TP, TN, FP, FN against the positive class, by default the largest true label of the group."""
    cells = confusion_matrix(df, keys, y_true, y_pred)
    positive = F.lit(pos_label) if pos_label is not None else F.max("true_label").over(Window.partitionBy(*keys))
    marked = cells.withColumn("_t", F.col("true_label") == positive).withColumn("_p", F.col("predicted_label") == positive) \
        if pos_label is not None else cells.withColumn("_pos", positive).withColumn(
            "_t", F.col("true_label") == F.col("_pos")).withColumn("_p", F.col("predicted_label") == F.col("_pos"))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    t, p = F.col("_t"), F.col("_p")
    return marked.groupBy(*keys).agg(
        total(t & p).alias("TP"), total(~t & ~p).alias("TN"), total(~t & p).alias("FP"), total(t & ~p).alias("FN")
    )


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 from TP, TN, FP, FN; zero division gives 0."""
    tp, tn, fp, fn = (F.col(c) for c in ("TP", "TN", "FP", "FN"))
    return (
        counts.withColumn("accuracy", _ratio(tp + tn, tp + tn + fp + fn))
        .withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
        .withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))
    )


def binary_metrics(df: DataFrame, keys: Sequence[str], y_true: str = "true_label", y_pred: str = "predicted_label",
                   pos_label=None) -> DataFrame:
    return metrics_from_counts(binary_counts(df, keys, y_true, y_pred, pos_label))


def _coerced(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    return df.withColumn("_yt", coerce_binary_label(F.col(y_true))).withColumn("_yp", coerce_binary_label(F.col(y_pred)))


def binary_metrics_by_model(predictions: DataFrame, keys: Sequence[str] = ("seed", "model_type", "embedding_name"),
                            y_true: str = "true_label", y_pred: str = "predicted_label") -> DataFrame:
    """Binary metrics with labels 0/1; pairs that are not binary labels are left out, and so are empty groups."""
    named = [k for k in ("model_type", "embedding_name") if k in keys]
    scoped = predictions
    for name in named:
        scoped = scoped.where(F.trim(F.col(name)) != "")
    rows = _coerced(scoped, y_true, y_pred)
    return binary_metrics(rows, keys, "_yt", "_yp", pos_label=1)


def binary_metrics_by_strategy(predictions: DataFrame, keys: Sequence[str] = ("seed", "strategy"),
                               file_col: str | None = None) -> DataFrame:
    """Binary metrics per ensemble strategy; a blank strategy falls back to the stem of its file."""
    rows = predictions
    if file_col is not None:
        stem = F.regexp_extract(F.col(file_col), r"([^/]+?)(\.[^./]*)?$", 1)
        blank = F.coalesce(F.trim(F.col("strategy")), F.lit("")) == ""
        rows = rows.withColumn("strategy", F.when(blank, stem).otherwise(F.trim("strategy")))
    return binary_metrics(_coerced(rows, "true_label", "predicted_label"), keys, "_yt", "_yp", pos_label=1)


def label_counts(df: DataFrame, keys: Sequence[str], y_true: str = "true_label", y_pred: str = "predicted_label") -> DataFrame:
    """(keys, label, tp, fp, fn, support) over the labels seen on either side."""
    cells = confusion_matrix(df, keys, y_true, y_pred)
    zero = F.lit(0).cast("long")
    n = F.col("n")
    same = F.col("true_label") == F.col("predicted_label")

    def part(label: str, tp: Column, fp: Column, fn: Column, support: Column) -> Column:
        return F.struct(F.col(label).alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), support.alias("support"))

    sides = F.explode(F.array(
        part("true_label", F.when(same, n).otherwise(zero), zero, F.when(same, zero).otherwise(n), n),
        part("predicted_label", zero, F.when(same, zero).otherwise(n), zero, zero),
    ))
    return cells.select(*keys, sides.alias("_s")).select(*keys, "_s.*").groupBy(*keys, "label").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")]
    )


def _with_scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        counts.withColumn("_p", _ratio(tp, tp + fp)).withColumn("_r", _ratio(tp, tp + fn))
        .withColumn("_f", _ratio(2 * tp, 2 * tp + fp + fn))
    )


def _accuracy() -> Column:
    return F.sum("tp").cast("double") / F.nullif(F.sum("support"), F.lit(0))


def macro_metrics(df: DataFrame, keys: Sequence[str], y_true: str = "true_label", y_pred: str = "predicted_label") -> DataFrame:
    """Unweighted means over the labels in truth or prediction."""
    return _with_scores(label_counts(df, keys, y_true, y_pred)).groupBy(*keys).agg(
        _accuracy().alias("accuracy"), F.avg("_p").alias("precision"), F.avg("_r").alias("recall"), F.avg("_f").alias("f1")
    )


def weighted_metrics(df: DataFrame, keys: Sequence[str], y_true: str = "true_label", y_pred: str = "predicted_label") -> DataFrame:
    """Means weighted by true support."""
    s = F.col("support")

    def mean(name: str) -> Column:
        return F.sum(F.col(name) * s) / F.nullif(F.sum(s), F.lit(0))

    return _with_scores(label_counts(df, keys, y_true, y_pred)).groupBy(*keys).agg(
        _accuracy().alias("accuracy"), mean("_p").alias("precision"), mean("_r").alias("recall"), mean("_f").alias("f1")
    )


def micro_f1(df: DataFrame, keys: Sequence[str], y_true: str = "true_label", y_pred: str = "predicted_label") -> DataFrame:
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return label_counts(df, keys, y_true, y_pred).groupBy(*keys).agg(_ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"))


def per_class_f1(df: DataFrame, keys: Sequence[str], y_true: str = "true_label", y_pred: str = "predicted_label") -> DataFrame:
    """F1 and support of every true label."""
    return _with_scores(label_counts(df, keys, y_true, y_pred)).where("support > 0").select(
        *keys, "label", F.col("_f").alias("f1"), "support"
    )


def multilabel_metrics(df: DataFrame, keys: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Macro and micro scores over the columns of 0/1 arrays; accuracy is not defined here."""
    # three arrays of per-class sums would need element-wise addition, so count (class, truth, prediction) cells
    cells = df.select(*keys, F.posexplode(F.arrays_zip(F.col(y_true).alias("t"), F.col(y_pred).alias("p"))).alias("label", "_c"))
    grouped = cells.groupBy(*keys, "label").agg(
        F.sum((F.col("_c.t") * F.col("_c.p")).cast("long")).alias("tp"),
        F.sum(((1 - F.col("_c.t")) * F.col("_c.p")).cast("long")).alias("fp"),
        F.sum((F.col("_c.t") * (1 - F.col("_c.p"))).cast("long")).alias("fn"),
    )
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return _with_scores(grouped).groupBy(*keys).agg(
        F.lit(None).cast("double").alias("accuracy"), F.avg("_p").alias("precision"), F.avg("_r").alias("recall"),
        F.avg("_f").alias("f1"), _ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"),
    )


def ranking_metrics(df: DataFrame, keys: Sequence[str], y_true: str = "true_label", score: str = "score",
                    pos_label=1) -> DataFrame:
    """ROC area (ties count half) and average precision; NULL unless both classes occur.

    Equal scores are merged before anything is ordered, then one distributed prefix sum serves both.
    """
    hit = (F.col(y_true) == F.lit(pos_label)).cast("long")
    rows = df.where(F.col(score).isNotNull() & F.col(y_true).isNotNull())
    steps = rows.groupBy(*keys, F.col(score).alias("_score")).agg(
        F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg")
    )
    sums = prefix_sums(steps, [F.col("_score")], ["pos", "neg"], keys)
    pos, neg = F.col("pos"), F.col("neg")
    above = F.col("pos_all") - F.col("pos_before")
    kept = above + F.col("neg_all") - F.col("neg_before")
    area = F.sum(pos * (F.col("neg_before") + neg / 2)) / (F.max("pos_all") * F.max("neg_all"))
    precision = F.sum(pos * (above / kept)) / F.max("pos_all")
    both = (F.max("pos_all") > 0) & (F.max("neg_all") > 0)
    return sums.groupBy(*keys).agg(F.when(both, area).alias("roc_auc"), F.when(both, precision).alias("pr_auc"))


def roc_auc(df: DataFrame, keys: Sequence[str], y_true: str = "true_label", score: str = "score", pos_label=1) -> DataFrame:
    return ranking_metrics(df, keys, y_true, score, pos_label).select(*keys, "roc_auc")


def pr_auc(df: DataFrame, keys: Sequence[str], y_true: str = "true_label", score: str = "score", pos_label=1) -> DataFrame:
    return ranking_metrics(df, keys, y_true, score, pos_label).select(*keys, "pr_auc")


def mcc(df: DataFrame, keys: Sequence[str], y_true: str = "true_label", y_pred: str = "predicted_label") -> DataFrame:
    """Matthews correlation for any number of classes, 0 where undefined."""
    t, p = F.col("support").cast("double"), (F.col("tp") + F.col("fp")).cast("double")
    facts = label_counts(df, keys, y_true, y_pred).groupBy(*keys).agg(
        F.sum("tp").cast("double").alias("_c"), F.sum(t).alias("_s"), F.sum(t * p).alias("_tp"),
        F.sum(t * t).alias("_tt"), F.sum(p * p).alias("_pp"),
    )
    spread = F.sqrt(F.col("_s") * F.col("_s") - F.col("_pp")) * F.sqrt(F.col("_s") * F.col("_s") - F.col("_tt"))
    return facts.select(
        *keys, F.when(spread == 0, 0.0).otherwise((F.col("_c") * F.col("_s") - F.col("_tp")) / spread).alias("mcc")
    )


def balanced_accuracy(df: DataFrame, keys: Sequence[str], y_true: str = "true_label", y_pred: str = "predicted_label") -> DataFrame:
    """Mean recall over the true classes."""
    return _with_scores(label_counts(df, keys, y_true, y_pred)).where("support > 0").groupBy(*keys).agg(
        F.avg("_r").alias("balanced_accuracy")
    )


def metrics_all(df: DataFrame, keys: Sequence[str], y_true: str = "true_label", y_pred: str = "predicted_label",
                score: str | None = None, pos_label=1) -> DataFrame:
    """The eight factory metrics (weighted averaging) in one table; areas only where scores exist."""
    out = (
        weighted_metrics(df, keys, y_true, y_pred)
        .join(mcc(df, keys, y_true, y_pred), list(keys))
        .join(balanced_accuracy(df, keys, y_true, y_pred), list(keys))
    )
    if score is not None:
        out = out.join(ranking_metrics(df, keys, y_true, score, pos_label), list(keys), "left")
    return out


def _clipped(p: Column) -> Column:
    return F.greatest(F.lit(CLIP), F.least(F.lit(1.0 - CLIP), p))


def loss_bce(df: DataFrame, keys: Sequence[str], y_true: str = "true_label", y_pred: str = "score") -> DataFrame:
    y, p = F.col(y_true).cast("double"), _clipped(F.col(y_pred))
    return df.groupBy(*keys).agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("bce"))


def loss_cce(df: DataFrame, keys: Sequence[str], y_true: str = "y_true", y_pred: str = "probs") -> DataFrame:
    """``y_true`` is one-hot."""
    terms = F.zip_with(y_true, y_pred, lambda y, p: y * F.log(_clipped(p)))
    return df.groupBy(*keys).agg(F.avg(-F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)).alias("cce"))


def loss_mse(df: DataFrame, keys: Sequence[str], y_true: str = "true_label", y_pred: str = "score") -> DataFrame:
    d = F.col(y_true).cast("double") - F.col(y_pred)
    return df.groupBy(*keys).agg(F.avg(d * d).alias("mse"))


def loss_mae(df: DataFrame, keys: Sequence[str], y_true: str = "true_label", y_pred: str = "score") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.abs(F.col(y_true).cast("double") - F.col(y_pred))).alias("mae"))


def metrics_clean(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str], prefix: str = "val_") -> DataFrame:
    """Tall (keys, metric, value) of the finite metrics, names prefixed."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(prefix + m).alias("metric"), nan_to_null(F.col(m)).alias("value")) for m in metrics
    ]))
    return wide.select(*keys, pairs.alias("_m")).select(*keys, "_m.*").where("value is not null")
