"""Metric queries over the synthetic predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import metrics as me
from pairloom.functions.scalars import argmax_index, one_hot
from pairloom.plans import query
from pairloom.plans.fixtures import (
    BINARY_ROUNDED, CLASS_PROBS, ENSEMBLE_PREDS, PREDS, binary_sql, class_probs, ensemble_preds, longs, preds, r6,
)
from pairloom.plans.labels import EVENT_CLASSES, USER_LABELS, user_labels
from pairloom.operators.labels import multilabel_binarize

KEYS = ["seed", "model_id"]


def ruled(spark: SparkSession, sf: str) -> DataFrame:
    """Multiclass decisions."""
    return class_probs(spark, sf).withColumn("pred", argmax_index(F.col("probs")))


RULED = f"""{CLASS_PROBS}, ruled AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred FROM class_probs)"""
# per-label counts over the labels of either side
LABEL_COUNTS = f"""{RULED},
  seen AS (SELECT model_id, y AS label FROM ruled UNION SELECT model_id, pred FROM ruled),
  lc AS (SELECT s.model_id, s.label, count(*) FILTER (WHERE y = label AND pred = label) AS tp, count(*) FILTER (WHERE y <> label AND pred = label) AS fp,
    count(*) FILTER (WHERE y = label AND pred <> label) AS fn FROM seen s JOIN ruled r ON r.model_id = s.model_id GROUP BY s.model_id, s.label),
  ls AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS r,
    CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f FROM lc)"""


@query("confusion_matrix", f"WITH {RULED} SELECT model_id, y::BIGINT AS true_label, pred::BIGINT AS predicted_label, count(*) AS n FROM ruled GROUP BY ALL")
def _confusion(spark: SparkSession, sf: str) -> DataFrame:
    return longs(me.confusion_matrix(ruled(spark, sf), ["model_id"], "y", "pred"), "true_label", "predicted_label")


@query("binary_counts", f"WITH {PREDS} SELECT seed, model_id, TP, TN, FP, FN FROM ({binary_sql('seed, model_id', 'preds')})")
def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return me.binary_counts(preds(spark, sf), KEYS)


@query("binary_metrics", f"WITH {PREDS} SELECT seed, model_id, {BINARY_ROUNDED} FROM ({binary_sql('seed, model_id', 'preds')})")
def _binary(spark: SparkSession, sf: str) -> DataFrame:
    return r6(me.binary_metrics(preds(spark, sf), KEYS))


_TEXT_LABELS = "(SELECT * REPLACE (CASE WHEN accession::BIGINT % 13 = 0 THEN NULL ELSE true_label END AS true_label) FROM preds)"


@query("binary_metrics_by_model", f"WITH {PREDS} SELECT seed, model_type, embedding_name, {BINARY_ROUNDED} FROM ({binary_sql('seed, model_type, embedding_name', _TEXT_LABELS)})")
def _by_model(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.col("accession").cast("long") % 13 == 0
    text = F.when(odd, "unclear").when(F.col("true_label") == 1, "Yes").otherwise("mf")
    return r6(me.binary_metrics_by_model(preds(spark, sf).withColumn("true_label", text)))


@query("binary_metrics_by_strategy", f"WITH {PREDS}, {ENSEMBLE_PREDS} SELECT seed, strategy, {BINARY_ROUNDED} FROM ({binary_sql('seed, strategy', 'ensemble_preds')})")
def _by_strategy(spark: SparkSession, sf: str) -> DataFrame:
    rows = ensemble_preds(spark, sf).withColumn("file", F.concat(F.lit("/x/seed_1/"), "strategy", F.lit(".csv")))
    blank = F.when(F.col("strategy") == "majority_global", "").otherwise(F.col("strategy"))
    return r6(me.binary_metrics_by_strategy(rows.withColumn("strategy", blank), file_col="file"))


@query("macro_metrics", f"""WITH {LABEL_COUNTS} SELECT model_id, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(p), 6) AS "precision",
  round(avg(r), 6) AS recall, round(avg(f), 6) AS f1 FROM ls GROUP BY model_id""")
def _macro(spark: SparkSession, sf: str) -> DataFrame:
    return r6(me.macro_metrics(ruled(spark, sf), ["model_id"], "y", "pred"))


@query("weighted_metrics", f"""WITH {LABEL_COUNTS} SELECT model_id, round(sum(tp) / sum(support), 6) AS accuracy, round(sum(p * support) / sum(support), 6) AS "precision",
  round(sum(r * support) / sum(support), 6) AS recall, round(sum(f * support) / sum(support), 6) AS f1 FROM ls GROUP BY model_id""")
def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    return r6(me.weighted_metrics(ruled(spark, sf), ["model_id"], "y", "pred"))


@query("micro_f1", f"WITH {LABEL_COUNTS} SELECT model_id, round(2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM ls GROUP BY model_id")
def _micro(spark: SparkSession, sf: str) -> DataFrame:
    return r6(me.micro_f1(ruled(spark, sf), ["model_id"], "y", "pred"))


@query("per_class_f1", f"WITH {LABEL_COUNTS} SELECT model_id, label::BIGINT AS label, round(f, 6) AS f1, support FROM ls WHERE support > 0")
def _per_class(spark: SparkSession, sf: str) -> DataFrame:
    return longs(r6(me.per_class_f1(ruled(spark, sf), ["model_id"], "y", "pred")), "label")


@query("multilabel_metrics", f"""WITH {USER_LABELS}, cells AS (SELECT m, c, list_contains(labels, c) AS t,
    list_contains(labels, c) <> (substr(md5(m || accession || c), 1, 1) < '4') AS p FROM user_labels, (VALUES ('m1'), ('m2')) x(m), (VALUES ('click'), ('purchase'), ('signup'), ('view')) y(c)),
  k AS (SELECT m, c, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn FROM cells GROUP BY m, c)
  SELECT m, NULL::DOUBLE AS accuracy, round(avg(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END), 6) AS "precision",
    round(avg(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END), 6) AS recall, round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END), 6) AS f1,
    round(2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM k GROUP BY m""")
def _multilabel(spark: SparkSession, sf: str) -> DataFrame:
    rows = multilabel_binarize(user_labels(spark, sf), "labels", EVENT_CLASSES, "y_true").withColumn(
        "m", F.explode(F.array(F.lit("m1"), F.lit("m2")))
    )
    flips = F.array(*[
        (F.substring(F.md5(F.concat("m", "accession", F.lit(c))), 1, 1) < "4").cast("int") for c in EVENT_CLASSES
    ])
    rows = rows.withColumn("y_pred", F.zip_with("y_true", flips, lambda t, f: F.when(f == 1, 1 - t).otherwise(t)))
    return r6(me.multilabel_metrics(rows, ["m"]))


# pairwise definition of the area, step definition of average precision
AUC = f"""{PREDS},
  steps AS (SELECT seed, model_id, score, count(*) FILTER (WHERE true_label = 1) AS pos, count(*) FILTER (WHERE true_label = 0) AS neg FROM preds GROUP BY ALL),
  sums AS (SELECT *, sum(neg) OVER w - neg AS neg_below, sum(pos) OVER d AS pos_above, sum(pos + neg) OVER d AS all_above,
      sum(pos) OVER g AS np, sum(neg) OVER g AS nn FROM steps
    WINDOW w AS (PARTITION BY seed, model_id ORDER BY score), d AS (PARTITION BY seed, model_id ORDER BY score DESC), g AS (PARTITION BY seed, model_id)),
  areas AS (SELECT seed, model_id, sum(pos * (neg_below + neg / 2.0::DOUBLE)) / (max(np) * max(nn))::DOUBLE AS roc_auc,
    sum(pos * (pos_above::DOUBLE / all_above)) / max(np)::DOUBLE AS pr_auc FROM sums GROUP BY seed, model_id)"""


@query("roc_auc", f"WITH {AUC} SELECT seed, model_id, round(roc_auc, 6) AS roc_auc FROM areas")
def _roc(spark: SparkSession, sf: str) -> DataFrame:
    return r6(me.roc_auc(preds(spark, sf), KEYS))


@query("pr_auc", f"WITH {AUC} SELECT seed, model_id, round(pr_auc, 6) AS pr_auc FROM areas")
def _pr(spark: SparkSession, sf: str) -> DataFrame:
    return r6(me.pr_auc(preds(spark, sf), KEYS))


MCC = f"""{LABEL_COUNTS}, facts AS (SELECT model_id, sum(tp)::DOUBLE AS c, sum(support)::DOUBLE AS s, sum(support::DOUBLE * (tp + fp)) AS tp_, sum(support::DOUBLE * support) AS tt,
    sum((tp + fp)::DOUBLE * (tp + fp)) AS pp FROM ls GROUP BY model_id),
  mccs AS (SELECT model_id, (c * s - tp_) / (sqrt(s * s - pp) * sqrt(s * s - tt)) AS mcc FROM facts)"""


@query("mcc", f"WITH {MCC} SELECT model_id, round(mcc, 6) AS mcc FROM mccs")
def _mcc(spark: SparkSession, sf: str) -> DataFrame:
    return r6(me.mcc(ruled(spark, sf), ["model_id"], "y", "pred"))


@query("mcc_binary", f"""WITH {PREDS} SELECT seed, model_id, round((TP::DOUBLE * TN - FP::DOUBLE * FN) / sqrt((TP + FP)::DOUBLE * (TP + FN) * (TN + FP) * (TN + FN)), 6) AS mcc
  FROM ({binary_sql('seed, model_id', 'preds')})""")
def _mcc_binary(spark: SparkSession, sf: str) -> DataFrame:
    return r6(me.mcc(preds(spark, sf), KEYS))


@query("balanced_accuracy", f"WITH {LABEL_COUNTS} SELECT model_id, round(avg(r), 6) AS balanced_accuracy FROM ls WHERE support > 0 GROUP BY model_id")
def _balanced(spark: SparkSession, sf: str) -> DataFrame:
    return r6(me.balanced_accuracy(ruled(spark, sf), ["model_id"], "y", "pred"))


@query("metrics_all", f"""WITH {AUC}, b AS ({binary_sql('seed, model_id', 'preds')}),
  h AS (SELECT *, TP + FN AS s1, TN + FP AS s0, CASE WHEN TP + FP = 0 THEN 0 ELSE TP::DOUBLE / (TP + FP) END AS p1, CASE WHEN TN + FN = 0 THEN 0 ELSE TN::DOUBLE / (TN + FN) END AS p0,
    TP::DOUBLE / (TP + FN) AS r1, TN::DOUBLE / (TN + FP) AS r0, 2.0::DOUBLE * TP / (2 * TP + FP + FN) AS f1_, 2.0::DOUBLE * TN / (2 * TN + FP + FN) AS f0_ FROM b)
  SELECT h.seed, h.model_id, round(accuracy, 6) AS accuracy, round((p1 * s1 + p0 * s0) / (s1 + s0), 6) AS "precision", round((r1 * s1 + r0 * s0) / (s1 + s0), 6) AS recall,
    round((f1_ * s1 + f0_ * s0) / (s1 + s0), 6) AS f1, round((TP::DOUBLE * TN - FP::DOUBLE * FN) / sqrt((TP + FP)::DOUBLE * (TP + FN) * (TN + FP) * (TN + FN)), 6) AS mcc,
    round((r1 + r0) / 2, 6) AS balanced_accuracy, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM h JOIN areas a ON a.seed = h.seed AND a.model_id = h.model_id""")
def _all(spark: SparkSession, sf: str) -> DataFrame:
    return r6(me.metrics_all(preds(spark, sf), KEYS, score="score"))


_P = "greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, score))"


@query("loss_bce", f"WITH {PREDS} SELECT seed, model_id, round(avg(-(true_label * ln({_P}) + (1 - true_label) * ln(1 - {_P}))), 6) AS bce FROM preds GROUP BY seed, model_id")
def _bce(spark: SparkSession, sf: str) -> DataFrame:
    return r6(me.loss_bce(preds(spark, sf), KEYS))


@query("loss_cce", f"WITH {CLASS_PROBS} SELECT model_id, round(avg(-ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 6) AS cce FROM class_probs GROUP BY model_id")
def _cce(spark: SparkSession, sf: str) -> DataFrame:
    return r6(me.loss_cce(class_probs(spark, sf).withColumn("y_true", one_hot(F.col("y"), 3)), ["model_id"]))


@query("loss_mse", f"WITH {PREDS} SELECT seed, model_id, round(avg((true_label - score) * (true_label - score)), 6) AS mse FROM preds GROUP BY seed, model_id")
def _mse(spark: SparkSession, sf: str) -> DataFrame:
    return r6(me.loss_mse(preds(spark, sf), KEYS))


@query("loss_mae", f"WITH {PREDS} SELECT seed, model_id, round(avg(abs(true_label - score)), 6) AS mae FROM preds GROUP BY seed, model_id")
def _mae(spark: SparkSession, sf: str) -> DataFrame:
    return r6(me.loss_mae(preds(spark, sf), KEYS))


@query("metrics_clean", f"""WITH {PREDS}, b AS ({binary_sql('seed, model_id', 'preds')})
  SELECT seed, model_id, 'val_accuracy' AS metric, round(accuracy, 6) AS "value" FROM b UNION ALL SELECT seed, model_id, 'val_f1', round(f1, 6) FROM b WHERE seed <> 43""")
def _clean(spark: SparkSession, sf: str) -> DataFrame:
    wide = me.binary_metrics(preds(spark, sf), KEYS)
    holed = wide.withColumn("f1", F.when(F.col("seed") == 43, float("nan")).otherwise(F.col("f1")))
    return r6(me.metrics_clean(holed, KEYS, ["accuracy", "f1"]))
