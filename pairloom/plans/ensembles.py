"""Ensemble queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import ensembles as en
from pairloom.operators import predictions as pr
from pairloom.plans import query
from pairloom.plans.fixtures import CLASS_PROBS, CLASSES, MC_MODELS, PREDS, class_probs, longs, preds, r6, table
from pairloom.plans.metrics import LABEL_COUNTS, ruled


def _three(df: DataFrame) -> DataFrame:
    return df.withColumns({f"p{i}": F.col("probs")[i] for i in range(3)}).drop("probs")


def binary_probs(spark: SparkSession, sf: str) -> DataFrame:
    """One-column binary probabilities of every seed."""
    return preds(spark, sf).withColumn("probs", F.array("score")).withColumn("y", F.col("true_label").cast("int"))


@query("probs_canonical", f"WITH {PREDS} SELECT seed, model_id, accession, round(1 - score, 6) AS p0, round(score, 6) AS p1 FROM preds")
def _canonical(spark: SparkSession, sf: str) -> DataFrame:
    out = en.probs_canonical(binary_probs(spark, sf), "binary")
    return r6(out.select("seed", "model_id", "accession", F.col("probs")[0].alias("p0"), F.col("probs")[1].alias("p1")))


_PAIR, _CLS = {"LR::V1": 0.7}, {"LR": 0.6, "RF": 0.55}
_THRESHOLD = """CASE WHEN model_id = 'LR::V1' THEN 0.7::DOUBLE WHEN model_type = 'LR' THEN 0.6::DOUBLE WHEN model_type = 'RF' THEN 0.55::DOUBLE ELSE 0.5::DOUBLE END"""


@query("threshold_resolve", f"WITH {PREDS} SELECT DISTINCT model_type, embedding_name, {_THRESHOLD} AS threshold FROM preds")
def _threshold(spark: SparkSession, sf: str) -> DataFrame:
    models = preds(spark, sf).select("model_type", "embedding_name").distinct()
    return en.threshold_resolve(models, 0.5, _CLS, _PAIR)


@query("decide", f"WITH {PREDS} SELECT seed, model_id, accession, (score >= {_THRESHOLD})::BIGINT AS pred FROM preds")
def _decide(spark: SparkSession, sf: str) -> DataFrame:
    rows = en.threshold_resolve(en.probs_canonical(binary_probs(spark, sf), "binary"), 0.5, _CLS, _PAIR)
    return longs(en.decide(rows, "binary", "threshold").select("seed", "model_id", "accession", "pred"), "pred")


@query("decide_multiclass", f"WITH {LABEL_COUNTS} SELECT model_id, accession, pred::BIGINT AS pred FROM ruled")
def _decide_multi(spark: SparkSession, sf: str) -> DataFrame:
    return longs(en.decide(class_probs(spark, sf), "multiclass").select("model_id", "accession", "pred"), "pred")


@query("decide_multilabel", f"WITH {CLASS_PROBS} SELECT model_id, accession, (p0 >= 0.4)::INTEGER || '' || (p1 >= 0.4)::INTEGER || (p2 >= 0.4)::INTEGER AS pred FROM class_probs")
def _decide_many(spark: SparkSession, sf: str) -> DataFrame:
    out = en.decide(class_probs(spark, sf), "multilabel", 0.4)
    return out.select("model_id", "accession", F.array_join(F.col("pred").cast("array<string>"), "").alias("pred"))


def member_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate members: one per brand and size class of the part table, scored by its mean price."""
    return table(spark, sf, "part").groupBy(
        F.col("p_brand").alias("model_type"), F.concat(F.lit("E"), (F.col("p_size") % 5).cast("string")).alias("embedding_name")
    ).agg(F.round(F.avg("p_retailprice") / 10, 0).alias("validation_f1"), F.min("p_partkey").alias("row_order")).withColumn(
        "artifact_path", F.concat("model_type", F.lit("/"), "embedding_name")
    )


MEMBERS = """members AS (SELECT p_brand AS model_type, 'E' || (p_size % 5) AS embedding_name, round(avg(p_retailprice) / 10, 0) AS validation_f1,
    min(p_partkey) AS row_order FROM part GROUP BY 1, 2)"""


@query("ensemble_select", f"""WITH {MEMBERS}, a AS (SELECT *, row_number() OVER (PARTITION BY embedding_name ORDER BY validation_f1 DESC, row_order) AS i FROM members WHERE embedding_name IN ('E0', 'E1', 'E2')),
    b AS (SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY validation_f1 DESC, row_order) AS j FROM a WHERE i <= 4)
  SELECT model_type, embedding_name, validation_f1 FROM b WHERE j <= 1""")
def _select(spark: SparkSession, sf: str) -> DataFrame:
    rows = en.ensemble_select(member_rows(spark, sf), ["E0", "E1", "E2"], None, 4, 1)
    return rows.select("model_type", "embedding_name", "validation_f1")


@query("weights_uniform", f"WITH {CLASS_PROBS} SELECT model_id, round(1.0::DOUBLE / count(*) OVER (), 6) AS weight FROM (SELECT DISTINCT model_id FROM class_probs)")
def _uniform(spark: SparkSession, sf: str) -> DataFrame:
    return r6(en.weights_uniform(class_probs(spark, sf)))


@query("weights_validation", f"""WITH {LABEL_COUNTS}, s AS (SELECT model_id, avg(f) AS score FROM ls GROUP BY model_id)
  SELECT model_id, round(score / sum(score) OVER (), 6) AS weight FROM s""")
def _validation(spark: SparkSession, sf: str) -> DataFrame:
    return r6(en.weights_validation(class_probs(spark, sf), "multiclass", 3))


def search_sql(trials: int, l2: float) -> str:
    """The weight search written out: trials x samples blends, decisions, macro f1, best trial."""
    return f"""{CLASS_PROBS},
  draws AS (SELECT trial, model_id, -ln((('0x' || substr(md5('42:' || trial || ':' || model_id), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE) AS e
    FROM range({trials}) t(trial), (SELECT DISTINCT model_id FROM class_probs)),
  weights AS (SELECT trial, model_id, e / sum(e) OVER (PARTITION BY trial) AS w FROM draws),
  blend AS (SELECT trial, accession, any_value(y) AS y, sum(w * p0) AS b0, sum(w * p1) AS b1, sum(w * p2) AS b2 FROM class_probs JOIN weights USING (model_id) GROUP BY trial, accession),
  hit AS (SELECT trial, y, CASE WHEN b0 >= b1 AND b0 >= b2 THEN 0 WHEN b1 >= b2 THEN 1 ELSE 2 END AS pred FROM blend),
  per AS (SELECT trial, label, count(*) FILTER (WHERE y = label AND pred = label) AS tp, count(*) FILTER (WHERE y <> label AND pred = label) AS fp,
    count(*) FILTER (WHERE y = label AND pred <> label) AS fn FROM hit, range(3) l(label) GROUP BY trial, label),
  f AS (SELECT trial, avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)) AS f1 FROM per WHERE tp + fp + fn > 0 GROUP BY trial),
  best AS (SELECT trial, round(f1 - {l2}::DOUBLE * (SELECT sum(w * w) FROM weights x WHERE x.trial = f.trial), 12) AS score FROM f ORDER BY score DESC, trial LIMIT 1)"""


@query("weights_random_search", f"""WITH {search_sql(256, 0.01)} SELECT b.trial, round(score, 6) AS score, model_id, round(w, 6) AS weight FROM best b JOIN weights USING (trial)""")
def _search(spark: SparkSession, sf: str) -> DataFrame:
    out = en.weights_random_search(class_probs(spark, sf), MC_MODELS, "multiclass", 3, n_trials=256, l2=0.01)
    return r6(longs(out, "trial"))


_FIXED_WEIGHTS = [("A::V1", 0.5), ("A::V2", 0.2), ("B::V1", 0.3)]
_WEIGHT_VALUES = ", ".join(f"('{m}', {w}::DOUBLE)" for m, w in _FIXED_WEIGHTS)


def fixed_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_FIXED_WEIGHTS, "model_id string, weight double")


VOTE = f"""{CLASS_PROBS}, vote AS (SELECT accession, sum(w * p0) AS p0, sum(w * p1) AS p1, sum(w * p2) AS p2
    FROM class_probs JOIN (VALUES {_WEIGHT_VALUES}) x(model_id, w) USING (model_id) GROUP BY accession),
  voted AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred FROM vote)"""


@query("soft_vote", f"WITH {VOTE} SELECT accession, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, pred::BIGINT AS pred FROM voted")
def _soft(spark: SparkSession, sf: str) -> DataFrame:
    return r6(longs(_three(en.soft_vote(class_probs(spark, sf), fixed_weights(spark), "multiclass", 3)), "pred"))


def majority_sql(source: str, keys: str) -> str:
    return f"""(SELECT * FROM (SELECT {keys}, pred, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, pred) AS i FROM {source} GROUP BY {keys}, pred) WHERE i = 1)"""


@query("majority_global", f"WITH {LABEL_COUNTS} SELECT accession, pred::BIGINT AS pred FROM {majority_sql('ruled', 'accession')}")
def _majority(spark: SparkSession, sf: str) -> DataFrame:
    return longs(en.majority_global(ruled(spark, sf)), "pred")


@query("majority_by_embedding", f"WITH {LABEL_COUNTS} SELECT accession, pred::BIGINT AS pred FROM {majority_sql(majority_sql('ruled', 'accession, embedding_name'), 'accession')}")
def _majority_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return longs(en.majority_by_embedding(ruled(spark, sf)), "pred")


@query("majority_by_classifier", f"WITH {LABEL_COUNTS} SELECT accession, pred::BIGINT AS pred FROM {majority_sql(majority_sql('ruled', 'accession, model_type'), 'accession')}")
def _majority_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return longs(en.majority_by_classifier(ruled(spark, sf)), "pred")


@query("ensemble_summary", f"""WITH {LABEL_COUNTS} SELECT model_id, round(avg(f), 6) AS validation_score, any_value(w) AS weight
  FROM ls JOIN (VALUES {_WEIGHT_VALUES}) x(model_id, w) USING (model_id) GROUP BY model_id""")
def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return r6(en.ensemble_summary(fixed_weights(spark), en.validation_scores(class_probs(spark, sf), "multiclass", 3)))


@query("ensemble_predictions", f"""WITH {VOTE} SELECT accession, 'c' || (label % 3) AS true_label, 'c' || pred AS predicted_label,
    round(CASE pred WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 6) AS prediction_probability, 'fixed' AS strategy, 42 AS seed
  FROM voted JOIN embeddings ON vec_id::VARCHAR = accession""")
def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    votes = en.soft_vote(class_probs(spark, sf), fixed_weights(spark), "multiclass", 3)
    samples = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("accession"), F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("true_label")
    )
    return r6(en.ensemble_predictions(votes, samples, "fixed", 42, CLASSES))


@query("prediction_rows", f"""WITH {LABEL_COUNTS} SELECT accession, 'c' || y AS true_label, 'c' || pred AS predicted_label,
  round(greatest(p0, p1, p2), 6) AS prediction_probability, model_type, embedding_name, 42 AS seed FROM ruled""")
def _rows(spark: SparkSession, sf: str) -> DataFrame:
    probs = class_probs(spark, sf)
    samples = probs.where("model_id = 'A::V1'").select("accession", F.concat(F.lit("c"), F.col("y").cast("string")).alias("true_label"))
    return r6(pr.prediction_rows(samples, probs, CLASSES, "multiclass"))


@query("predictions_wide", f"""WITH {PREDS} SELECT seed, accession, 'test' AS dataset_split, any_value(true_label::VARCHAR) AS true_label,
    max(predicted_label::VARCHAR) FILTER (WHERE model_id = 'LR::V1') AS "pred_LR__V1", max(predicted_label::VARCHAR) FILTER (WHERE model_id = 'RF::V2') AS "pred_RF__V2",
    NULL::VARCHAR AS "pred_SVM__V1", '' AS "missing_reason_LR__V1", '' AS "missing_reason_RF__V2", 'model_not_available' AS "missing_reason_SVM__V1"
  FROM preds GROUP BY seed, accession""")
def _wide(spark: SparkSession, sf: str) -> DataFrame:
    rows = preds(spark, sf).select(
        "seed", "accession", "model_type", "embedding_name", F.col("true_label").cast("string").alias("true_label"),
        F.col("predicted_label").cast("string").alias("predicted_label"),
    )
    return pr.predictions_wide(rows, [("LR", "V1"), ("RF", "V2"), ("SVM", "V1")], by=["seed"])
