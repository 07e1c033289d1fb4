"""Training, sweep, neighbour and explanation queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import explain as ex
from pairloom.operators import neighbours as nb
from pairloom.operators import sweeps as sw
from pairloom.operators import training as tr
from pairloom.operators.linear import Linear, LinearModel, fit_linear, shares
from pairloom.operators.metrics import binary_metrics
from pairloom.plans import query
from pairloom.plans.fixtures import FEATURES, MODELS, PREDS, VIEWS, binary_sql, cells, features, longs, preds, r6, table, u_sql

# -- class weights and trials -----------------------------------------------------------------------


@query("class_weights", """SELECT lang AS label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM documents GROUP BY lang""")
def _weights(spark: SparkSession, sf: str) -> DataFrame:
    return r6(tr.class_weights(table(spark, sf, "documents").select(F.col("lang").alias("label"))))


SPACE = {
    "solver": {"values": ["lbfgs", "saga", "newton"]},
    "n_neighbors": {"min": 1, "max": 30, "distribution": "int_uniform"},
    "l1_ratio": {"min": 0.0, "max": 1.0},
    "C": {"min": 0.001, "max": 100.0, "distribution": "log_uniform_values"},
}


def _u(name: str) -> str:
    return u_sql(f"'42:' || trial || ':{name}'")


@query("sweep_trials", f"""WITH t AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS trial FROM embeddings)
  SELECT trial, 'solver' AS param, ['lbfgs', 'saga', 'newton'][(floor({_u('solver')} * 3) + 1)::INTEGER] AS "value", NULL::DOUBLE AS number FROM t
  UNION ALL SELECT trial, 'n_neighbors', (1 + floor({_u('n_neighbors')} * 30))::BIGINT::VARCHAR, (1 + floor({_u('n_neighbors')} * 30))::DOUBLE FROM t
  UNION ALL SELECT trial, 'l1_ratio', NULL, round({_u('l1_ratio')}, 6) FROM t
  UNION ALL SELECT trial, 'C', NULL, round(exp(ln(0.001::DOUBLE) + {_u('C')} * (ln(100.0::DOUBLE) - ln(0.001::DOUBLE))), 6) FROM t""")
def _trials(spark: SparkSession, sf: str) -> DataFrame:
    rows = sw.sweep_trials(spark, SPACE, table(spark, sf, "embeddings").count())
    number = F.col("value").try_cast("double")
    exact = F.col("param").isin("solver", "n_neighbors")
    return r6(rows.select("trial", "param", F.when(exact, F.col("value")).alias("value"), number.alias("number")))


@query("grid_trials", """WITH p AS (SELECT DISTINCT p_type AS v, p_brand AS w, p_size AS s FROM part), a AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT w AS v FROM p)),
    b AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT s::VARCHAR AS v FROM p)), c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT v FROM p)),
    g AS (SELECT (a.i * b.n + b.i) * c.n + c.i AS combo, a.v AS x, b.v AS y, c.v AS z FROM a, b, c)
  SELECT combo, run, u.param, u."value" FROM g, range(2) r(run), LATERAL (SELECT 'brand' AS param, x AS "value" UNION ALL SELECT 'size', y UNION ALL SELECT 'type', z) u""")
def _grid(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    columns = {"brand": "p_brand", "size": "p_size", "type": "p_type"}
    settings = part.select(F.inline(F.array(*[F.struct(F.lit(n).alias("param"), F.col(c).cast("string").alias("value")) for n, c in columns.items()])))
    return longs(sw.grid_trials(settings, runs=2), "combo", "run")


# -- trial rows: one trial per (seed, model, view) of the predictions -------------------------------

def trial_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Coarse f1 values, so that ties occur; one model reports macro_f1 only, one NaN."""
    wide = binary_metrics(preds(spark, sf), ["seed", "model_type", "embedding_name"], pos_label=1)
    order = (F.col("seed") - 42) * 6 + (F.array_position(F.array(*[F.lit(m) for m, _ in MODELS]), F.col("model_type")) - 1) * 2 + (
        F.array_position(F.array(*[F.lit(v) for v in VIEWS]), F.col("embedding_name")) - 1
    )
    f1 = F.round("f1", 1)
    return wide.select(
        order.alias("trial"), "model_type", "embedding_name",
        F.when(F.col("model_type") == "RF", None).when((F.col("seed") == 43) & (F.col("model_type") == "LR"), float("nan")).otherwise(f1).alias("validation_f1"),
        F.when(F.col("model_type") == "RF", f1).alias("validation_macro_f1"),
        F.concat(F.lit("trial "), order.cast("string")).alias("config"), "seed", "accuracy", "precision", "recall", "TP", "TN", "FP", "FN", "f1",
    )


TRIALS = f"""{PREDS}, trials AS (SELECT (seed - 42) * 6 + CASE model_type WHEN 'LR' THEN 0 WHEN 'RF' THEN 2 ELSE 4 END + CASE embedding_name WHEN 'V1' THEN 0 ELSE 1 END AS trial, *,
    CASE WHEN model_type = 'RF' OR (seed = 43 AND model_type = 'LR') THEN NULL ELSE round(f1, 1) END AS validation_f1, CASE WHEN model_type = 'RF' THEN round(f1, 1) END AS validation_macro_f1
  FROM ({binary_sql('seed, model_type, embedding_name', 'preds')}))"""


def _first(key: str, score: str) -> str:
    return f"(SELECT * FROM (SELECT *, {score} AS s, row_number() OVER (PARTITION BY {key} ORDER BY {score} DESC, trial) AS i FROM trials WHERE {score} IS NOT NULL) WHERE i = 1)"


@query("best_per_embedding", f"WITH {TRIALS} SELECT embedding_name, model_type, s AS validation_f1, 'trial ' || trial AS config FROM {_first('embedding_name', 'validation_f1')}")
def _best_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return sw.best_per_embedding(trial_rows(spark, sf))


@query("best_config_per_embedding", f"WITH {TRIALS} SELECT embedding_name, 'trial ' || trial AS config, s AS score FROM {_first('embedding_name', 'coalesce(validation_f1, validation_macro_f1)')}")
def _best_config(spark: SparkSession, sf: str) -> DataFrame:
    return sw.best_config_per_embedding(trial_rows(spark, sf).withColumn("validation_f1", F.nanvl("validation_f1", F.lit(None).cast("double"))))


@query("best_per_classifier", f"WITH {TRIALS} SELECT model_type, embedding_name AS best_embedding, s AS best_metric, 'trial ' || trial AS config FROM {_first('model_type', 'validation_f1')}")
def _best_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return sw.best_per_classifier(trial_rows(spark, sf))


@query("global_best", f"WITH {TRIALS} SELECT model_type, embedding_name, s AS best_metric, 'trial ' || trial AS config FROM {_first('1', 'validation_f1')}")
def _global(spark: SparkSession, sf: str) -> DataFrame:
    return sw.global_best(trial_rows(spark, sf))


@query("sweep_summary_pivot", f"""WITH {TRIALS} SELECT embedding_name, max(validation_f1) FILTER (WHERE model_type = 'LR') AS "LR",
  max(validation_macro_f1) FILTER (WHERE model_type = 'RF') AS "RF", max(validation_f1) FILTER (WHERE model_type = 'GBT') AS "GBT" FROM trials GROUP BY embedding_name""")
def _pivot(spark: SparkSession, sf: str) -> DataFrame:
    return sw.sweep_summary_pivot(trial_rows(spark, sf), ["LR", "RF", "GBT"])


@query("sweep_full_table", f"""WITH {TRIALS} SELECT model_type, embedding_name, round(accuracy, 6) AS validation_accuracy, round("precision", 6) AS validation_precision, round(recall, 6) AS validation_recall,
    round(f1, 6) AS validation_f1, CASE WHEN model_type = 'GBT' THEN round(accuracy, 6) END AS test_accuracy, CASE WHEN model_type = 'GBT' THEN round("precision", 6) END AS test_precision,
    CASE WHEN model_type = 'GBT' THEN round(recall, 6) END AS test_recall, CASE WHEN model_type = 'GBT' THEN round(f1, 6) END AS test_f1, NULL::DOUBLE AS test_roc_auc, NULL::DOUBLE AS test_pr_auc,
    CASE WHEN model_type <> 'LR' THEN TP END AS "TP", CASE WHEN model_type <> 'LR' THEN TN END AS "TN", CASE WHEN model_type <> 'LR' THEN FP END AS "FP", CASE WHEN model_type <> 'LR' THEN FN END AS "FN",
    CASE WHEN model_type = 'GBT' THEN seed ELSE 7 END AS seed_used FROM trials""")
def _full(spark: SparkSession, sf: str) -> DataFrame:
    rows = trial_rows(spark, sf)

    def scores(f1: str, counted: str, matrix: str):
        cm = F.array(F.array("TN", "FP"), F.array("FN", "TP"))
        kind = F.col("model_type")
        return F.struct(
            "accuracy", "precision", "recall", F.when(kind != "RF", F.col("f1")).alias("f1"), F.when(kind == "RF", F.col("f1")).alias("macro_f1"),
            F.lit(None).cast("double").alias("roc_auc"), F.lit(None).cast("double").alias("pr_auc"),
            *[F.when(kind == counted, F.col(c)).alias(c.lower()) for c in ("TP", "TN", "FP", "FN")], F.when(kind == matrix, cm).alias("confusion_matrix"),
        )

    shaped = rows.select(
        "model_type", "embedding_name", scores("f1", "RF", "GBT").alias("validation"),
        F.when(F.col("model_type") == "GBT", scores("f1", "none", "GBT")).alias("test"),
        F.when(F.col("model_type") == "GBT", F.col("seed")).alias("seed_used"),
    )
    out = sw.sweep_full_table(shaped.where("model_type <> 'GBT'"), shaped.where("model_type = 'GBT'"), seed_used=7)
    return r6(longs(out, "TP", "TN", "FP", "FN"))


# -- neighbours -------------------------------------------------------------------------------------

def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("accession"), "label", F.col("embedding").alias("vec"))
    test = F.substring(F.md5(F.concat(F.lit("split:"), "accession")), 1, 1) >= "d"
    return rows.where(~test), rows.where(test)


def _neighbours_sql(distance: str, k: int) -> str:
    return f"""e AS (SELECT vec_id::VARCHAR AS accession, label::VARCHAR AS label, embedding::DOUBLE[] AS v, substr(md5('split:' || vec_id), 1, 1) >= 'd' AS t FROM embeddings),
  near AS (SELECT q.accession, x.accession AS neighbour, x.label, {distance} AS distance FROM e q JOIN e x ON q.t AND NOT x.t
    QUALIFY row_number() OVER (PARTITION BY q.accession ORDER BY {distance}, x.accession) <= {k})"""


_EUCLID = "list_distance(q.v, x.v)"
_MANHATTAN = "list_sum([abs(q.v[i] - x.v[i]) FOR i IN range(1, 65)])"


@query("nearest_neighbours", f"WITH {_neighbours_sql(_EUCLID, 5)} SELECT accession, neighbour, label, round(distance, 5) AS distance FROM near")
def _near(spark: SparkSession, sf: str) -> DataFrame:
    return r6(nb.nearest_neighbours(*_sides(spark, sf), 5), 5)


@query("nearest_neighbours_pivots", f"WITH {_neighbours_sql(_EUCLID, 5)} SELECT accession, neighbour, label, round(distance, 5) AS distance FROM near")
def _near_pivots(spark: SparkSession, sf: str) -> DataFrame:
    return r6(nb.nearest_neighbours(*_sides(spark, sf), 5, pivots=16, block_rows=64), 5)


@query("train_knn", f"WITH {_neighbours_sql(_MANHATTAN, 7)} SELECT accession, label, round(count(*) / 7.0::DOUBLE, 6) AS prob FROM near GROUP BY accession, label")
def _knn(spark: SparkSession, sf: str) -> DataFrame:
    return r6(nb.train_knn(*_sides(spark, sf), 7, "manhattan"))


@query("knn_predict", f"""WITH {_neighbours_sql(_EUCLID, 7)}, v AS (SELECT accession, label, sum(1.0 / distance) AS w FROM near GROUP BY accession, label)
  SELECT accession, label AS predicted_label FROM v QUALIFY row_number() OVER (PARTITION BY accession ORDER BY round(w, 9) DESC, label) = 1""")
def _knn_predict(spark: SparkSession, sf: str) -> DataFrame:
    return nb.knn_predict(nb.train_knn(*_sides(spark, sf), 7, "euclidean", "distance"))


# -- fits: rows only, the solvers are Spark ML's -----------------------------------------------------

def _view(spark: SparkSession, sf: str) -> DataFrame:
    """A separable label, so that a fit has something to find."""
    return features(spark, sf).withColumn("label", (F.col("vec")[0] + F.col("vec")[1] > 0).cast("int"))


def _fit_query(kind: str, params: dict | None = None):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _view(spark, sf)
        fitted = tr.train_model(rows.where("split = 'train'"), kind, params, classes=[0, 1])
        return r6(tr.view_metrics(tr.batch_predict(fitted, rows), [0, 1]), 3)

    return run


query("train_lr")(_fit_query("LR", {"C": 10.0, "class_weight": "balanced"}))
query("train_rf")(_fit_query("RF"))
query("train_gbt")(_fit_query("GBT"))
query("train_linear_svm")(_fit_query("SVM"))
query("train_mlp")(_fit_query("MLP"))


@query("one_vs_rest")
def _rest(spark: SparkSession, sf: str) -> DataFrame:
    rows = _view(spark, sf).withColumn("labels", F.array_compact(F.array(
        F.when(F.col("label") == 1, "a"), F.when(F.col("vec")[2] > 0, "b")
    )))
    models = tr.one_vs_rest(rows.where("split = 'train'"), "LR", ["a", "b"])
    scored = tr.predict_multilabel(models, rows)
    right = [F.sum(((F.col("probs")[i] >= 0.5) == F.array_contains("labels", c)).cast("long")).alias(f"right_{c}") for i, c in enumerate(models)]
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *right)


@query("train_matrix")
def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = _view(spark, sf)
    both = rows.unionByName(rows.withColumn("view", F.lit("half")).withColumn("vec", F.slice("vec", 1, 32)))
    out, _ = tr.train_matrix(both, ["LR", "RF"], normalization="standard", evaluate_test=True)
    return r6(out, 3)


_KNN_VOTES = f"""WITH {_neighbours_sql(_EUCLID, 7)}, votes AS (SELECT accession, count(*) FILTER (WHERE label::INTEGER % 2 = 1) / 7.0::DOUBLE AS p1 FROM near GROUP BY accession),
  judged AS (SELECT accession, p1, (p1 >= 0.5)::INTEGER AS pred, e.label::INTEGER % 2 AS y FROM votes JOIN e USING (accession))"""


def _split_sides(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _sides(spark, sf)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("val")))
    return both.select("accession", (F.col("label") % 2).cast("int").alias("label"), "vec", "split", F.lit("V").alias("view"))


@query("train_matrix_knn", f"""{_KNN_VOTES}, c AS (SELECT count(*) FILTER (WHERE pred = 1 AND y = 1) AS tp, count(*) FILTER (WHERE pred = 0 AND y = 0) AS tn, count(*) FILTER (WHERE pred = 1 AND y = 0) AS fp,
    count(*) FILTER (WHERE pred = 0 AND y = 1) AS fn FROM judged)
  SELECT 'KNN-2' AS model_type, 'V' AS "view", 'val' AS split, metric, "value" FROM c, LATERAL (SELECT 'TP' AS metric, tp::DOUBLE AS "value" UNION ALL SELECT 'TN', tn UNION ALL SELECT 'FP', fp UNION ALL SELECT 'FN', fn
    UNION ALL SELECT 'accuracy', round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) UNION ALL SELECT 'f1', round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6)) u""")
def _matrix_knn(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = tr.train_matrix(_split_sides(spark, sf), ["KNN-2"], {"KNN-2": {"n_neighbors": 7}})
    return r6(out.where("metric in ('TP', 'TN', 'FP', 'FN', 'accuracy', 'f1')"))


@query("batch_predict_knn", f"{_KNN_VOTES} SELECT accession, round(p1, 6) AS p1, pred::BIGINT AS predicted_label FROM judged")
def _predict_knn(spark: SparkSession, sf: str) -> DataFrame:
    rows = _split_sides(spark, sf)
    fitted = tr.train_model(rows.where("split = 'train'"), "KNN", {"n_neighbors": 7})
    out = tr.batch_predict(fitted, rows.where("split = 'val'"))
    return r6(longs(out.select("accession", F.col("probs")[1].alias("p1"), "predicted_label"), "predicted_label"))


_LINEAR = """WITH e AS (SELECT vec_id::VARCHAR AS accession, label, embedding::DOUBLE[] AS v FROM embeddings),
  z AS (SELECT accession, list_sum([v[j] * ((j - 1) % 5 - 2) / 4.0::DOUBLE FOR j IN range(1, len(v) + 1)]) + 0.1::DOUBLE AS z FROM e)
  SELECT accession, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-z)), 6) AS p1, (z >= 0)::BIGINT AS predicted_label FROM z"""


@query("linear_scores", _LINEAR)
def _linear_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a model with given coefficients."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("accession"), F.col("embedding").alias("vec"))
    width = rows.select(F.size("vec").alias("w")).first()["w"]
    model = LinearModel(np.array([[(j % 5 - 2) / 4.0 for j in range(width)]]), np.array([0.1]))
    out = tr.batch_predict(tr.Fitted("LR", [0, 1], model), rows)
    return r6(longs(out.select("accession", F.col("probs")[1].alias("p1"), "predicted_label"), "predicted_label"))


@query("linear_optimum", """SELECT t.trial::BIGINT AS trial, s.side AS side, count(*)::BIGINT AS n, TRUE AS balanced FROM range(4) t(trial), (SELECT (embedding[1]::DOUBLE + embedding[2]::DOUBLE > 0) AS side FROM embeddings) s
  GROUP BY ALL""")
def _linear_optimum(spark: SparkSession, sf: str) -> DataFrame:
    """Four penalties fitted together; at each optimum the free intercept makes the mean error of all rows vanish."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.withColumn("side", F.col("vec")[0] + F.col("vec")[1] > 0)
    models = fit_linear(rows.select("vec", F.array(F.col("side").cast("int")).alias("target")), [Linear(C=c, tol=1e-6) for c in (0.01, 0.1, 1.0, 10.0)])
    scored = rows.select("side", F.posexplode(shares(models, F.col("vec"))).alias("trial", "p"))
    errors = scored.groupBy("trial").agg(F.avg(F.col("p")[1] - F.col("side").cast("double")).alias("error"))
    counts = scored.groupBy("trial", "side").agg(F.count(F.lit(1)).alias("n"))
    return longs(counts.join(errors, "trial").select("trial", "side", "n", (F.abs("error") < 1e-5).alias("balanced")), "trial")


@query("final_retrain")
def _retrain(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = tr.final_retrain(_view(spark, sf), {"V": ("LR", {})}, normalization="l2")
    return r6(out, 3)


@query("sweep_run")
def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    space = {"C": {"min": 0.01, "max": 10.0, "distribution": "log_uniform"}}
    return r6(tr.sweep_run(_view(spark, sf), "LR", space, 8)[0].drop("config"), 3)


@query("batch_predict")
def _predict(spark: SparkSession, sf: str) -> DataFrame:
    rows = _view(spark, sf)
    fitted = tr.train_lr(rows.where("split = 'train'"))
    return tr.batch_predict(fitted, rows).select("accession", "split", "predicted_label")


@query("batch_predict_proba")
def _proba(spark: SparkSession, sf: str) -> DataFrame:
    rows = _view(spark, sf)
    fitted = tr.train_rf(rows.where("split = 'train'"))
    return r6(tr.batch_predict_proba(fitted, rows).select("accession", F.col("probs")[1].alias("p1")), 3)


# -- explanations ------------------------------------------------------------------------------------

@query("importance_coef")
def _coef(spark: SparkSession, sf: str) -> DataFrame:
    return r6(ex.importance_coef(spark, tr.train_lr(_view(spark, sf).where("split = 'train'"), {"C": 1.0})), 3)


@query("importance_tree")
def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return r6(ex.importance_tree(spark, tr.train_rf(_view(spark, sf).where("split = 'train'"))), 3)


@query("importance_permutation")
def _permutation(spark: SparkSession, sf: str) -> DataFrame:
    rows = _view(spark, sf)
    fitted = tr.train_lr(rows.where("split = 'train'"), {"C": 10.0})
    return r6(ex.importance_permutation(fitted, rows.where("split <> 'train'")), 3)


@query("importance_auto")
def _auto(spark: SparkSession, sf: str) -> DataFrame:
    rows = _view(spark, sf)
    return r6(ex.importance_auto(tr.train_gbt(rows.where("split = 'train'")), rows), 3)


# Coefficients of an explained logistic model.
COEFFICIENTS = [((i * 37) % 11 - 5) / 10 for i in range(64)]
INTERCEPT = 0.25
_W = "[" + ", ".join(f"{c}::DOUBLE" for c in COEFFICIENTS) + "]"
LOGIT = f"""{FEATURES}, z AS (SELECT accession, vec, list_sum([vec[i] * ({_W})[i] FOR i IN range(1, 65)]) AS z FROM features)"""


@query("top_features", f"""WITH {FEATURES}, c AS (SELECT generate_subscripts(vec, 1) AS pos, unnest(vec) AS x FROM features)
  SELECT (pos - 1)::BIGINT AS feature, round(avg(abs(x)), 5) AS importance FROM c GROUP BY pos ORDER BY avg(abs(x)) DESC, pos LIMIT 10""")
def _top(spark: SparkSession, sf: str) -> DataFrame:
    size = features(spark, sf).select(F.posexplode(F.transform("vec", F.abs)).alias("feature", "x"))
    return longs(r6(ex.top_features(size.groupBy("feature").agg(F.avg("x").alias("importance"))), 5), "feature")


@query("saliency_gradient", f"""WITH {LOGIT}, p AS (SELECT accession, 1 / (1 + exp(-(z + {INTERCEPT}))) AS p FROM z)
  SELECT accession, (i - 1)::BIGINT AS pos, round(({_W})[i] * p * (1 - p), 6) + 0.0 AS x FROM p, range(1, 65) r(i)""")
def _gradient(spark: SparkSession, sf: str) -> DataFrame:
    return cells(ex.saliency_gradient(features(spark, sf), COEFFICIENTS, INTERCEPT), "accession", col="saliency")


@query("saliency_integrated", f"""WITH {LOGIT}, s AS (SELECT accession, vec, z, list_sum([(1 / (1 + exp(-(z * k / 49.0::DOUBLE + {INTERCEPT})))) * (1 - 1 / (1 + exp(-(z * k / 49.0::DOUBLE + {INTERCEPT}))))
    * CASE WHEN k = 0 OR k = 49 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END FOR k IN range(50)]) / 49 AS path FROM z)
  SELECT accession, (i - 1)::BIGINT AS pos, round(vec[i] * ({_W})[i] * path, 5) + 0.0 AS x FROM s, range(1, 65) r(i)""")
def _integrated(spark: SparkSession, sf: str) -> DataFrame:
    return cells(ex.saliency_integrated(features(spark, sf), COEFFICIENTS, INTERCEPT), "accession", col="saliency", digits=5)


@query("salient_dims", f"""WITH {LOGIT}, p AS (SELECT avg(1 / (1 + exp(-(z + {INTERCEPT}))) * (1 - 1 / (1 + exp(-(z + {INTERCEPT}))))) AS g FROM z)
  SELECT (i - 1)::BIGINT AS dimension, round(({_W})[i] * g, 5) + 0.0 AS saliency FROM p, range(1, 65) r(i) ORDER BY abs(round(({_W})[i] * g, 12)) DESC, i LIMIT 12""")
def _dims(spark: SparkSession, sf: str) -> DataFrame:
    rows = ex.saliency_gradient(features(spark, sf), COEFFICIENTS, INTERCEPT)
    return longs(r6(ex.salient_dims(rows, 12), 5), "dimension")
