"""Multi-seed benchmark queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import benchmark as be
from pairloom.operators.metrics import binary_metrics, binary_metrics_by_model
from pairloom.operators.splits import split_random
from pairloom.operators.vectors import l2_normalize
from pairloom.functions.hashing import unit
from pairloom.plans import query
from pairloom.plans.fixtures import (
    BINARY_ROUNDED, ENSEMBLE_PREDS, ENSEMBLE_ROWS, MODELS, PREDS, SEED_ROWS, VIEWS, binary_sql, ensemble_preds, ensemble_rows,
    preds, r6, seed_rows, table, u_sql,
)
from pairloom.plans.metrics import LABEL_COUNTS, ruled
from pairloom.plans.splits import _three, ranked_sql
from pairloom.session import scratch_path

# -- flagship: vectors -> split -> predictions -> metrics -> ranks over seeds -----------------------

_FLAGSHIP = f"""
  ids AS (SELECT vec_id::VARCHAR AS accession, (label % 2)::BIGINT AS truth, sqrt(list_sum([(v::DOUBLE) * v FOR v IN embedding])) AS norm, embedding[1]::DOUBLE AS lead FROM embeddings),
  parts AS (SELECT *, {_three(0.2, 0.1)} AS split FROM {ranked_sql('42', 'ids')}),
  scored AS (SELECT seed, model_type, embedding_name, truth AS true_label,
      ({u_sql("concat_ws('|', model_type, embedding_name, seed::VARCHAR, accession)")} * (1.0::DOUBLE - w) + w * truth + 0.01::DOUBLE * (lead / norm) >= 0.5)::BIGINT AS predicted_label
    FROM parts, (VALUES ('LR', 0.3::DOUBLE), ('RF', 0.25::DOUBLE), ('GBT', 0.1::DOUBLE)) m(model_type, w), (VALUES ('V1'), ('V2')) v(embedding_name), (VALUES (42), (43), (44)) s(seed)
    WHERE split = 'test'),
  seed_rows AS (SELECT *, 'single' AS strategy FROM ({binary_sql("seed, model_type, embedding_name", "scored")}))"""

# places follow the leader of a rank, which only a walk over the ordered values can tell
_RANKED = """listed AS (SELECT seed, f1, count(*) AS n, row_number() OVER (PARTITION BY seed ORDER BY f1 DESC) AS k,
    sum(count(*)) OVER (PARTITION BY seed ORDER BY f1 DESC) - count(*) + 1 AS here FROM seed_rows WHERE f1 IS NOT NULL GROUP BY seed, f1),
  walk AS (SELECT seed, k, f1, f1 AS leader, 1::DOUBLE AS place FROM listed WHERE k = 1
    UNION ALL SELECT l.seed, l.k, l.f1, CASE WHEN w.leader - l.f1 <= 1e-12::DOUBLE THEN w.leader ELSE l.f1 END, CASE WHEN w.leader - l.f1 <= 1e-12::DOUBLE THEN w.place ELSE l.here::DOUBLE END
    FROM walk w JOIN listed l ON l.seed = w.seed AND l.k = w.k + 1),
  ranked AS (SELECT s.*, w.place AS "rank" FROM seed_rows s LEFT JOIN walk w ON w.seed = s.seed AND w.f1 = s.f1)"""
_AGGREGATED = """aggregated AS (SELECT model_type, embedding_name, strategy, avg(accuracy) AS mean_accuracy, stddev_pop(accuracy) AS std_accuracy,
    avg("precision") AS mean_precision, stddev_pop("precision") AS std_precision, avg(recall) AS mean_recall, stddev_pop(recall) AS std_recall,
    avg(f1) AS mean_f1, stddev_pop(f1) AS std_f1, avg(TP) AS "TP_mean", avg(TN) AS "TN_mean", avg(FP) AS "FP_mean", avg(FN) AS "FN_mean",
    avg("rank") AS rank_mean, sum("rank") AS rank_sum, count(DISTINCT seed) AS num_seeds FROM ranked GROUP BY model_type, embedding_name, strategy)"""
_METRIC_COLUMNS = ["mean_accuracy", "std_accuracy", "mean_precision", "std_precision", "mean_recall", "std_recall", "mean_f1", "std_f1",
                   "TP_mean", "TN_mean", "FP_mean", "FN_mean", "rank_mean", "rank_sum"]
_ROUND_AGG = "model_type, embedding_name, strategy, num_seeds, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in _METRIC_COLUMNS)


@query("flagship_ranking", f"WITH RECURSIVE {_FLAGSHIP}, {_RANKED}, {_AGGREGATED} SELECT {_ROUND_AGG} FROM aggregated")
def _flagship(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("accession"), (F.col("label") % 2).cast("long").alias("true_label"), F.col("embedding").alias("vec")
    )
    unit_rows = l2_normalize(split_random(ids).where("split = 'test'"))
    spread = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model_type"), F.lit(w).alias("w"), F.lit(v).alias("embedding_name"), F.lit(s).alias("seed"))
        for m, w in MODELS for v in VIEWS for s in (42, 43, 44)
    ]))
    rows = unit_rows.select("accession", "true_label", F.col("vec")[0].alias("lead"), spread.alias("_s")).select("*", "_s.*")
    u = unit(F.md5(F.concat_ws("|", "model_type", "embedding_name", F.col("seed").cast("string"), "accession")))
    score = u * (1.0 - F.col("w")) + F.col("w") * F.col("true_label") + 0.01 * F.col("lead")
    metrics = binary_metrics_by_model(rows.withColumn("predicted_label", (score >= 0.5).cast("long")))
    return r6(be.seed_aggregate(be.seed_rank(metrics.withColumn("strategy", F.lit("single")))))


@query("seed_rank", f"WITH RECURSIVE {SEED_ROWS}, {_RANKED} SELECT seed, model_type, embedding_name, round(f1, 6) AS f1, \"rank\" FROM ranked")
def _rank(spark: SparkSession, sf: str) -> DataFrame:
    return r6(be.seed_rank(seed_rows(spark, sf)).select("seed", "model_type", "embedding_name", "f1", "rank"))


_CHAIN = """seed_rows AS (SELECT (p_size % 5)::BIGINT AS seed, p_partkey::VARCHAR AS model_type, p_brand AS embedding_name, 'single' AS strategy,
    0.9::DOUBLE - (p_partkey % 50)::DOUBLE * 0.8e-12::DOUBLE AS f1 FROM part)"""


@query("seed_rank_chain", f"WITH RECURSIVE {_CHAIN}, {_RANKED} SELECT seed, model_type, \"rank\" FROM ranked")
def _rank_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Values in steps of less than the tie width, so that ranks by the row above would all be one."""
    rows = table(spark, sf, "part").select(
        (F.col("p_size") % 5).cast("long").alias("seed"), F.col("p_partkey").cast("string").alias("model_type"), F.col("p_brand").alias("embedding_name"),
        F.lit("single").alias("strategy"), (F.lit(0.9) - (F.col("p_partkey") % 50).cast("double") * F.lit(0.8e-12)).alias("f1"))
    return be.seed_rank(rows).select("seed", "model_type", "rank")


@query("seed_aggregate", f"WITH RECURSIVE {SEED_ROWS}, {_RANKED}, {_AGGREGATED} SELECT {_ROUND_AGG} FROM aggregated")
def _aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return r6(be.seed_aggregate(be.seed_rank(seed_rows(spark, sf))))


@query("expected_combos", """SELECT DISTINCT a.p_type AS model_type, b.p_brand AS embedding_name FROM part a, (SELECT DISTINCT p_brand FROM part WHERE p_size > 25) b""")
def _combos(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return be.expected_combos(part.select(F.col("p_type").alias("model_type")), part.where("p_size > 25").select(F.col("p_brand").alias("embedding_name")))


@query("append_expected", f"""WITH RECURSIVE {SEED_ROWS}, {_RANKED}, {_AGGREGATED} SELECT model_type, embedding_name, strategy, num_seeds, round(mean_f1, 6) AS mean_f1,
    round("TP_mean", 6) AS "TP_mean", rank_sum FROM aggregated
  UNION ALL SELECT m, v, 'single', 0, NULL, 0, NULL FROM (VALUES ('LR', 'V3'), ('SVM', 'V1'), ('SVM', 'V2'), ('SVM', 'V3')) x(m, v)""")
def _expected(spark: SparkSession, sf: str) -> DataFrame:
    rows = be.seed_aggregate(be.seed_rank(seed_rows(spark, sf)))
    full = be.append_expected(rows, be.expected_combos(spark.createDataFrame([("LR",), ("SVM",)], "model_type string"), spark.createDataFrame([("V1",), ("V2",), ("V3",)], "embedding_name string")))
    return r6(full.select("model_type", "embedding_name", "strategy", "num_seeds", "mean_f1", "TP_mean", "rank_sum"))


@query("ranking_table", f"""WITH {SEED_ROWS}, {ENSEMBLE_PREDS},
  e AS (SELECT *, 'Ensemble' AS model_type, 'all' AS embedding_name FROM ({binary_sql("seed, strategy", "ensemble_preds")})),
  r AS (SELECT 'model_embedding' AS scope, seed, model_type, embedding_name, strategy, f1 FROM seed_rows UNION ALL SELECT 'ensemble_strategy', seed, model_type, embedding_name, strategy, f1 FROM e),
  k AS (SELECT *, rank() OVER (PARTITION BY scope, seed ORDER BY round(f1, 11) DESC) AS place FROM r)
  SELECT scope, model_type, embedding_name, strategy, round(avg(f1), 6) AS mean_f1, round(avg(place), 6) AS rank_mean, sum(place)::DOUBLE AS rank_sum, count(DISTINCT seed) AS num_seeds
  FROM k GROUP BY scope, model_type, embedding_name, strategy""")
def _table(spark: SparkSession, sf: str) -> DataFrame:
    models = be.seed_aggregate(be.seed_rank(seed_rows(spark, sf)))
    ensembles = be.seed_aggregate(be.seed_rank(ensemble_rows(spark, sf)))
    return r6(be.ranking_table(models, ensembles))


# -- summaries as JSON text -------------------------------------------------------------------------

def summaries(spark: SparkSession, sf: str) -> DataFrame:
    """(seed, summary): one JSON document per seed, built from the metric rows; models are few."""
    models = seed_rows(spark, sf).groupBy("seed").agg(F.collect_list(F.struct(
        F.when(F.col("model_type") != "RF", F.col("model_type")).alias("classifier_name"),
        F.when(F.col("model_type") != "RF", F.col("embedding_name")).alias("embedding_name"),
        F.concat_ws("::", "model_type", "embedding_name").alias("model"),
        F.struct("accuracy", "precision", "recall", "f1").alias("test_metrics"), F.col("f1").alias("test_f1"),
        F.struct(F.array(F.array("TN", "FP"), F.array("FN", "TP")).alias("confusion_matrix")).alias("diagnostics"),
    )).alias("models_evaluated"))
    ensembles = ensemble_rows(spark, sf).groupBy("seed").agg(F.collect_list(F.struct(
        F.col("strategy").alias("variant"), F.struct("accuracy", "precision", "recall").alias("test_metrics"), F.col("f1").alias("test_f1"), "TP", "FN",
    )).alias("ensembles"))
    return models.join(ensembles, "seed").select("seed", F.to_json(F.struct("models_evaluated", "ensembles")).alias("summary"))


@query("seed_rows_from_summary", f"""WITH {SEED_ROWS}, {ENSEMBLE_PREDS},
  e AS ({binary_sql("seed, strategy", "ensemble_preds")}), m AS ({binary_sql("seed, model_type, embedding_name", "preds")})
  SELECT seed, model_type, embedding_name, strategy, {BINARY_ROUNDED} FROM seed_rows WHERE seed <> 43
  UNION ALL SELECT seed, model_type, embedding_name, 'single', {BINARY_ROUNDED} FROM m WHERE seed = 43
  UNION ALL SELECT seed, 'Ensemble', 'all', strategy, TP, CASE WHEN strategy = 'majority_global' THEN TN ELSE 0 END, CASE WHEN strategy = 'majority_global' THEN FP ELSE 0 END, FN,
    round(accuracy, 6), round("precision", 6), round(recall, 6), round(f1, 6) FROM e""")
def _from_summary(spark: SparkSession, sf: str) -> DataFrame:
    own = binary_metrics_by_model(preds(spark, sf).where("seed = 43"))
    votes = ensemble_rows(spark, sf).where("strategy = 'majority_global'")
    rows = be.seed_rows_from_summary(summaries(spark, sf), own, votes)
    return r6(rows.select("seed", "model_type", "embedding_name", "strategy", *[F.col(c).cast("long").alias(c) for c in be.COUNTS], *be.METRICS))


@query("collect_executions", f"WITH {SEED_ROWS} SELECT seed, 'run_b' AS sweep_run, count(*) AS models FROM seed_rows WHERE seed <> 44 GROUP BY seed")
def _collect(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "executions")
    texts = summaries(spark, sf).persist()
    for seed in (42, 43):
        for run, text in (("run_a", F.lit("{}")), ("run_b", F.col("summary"))):
            folder = f"{root}/run_seed_{seed}/sweep/{run}/results"
            _write_single(texts.where(F.col("seed") == seed).select(text.alias("value")), f"{folder}/benchmark_summary.json")
    texts.unpersist()
    found = be.collect_executions(spark, root, [42, 43, 44])
    n = F.size(F.from_json("summary", be.SUMMARY).getField("models_evaluated"))
    return found.select("seed", "sweep_run", n.cast("long").alias("models"))


def _write_single(df: DataFrame, path: str) -> None:
    """A one-row text result as one file of that name."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    stream = fs.create(target)
    stream.write(bytearray("\n".join(r[0] for r in df.collect()).encode()))
    stream.close()


# -- variants per seed and ablation -----------------------------------------------------------------

_KEYS = ["seed", "ablation", "variant", "split"]
_WIDE = [("accuracy", "acc"), ("precision", "precision"), ("recall", "recall"), ("f1", "f1")]


def _spread(rows: DataFrame) -> DataFrame:
    """Rows repeated per ablation (all, odd accessions) and per evaluation split."""
    n = F.col("accession").cast("long")
    head = F.substring(F.md5(F.concat(F.lit("split:"), "accession")), 1, 1)
    ablations = F.array_compact(F.array(F.lit("default"), F.when(n % 2 == 1, "odd")))
    parts = F.array_compact(F.array(F.when(head < "8", "validation").otherwise("test"), F.when(n % 10 == 0, "zero_shot")))
    return rows.drop("split").withColumn("ablation", F.explode(ablations)).withColumn("split", F.explode(parts))


def _wide(rows: DataFrame) -> DataFrame:
    scores = binary_metrics(_spread(rows), _KEYS, pos_label=1)
    return scores.groupBy("seed", "ablation", "variant").agg(*[
        F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{short}")
        for s in ("validation", "test", "zero_shot") for m, short in _WIDE
    ])


def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    wide = _wide(preds(spark, sf).withColumnRenamed("model_id", "variant"))
    return wide.withColumn("row_order", F.col("variant"))


def variant_rows(spark: SparkSession, sf: str) -> DataFrame:
    best = be.best_single(model_scores(spark, sf)).drop("row_order").withColumn("variant", F.lit("best_single"))
    ensembles = _wide(ensemble_preds(spark, sf).withColumnRenamed("strategy", "variant"))
    both = best.unionByName(ensembles)
    single = F.col("variant") == "best_single"
    return both.withColumns({
        "category": F.when(single, "Single").otherwise("Ensemble"), "num_models": F.when(single, 1).otherwise(6),
        "weighting_strategy": F.when(single, "n/a").otherwise(F.col("variant")),
    })


def _wide_sql(source: str, variant: str) -> str:
    spread = f"""(SELECT s.seed, a.ablation, s.{variant} AS variant, p.split, s.true_label, s.predicted_label FROM {source} s,
      (VALUES ('default'), ('odd')) a(ablation), (VALUES ('validation'), ('test'), ('zero_shot')) p(split)
      WHERE (a.ablation = 'default' OR s.accession::BIGINT % 2 = 1) AND (CASE p.split WHEN 'validation' THEN substr(md5('split:' || s.accession), 1, 1) < '8'
        WHEN 'test' THEN substr(md5('split:' || s.accession), 1, 1) >= '8' ELSE s.accession::BIGINT % 10 = 0 END))"""
    columns = ", ".join(f'max("{m}") FILTER (WHERE split = \'{s}\') AS {s}_{short}' for s in ("validation", "test", "zero_shot") for m, short in _WIDE)
    return f"SELECT seed, ablation, variant, {columns} FROM ({binary_sql('seed, ablation, variant, split', spread)}) GROUP BY seed, ablation, variant"


VARIANTS = f"""{PREDS}, {ENSEMBLE_PREDS}, model_wide AS ({_wide_sql('preds', 'model_id')}),
  best AS (SELECT * EXCLUDE (i) REPLACE ('best_single' AS variant) FROM (SELECT *, row_number() OVER (PARTITION BY seed, ablation ORDER BY validation_f1 DESC NULLS LAST, variant) AS i FROM model_wide) WHERE i = 1),
  variant_rows AS (SELECT *, CASE variant WHEN 'best_single' THEN 'Single' ELSE 'Ensemble' END AS category, CASE variant WHEN 'best_single' THEN 1 ELSE 6 END AS num_models,
      CASE variant WHEN 'best_single' THEN 'n/a' ELSE variant END AS weighting_strategy FROM (SELECT * FROM best UNION ALL BY NAME {_wide_sql('ensemble_preds', 'strategy')})),
  deltas AS (SELECT v.*, v.test_f1 - b.test_f1 AS delta_test, v.zero_shot_f1 - b.zero_shot_f1 AS delta_zero, v.validation_f1 - v.test_f1 AS gap
    FROM variant_rows v JOIN best b ON b.seed = v.seed AND b.ablation = v.ablation)"""


@query("best_single", f"""WITH {PREDS}, m AS ({_wide_sql('preds', 'model_id')}) SELECT seed, ablation, variant, round(validation_f1, 6) AS validation_f1, round(test_f1, 6) AS test_f1
  FROM (SELECT *, row_number() OVER (PARTITION BY seed, ablation ORDER BY validation_f1 DESC NULLS LAST, variant) AS i FROM m) WHERE i = 1""")
def _best(spark: SparkSession, sf: str) -> DataFrame:
    return r6(be.best_single(model_scores(spark, sf)).select("seed", "ablation", "variant", "validation_f1", "test_f1"))


@query("variant_deltas", f"""WITH {VARIANTS} SELECT seed, ablation, variant, round(delta_test, 6) + 0.0 AS delta_vs_best_single_test,
  round(delta_zero, 6) + 0.0 AS delta_vs_best_single_zero_shot, round(gap, 6) + 0.0 AS generalization_gap FROM deltas""")
def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    return r6(be.variant_deltas(variant_rows(spark, sf)).select(
        "seed", "ablation", "variant", "delta_vs_best_single_test", "delta_vs_best_single_zero_shot", "generalization_gap"
    ))


_MULTI = ", ".join(f"round(avg({s}_{short}), 6) AS mean_{s}_{short}" for s in ("validation", "test", "zero_shot") for _, short in _WIDE)
_MULTI_STD = ", ".join(f"round(stddev_pop({s}_f1), 6) AS std_{s}_f1" for s in ("validation", "test", "zero_shot"))


@query("multiseed_aggregate", f"""WITH {VARIANTS} SELECT ablation, variant, any_value(category) AS category, {_MULTI}, {_MULTI_STD}, round(avg(delta_test), 6) + 0.0 AS mean_delta_vs_best,
    round(stddev_pop(delta_test), 6) AS std_delta_vs_best, round(avg(delta_zero), 6) + 0.0 AS mean_delta_vs_best_zero_shot, round(avg(gap), 6) + 0.0 AS mean_generalization_gap,
    any_value(num_models) AS num_models, any_value(weighting_strategy) AS weighting_strategy, count(*) AS successful_runs FROM deltas GROUP BY ablation, variant""")
def _multiseed(spark: SparkSession, sf: str) -> DataFrame:
    return r6(be.multiseed_aggregate(be.variant_deltas(variant_rows(spark, sf))))


_COMPARE = ", ".join(
    f'round({c}, 6) + 0.0 AS "{h}"' if c.split("_")[0] in ("validation", "test", "zero") else f'{c} AS "{h}"'
    for h, c in be.COMPARISON_COLUMNS.items() if not c.startswith("delta")
)


@query("comparison_rows", f"""WITH {VARIANTS} SELECT {_COMPARE}, round(delta_test, 6) + 0.0 AS "Delta vs Best Single (Test)", round(delta_zero, 6) + 0.0 AS "Delta vs Best Single (Zero-Shot)" FROM deltas""")
def _comparison(spark: SparkSession, sf: str) -> DataFrame:
    return r6(be.comparison_rows(be.variant_deltas(variant_rows(spark, sf))))


@query("ranking_by_test", f"WITH {VARIANTS} SELECT variant, category, round(test_f1, 6) AS test_f1 FROM variant_rows ORDER BY test_f1 DESC")
def _by_test(spark: SparkSession, sf: str) -> DataFrame:
    return r6(be.ranking_by_test(variant_rows(spark, sf)))


@query("overfitting_report", f"""WITH {VARIANTS}, r AS (SELECT ablation, variant, avg(gap) AS g, stddev_pop(gap) AS s, var_pop(test_f1) AS v FROM deltas GROUP BY ablation, variant)
  SELECT ablation, variant, round(g, 6) + 0.0 AS mean_generalization_gap, round(s, 6) AS std_generalization_gap, round(v, 6) AS test_f1_variance,
    max(v) FILTER (WHERE variant = 'trainable_weights_soft_voting') OVER (PARTITION BY ablation) > max(v) FILTER (WHERE variant = 'uniform_soft_voting') OVER (PARTITION BY ablation) AS possible_overfitting FROM r""")
def _overfitting(spark: SparkSession, sf: str) -> DataFrame:
    return r6(be.overfitting_report(be.variant_deltas(variant_rows(spark, sf))))


@query("ablation_specs", f"""WITH {PREDS}, m AS (SELECT DISTINCT model_type, embedding_name FROM preds)
  SELECT 'default' AS ablation, model_type, embedding_name, NULL::VARCHAR AS error FROM m
  UNION ALL SELECT 'ablation_1', model_type, embedding_name, NULL FROM m WHERE embedding_name = 'V1'
  UNION ALL SELECT 'ablation_3', model_type, embedding_name, 'fewer than two members' FROM m WHERE model_type = 'LR' AND embedding_name = 'V2'
  UNION ALL SELECT 'ablation_4', NULL, NULL, 'fewer than two members'""")
def _ablations(spark: SparkSession, sf: str) -> DataFrame:
    members = preds(spark, sf).select("model_type", "embedding_name").distinct()
    specs = [{"embeddings": ["V1"]}, {"other": 1}, {"embeddings": ["V2"], "classifiers": ["LR"]}, {"classifiers": ["none"]}]
    return be.ablation_specs(specs, members).select("ablation", "model_type", "embedding_name", "error")


def weight_records(spark: SparkSession, sf: str) -> DataFrame:
    """Weights in proportion to the validation f1; one model is absent in one seed, one has no score."""
    scores = model_scores(spark, sf).where("not (seed = 43 and variant = 'GBT::V2')").select("seed", "ablation", "variant", "validation_f1", "test_f1")
    listed = F.array_sort(F.collect_list(F.struct("variant", "validation_f1")))
    rows = scores.groupBy("seed", "ablation").agg(listed.alias("_l"), F.sum("validation_f1").alias("_t"), F.avg("test_f1").alias("test_f1"))
    return rows.select(
        "seed", "ablation", F.transform("_l", lambda s: s.getField("validation_f1") / F.col("_t")).alias("weights"),
        F.transform("_l", lambda s: s.getField("variant")).alias("models_used"), "test_f1",
        F.map_from_entries(F.filter("_l", lambda s: s.getField("variant") != "LR::V1")).alias("model_validation_scores"),
    )


WEIGHTS = f"""{PREDS}, m AS ({_wide_sql('preds', 'model_id')}), w0 AS (SELECT seed, ablation, variant AS model, validation_f1 AS score FROM m WHERE NOT (seed = 43 AND variant = 'GBT::V2')),
  w1 AS (SELECT *, score / sum(score) OVER (PARTITION BY seed, ablation) AS weight FROM w0),
  grid AS (SELECT s.ablation, s.seed, x.model FROM (SELECT DISTINCT seed, ablation FROM w1) s JOIN (SELECT DISTINCT ablation, model FROM w1) x USING (ablation)),
  cells AS (SELECT g.ablation, g.seed, g.model, coalesce(weight, 0) AS weight, CASE WHEN g.model <> 'LR::V1' THEN score END AS score
    FROM grid g LEFT JOIN w1 ON w1.seed = g.seed AND w1.ablation = g.ablation AND w1.model = g.model)"""


@query("weights_analysis", f"""WITH {WEIGHTS} SELECT ablation, model, round(avg(weight), 6) AS mean_weight, round(stddev_pop(weight), 6) AS std_weight FROM cells GROUP BY ablation, model""")
def _weights(spark: SparkSession, sf: str) -> DataFrame:
    return r6(be.weights_analysis(weight_records(spark, sf))[0])


@query("weights_analysis_overall", f"""WITH {WEIGHTS}, per AS (SELECT ablation, seed, -sum(weight * ln(weight + 1e-12)) AS entropy, corr(score, weight) AS c FROM cells GROUP BY ablation, seed)
  SELECT ablation, round(avg(entropy), 6) AS mean_entropy, round(stddev_pop(entropy), 6) AS std_entropy, round(avg(c), 6) AS mean_val_weight_correlation FROM per GROUP BY ablation""")
def _weights_overall(spark: SparkSession, sf: str) -> DataFrame:
    return r6(be.weights_analysis(weight_records(spark, sf))[1])


@query("evaluate_scores", f"""WITH {LABEL_COUNTS}, f AS (SELECT model_id, sum(tp)::DOUBLE AS c, sum(support)::DOUBLE AS s, sum(support::DOUBLE * (tp + fp)) AS x, sum(support::DOUBLE * support) AS tt, sum((tp + fp)::DOUBLE * (tp + fp)) AS pp,
    avg(p) AS p, avg(r) AS r, avg(f) AS f1, 2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro, avg(r) FILTER (WHERE support > 0) AS b FROM ls GROUP BY model_id)
  SELECT model_id, 'all' AS split, round(c / s, 6) AS accuracy, round(p, 6) AS "precision", round(r, 6) AS recall, round(f1, 6) AS f1, round(micro, 6) AS micro_f1,
    round((c * s - x) / (sqrt(s * s - pp) * sqrt(s * s - tt)), 6) AS mcc, round(b, 6) AS balanced_accuracy FROM f""")
def _evaluate(spark: SparkSession, sf: str) -> DataFrame:
    return r6(be.evaluate_scores(ruled(spark, sf).withColumn("split", F.lit("all")), y_true="y", y_pred="pred"))


_DATASET = "(SELECT p.*, d.lang AS dataset FROM preds p JOIN documents d ON d.doc_id::VARCHAR = p.accession)"


@query("dataset_model_comparison", f"WITH {PREDS} SELECT model_type, dataset, TP + TN + FP + FN AS num_samples, {BINARY_ROUNDED} FROM ({binary_sql('model_type, dataset', _DATASET)})")
def _datasets(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("accession"), F.col("lang").alias("dataset"))
    return r6(be.dataset_model_comparison(preds(spark, sf).join(docs, "accession")))


@query("species_comparison", f"""WITH {PREDS}, b AS ({binary_sql('model_type, dataset', _DATASET)}) SELECT model_type, dataset AS species, round(f1, 6) AS f1,
  round(f1 - avg(f1) OVER (PARTITION BY model_type), 6) + 0.0 AS f1_vs_mean FROM b""")
def _species(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("accession"), F.col("lang").alias("species"))
    return r6(be.species_comparison(preds(spark, sf).join(docs, "accession")).select("model_type", "species", "f1", "f1_vs_mean"))


@query("benchmark_failures", f"""WITH {SEED_ROWS} SELECT DISTINCT seed, 'default' AS ablation, 'f1 below 0.95' AS error FROM seed_rows WHERE f1 < 0.95""")
def _failures(spark: SparkSession, sf: str) -> DataFrame:
    runs = seed_rows(spark, sf).withColumn("ablation", F.lit("default"))
    return be.benchmark_failures(runs, F.when(F.col("f1") < 0.95, "f1 below 0.95"))
