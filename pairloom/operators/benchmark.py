"""Multi-seed benchmark tables.  Metric rows carry ``seed`` as a column, so one plan covers all seeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions.ranks import attach
from pairloom.functions.scalars import nan_to_null
from pairloom.operators.metrics import balanced_accuracy, binary_metrics, macro_metrics, mcc, micro_f1

METRICS = ("accuracy", "precision", "recall", "f1")
COUNTS = ("TP", "TN", "FP", "FN")
CONFIG = ("model_type", "embedding_name", "strategy")
RANK_TIE = 1e-12

_SCORES = "struct<accuracy:double,precision:double,recall:double,f1:double>"
SUMMARY = (
    "struct<models_evaluated:array<struct<classifier_name:string,embedding_name:string,model:string,"
    f"test_metrics:{_SCORES},test_f1:double,diagnostics:struct<confusion_matrix:array<array<double>>>>>,"
    f"ensembles:array<struct<variant:string,test_metrics:{_SCORES},test_f1:double,"
    "TP:double,TN:double,FP:double,FN:double>>>"
)


def collect_executions(spark: SparkSession, root: str, seeds: Sequence[int]) -> DataFrame:
    """(seed, summary, sweep_run, predictions_path) of ``run_seed_<n>`` folders.

    The newest sweep run of a seed counts; a run without a readable summary is skipped.  The
    predictions file is the one named after the seed, else the newest of that run.
    """
    def listing(glob: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)

    part = r"run_seed_(\d+)/sweep/([^/]+)/"
    runs = listing("*").select("path", "modificationTime").select(
        F.regexp_extract("path", part, 1).alias("seed"), F.regexp_extract("path", part, 2).alias("sweep_run"),
        "modificationTime",
    ).where("seed <> ''").select(F.col("seed").cast("int").alias("seed"), "sweep_run", "modificationTime")
    latest = (
        runs.where(F.col("seed").isin([int(s) for s in seeds]))
        .groupBy("seed", "sweep_run").agg(F.max("modificationTime").alias("_at"))
        .groupBy("seed").agg(F.max(F.struct("_at", "sweep_run")).alias("_l")).select("seed", F.col("_l.sweep_run").alias("sweep_run"))
    )
    summaries = listing("benchmark_summary.json").where(F.col("path").rlike("/results/benchmark_summary.json$")).select(
        F.regexp_extract("path", part, 1).cast("int").alias("seed"), F.regexp_extract("path", part, 2).alias("sweep_run"),
        F.col("content").cast("string").alias("summary"),
    )
    valid = latest.join(summaries, ["seed", "sweep_run"]).where(F.try_parse_json("summary").isNotNull())
    files = listing("predictions_seed_*.csv").where(F.col("path").rlike("/predictions/predictions_seed_")).select(
        F.regexp_extract("path", part, 1).cast("int").alias("seed"), F.regexp_extract("path", part, 2).alias("sweep_run"),
        "path", "modificationTime", F.regexp_extract("path", r"predictions_seed_(\d+)\.csv$", 1).alias("_named"),
    ).withColumn("_exact", F.col("_named") == F.col("seed").cast("string"))
    newest = files.groupBy("seed", "sweep_run").agg(
        F.max_by("path", F.struct("_exact", "modificationTime")).alias("predictions_path")
    )
    return valid.join(newest, ["seed", "sweep_run"], "left").orderBy("seed")


def seed_rows_from_summary(executions: DataFrame, model_metrics: DataFrame | None = None,
                           ensemble_metrics: DataFrame | None = None) -> DataFrame:
    """Metric rows of single models and ensembles from the summaries.

    A seed whose predictions gave model metrics uses those instead of its summary; ensemble metrics
    from predictions replace the summary's value by value.
    """
    parsed = executions.select("seed", F.from_json("summary", SUMMARY).alias("_s"))
    zero = F.lit(0.0)
    m = parsed.select("seed", F.explode("_s.models_evaluated").alias("_m"))
    halves = F.split(F.coalesce("_m.model", F.lit("")), "::", 2)
    named = F.contains(F.coalesce("_m.model", F.lit("")), F.lit("::"))

    def either(own: str, index: int) -> Column:
        text = F.trim(F.coalesce(f"_m.{own}", F.lit("")))
        return F.when(text != "", text).when(named, F.trim(halves[index])).otherwise("")

    cm = F.col("_m.diagnostics.confusion_matrix")
    square = (F.size(cm) == 2) & (F.size(cm[0]) == 2) & (F.size(cm[1]) == 2)

    def cell(i: int, j: int) -> Column:
        return F.coalesce(F.when(square, cm[i][j]), zero)

    models = m.select(
        "seed", either("classifier_name", 0).alias("model_type"), either("embedding_name", 1).alias("embedding_name"),
        F.lit("single").alias("strategy"),
        *[F.coalesce(f"_m.test_metrics.{k}", zero).alias(k) for k in METRICS[:3]],
        F.coalesce("_m.test_f1", "_m.test_metrics.f1", zero).alias("f1"),
        cell(1, 1).alias("TP"), cell(0, 0).alias("TN"), cell(0, 1).alias("FP"), cell(1, 0).alias("FN"),
    ).where("model_type <> '' and embedding_name <> ''")
    if model_metrics is not None:
        fields = [*METRICS, *[F.col(c).cast("double").alias(c) for c in COUNTS]]
        own = model_metrics.select("seed", "model_type", "embedding_name", F.lit("single").alias("strategy"), *fields)
        models = own.unionByName(models.join(own.select("seed").distinct(), "seed", "left_anti"))

    e = parsed.select("seed", F.explode("_s.ensembles").alias("_e")).select(
        "seed", F.trim("_e.variant").alias("strategy"), "_e"
    ).where("strategy <> ''")
    fallback = {k: F.coalesce(f"_e.test_metrics.{k}", zero) for k in METRICS[:3]}
    fallback["f1"] = F.coalesce("_e.test_f1", "_e.test_metrics.f1", zero)
    fallback |= {c: F.coalesce(f"_e.{c}", zero) for c in COUNTS}
    if ensemble_metrics is not None:
        given = ensemble_metrics.select("seed", "strategy", *[F.col(k).cast("double").alias(f"_{k}") for k in (*METRICS, *COUNTS)])
        e = e.join(given, ["seed", "strategy"], "left")
        fallback = {k: F.coalesce(F.col(f"_{k}"), v) for k, v in fallback.items()}
    ensembles = e.select(
        "seed", F.lit("Ensemble").alias("model_type"), F.lit("all").alias("embedding_name"), "strategy",
        *[v.alias(k) for k, v in fallback.items()],
    )
    return models.unionByName(ensembles)


def seed_rank(seed_rows: DataFrame, scope: Sequence[str] = ("seed",)) -> DataFrame:
    """Competition rank by f1 inside each seed; a missing f1 has no rank.

    A row shares the rank of the rank's first row, its leader, if it is within 1e-12 of it; otherwise it leads a new rank. So a chain of
    close values doesn't drag on: 0.5, 0.5 - 0.8e-12, 0.5 - 1.6e-12 rank 1, 1, 3. The distinct f1 of a scope, one per configuration
    at most, are walked as one sorted array.
    """
    rows = seed_rows.withColumn("f1", nan_to_null(F.col("f1")))
    values = rows.where("f1 is not null").groupBy(*scope, "f1").agg(F.count(F.lit(1)).alias("_n"))
    listed = values.groupBy(*scope).agg(F.sort_array(F.collect_list(F.struct("f1", "_n")), asc=False).alias("_line"))
    start = F.struct(
        F.lit(None).cast("double").alias("leader"), F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("passed"),
        F.array().cast("array<struct<f1:double,rank:double>>").alias("out"),
    )

    def step(acc: Column, row: Column) -> Column:
        same = F.coalesce(acc["leader"] - row["f1"] <= RANK_TIE, F.lit(False))
        rank = F.when(same, acc["rank"]).otherwise(acc["passed"] + 1)
        return F.struct(
            F.when(same, acc["leader"]).otherwise(row["f1"]).alias("leader"), rank.alias("rank"), (acc["passed"] + row["_n"]).alias("passed"),
            F.array_append(acc["out"], F.struct(row["f1"].alias("f1"), rank.cast("double").alias("rank"))).alias("out"),
        )

    ranks = listed.select(*scope, F.inline(F.aggregate("_line", start, step, lambda acc: acc["out"])))
    return rows.join(ranks, [*scope, "f1"], "left").select(*rows.columns, "rank")


def _ranking_order() -> list[Column]:
    return [
        F.col("rank_sum").asc_nulls_last(), F.col("rank_mean").asc_nulls_last(), F.col("mean_f1").desc_nulls_last(), *map(F.col, CONFIG)
    ]


def seed_aggregate(ranked: DataFrame) -> DataFrame:
    """Means and population deviations over seeds, rank mean and sum, number of seeds."""
    clean = ranked.select(
        "seed", *CONFIG, *[nan_to_null(F.col(c)).alias(c) for c in (*METRICS, *COUNTS, "rank")]
    )
    per = []
    for metric in METRICS:
        per += [F.avg(metric).alias(f"mean_{metric}"), F.stddev_pop(metric).alias(f"std_{metric}")]
    return clean.groupBy(*CONFIG).agg(
        *per, *[F.avg(c).alias(f"{c}_mean") for c in COUNTS], F.avg("rank").alias("rank_mean"),
        F.sum("rank").alias("rank_sum"), F.count_distinct("seed").alias("num_seeds"),
    ).orderBy(*_ranking_order())


def expected_combos(models: DataFrame, views: DataFrame) -> DataFrame:
    """Every model_type of one table with every embedding_name of the other; both are configuration tables."""
    names = views.select("embedding_name").distinct().agg(F.collect_list("embedding_name").alias("_views"))
    return attach(models.select("model_type").distinct(), names, (), ["_views"]).select("model_type", F.explode("_views").alias("embedding_name"))


def append_expected(aggregated: DataFrame, expected: DataFrame) -> DataFrame:
    """Add expected configurations that were never observed: NULL metrics, zero counts, no seeds.

    ``expected`` has model_type, embedding_name and optionally strategy (default ``single``).
    """
    wanted = expected if "strategy" in expected.columns else expected.withColumn("strategy", F.lit("single"))
    missing = wanted.select(*CONFIG).distinct().join(aggregated.select(*CONFIG), list(CONFIG), "left_anti")
    types = {f.name: f.dataType for f in aggregated.schema.fields}
    zero = {*(f"{c}_mean" for c in COUNTS), "num_seeds"}
    filled = missing.select(*[
        F.col(c) if c in CONFIG else F.lit(0 if c in zero else None).cast(types[c]).alias(c) for c in aggregated.columns
    ])
    return aggregated.unionByName(filled).orderBy(*_ranking_order())


def ranking_table(model_rows: DataFrame, ensemble_rows: DataFrame) -> DataFrame:
    """Both scopes in one ordered table."""
    fields = [*CONFIG, "mean_f1", "rank_mean", "rank_sum", "num_seeds"]
    both = model_rows.select(F.lit("model_embedding").alias("scope"), *fields).unionByName(
        ensemble_rows.select(F.lit("ensemble_strategy").alias("scope"), *fields)
    )
    return both.orderBy("scope", *_ranking_order())


def best_single(model_scores: DataFrame, order_col: str = "row_order") -> DataFrame:
    """The model with the largest validation f1 per seed and ablation; the first wins a tie."""
    best = Window.partitionBy("seed", "ablation").orderBy(F.col("validation_f1").desc_nulls_last(), F.col(order_col))
    return model_scores.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")


def variant_deltas(variant_rows: DataFrame) -> DataFrame:
    """Differences to the best single model and the validation-test gap."""
    own = Window.partitionBy("seed", "ablation")

    def best(column: str) -> Column:
        return F.max(F.when(F.col("variant") == "best_single", F.col(column))).over(own)

    return (
        variant_rows
        .withColumn("delta_vs_best_single_test", F.col("test_f1") - best("test_f1"))
        .withColumn("delta_vs_best_single_zero_shot", F.col("zero_shot_f1") - best("zero_shot_f1"))
        .withColumn("generalization_gap", F.col("validation_f1") - F.col("test_f1"))
    )


_SPLIT_METRICS = [f"{s}_{m}" for s in ("validation", "test", "zero_shot") for m in ("acc", "precision", "recall", "f1")]


def multiseed_aggregate(rows: DataFrame) -> DataFrame:
    """Means over seeds per (ablation, variant), skipping missing values, and f1 deviations."""
    metrics = [c for c in _SPLIT_METRICS if c in rows.columns]
    deltas = {"delta_vs_best_single_test": "delta_vs_best", "delta_vs_best_single_zero_shot": "delta_vs_best_zero_shot",
              "generalization_gap": "generalization_gap"}
    clean = rows.select(
        "ablation", "variant", "category", "num_models", "weighting_strategy", "seed",
        *[nan_to_null(F.col(c)).alias(c) for c in (*metrics, *deltas)],
    )
    aggs = [F.min_by("category", "seed").alias("category")]
    aggs += [F.avg(c).alias(f"mean_{c}") for c in metrics]
    aggs += [F.stddev_pop(c).alias(f"std_{c}") for c in metrics if c.endswith("_f1")]
    aggs += [F.avg(c).alias(f"mean_{name}") for c, name in deltas.items()]
    aggs += [
        F.stddev_pop("delta_vs_best_single_test").alias("std_delta_vs_best"),
        F.min_by("num_models", "seed").alias("num_models"),
        F.min_by("weighting_strategy", "seed").alias("weighting_strategy"),
        F.count(F.lit(1)).alias("successful_runs"),
    ]
    return clean.groupBy("ablation", "variant").agg(*aggs).orderBy("ablation", "variant")


# Report headings of the comparison table and the columns behind them.
COMPARISON_COLUMNS = {
    "Category": "category", "Variant": "variant",
    "Validation Acc": "validation_acc", "Validation Press": "validation_precision",
    "Validation Rec": "validation_recall", "Validation F1": "validation_f1",
    "Test Acc": "test_acc", "Test Press": "test_precision", "Test Rec": "test_recall", "Test F1": "test_f1",
    "Zero-Shot Acc": "zero_shot_acc", "Zero-Shot Press": "zero_shot_precision",
    "Zero-Shot Rec": "zero_shot_recall", "Zero-Shot F1": "zero_shot_f1",
    "Delta vs Best Single (Test)": "delta_vs_best_single_test",
    "Delta vs Best Single (Zero-Shot)": "delta_vs_best_single_zero_shot",
    "Num Models": "num_models", "Weighting Strategy": "weighting_strategy",
}


def comparison_rows(rows: DataFrame) -> DataFrame:
    """The comparison table under its report headings."""
    return rows.select(*[
        (F.col(c) if c in rows.columns else F.lit(None).cast("double")).alias(h) for h, c in COMPARISON_COLUMNS.items()
    ])


def ranking_by_test(rows: DataFrame) -> DataFrame:
    return rows.select("variant", "category", "test_f1").orderBy(F.col("test_f1").desc_nulls_last(), "variant")


def ablation_specs(selections: Sequence[Mapping[str, Sequence[str]]], members: DataFrame) -> DataFrame:
    """Member rows per ablation: ``default`` keeps all, ``ablation_<i>`` those named by the i-th selection.

    Ablations with fewer than two members carry an error text.
    """
    specs: list[tuple[str, Column]] = [("default", F.lit(True))]
    for i, chosen in enumerate(selections, start=1):
        named = {k: [str(x) for x in chosen[k]] for k in ("embeddings", "classifiers") if isinstance(chosen.get(k), (list, tuple))}
        if not named:
            continue
        keep = F.lit(True)
        if named.get("embeddings"):
            keep = keep & F.col("embedding_name").isin(named["embeddings"])
        if named.get("classifiers"):
            keep = keep & F.col("model_type").isin(named["classifiers"])
        specs.append((f"ablation_{i}", keep))
    tags = F.array_compact(F.array(*[F.when(keep, F.lit(name)) for name, keep in specs]))
    rows = members.withColumn("ablation", F.explode(tags))
    sizes = rows.groupBy("ablation").agg(F.count(F.lit(1)).alias("_n"))
    named_rows = members.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n, _ in specs])).alias("ablation"))
    small = named_rows.join(sizes, "ablation", "left").where(F.coalesce("_n", F.lit(0)) < 2).select(
        "ablation", F.lit("fewer than two members").alias("error")
    )
    return rows.join(small, "ablation", "full_outer")


def benchmark_failures(runs: DataFrame, error: Column) -> DataFrame:
    """Distinct (seed, ablation, error) of the runs for which the expression ``error`` is not null."""
    return runs.select(F.col("seed").cast("int").alias("seed"), "ablation", error.alias("error")).where("error is not null").distinct()


def weights_analysis(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per (ablation, model): mean and deviation of the weight.  Per ablation: entropy and score correlation.

    A model absent from a seed weighs 0 there and has no validation score.
    """
    pairs = records.select(
        "ablation", "seed",
        F.explode(F.arrays_zip(F.col("models_used").alias("model"), F.col("weights").alias("weight"))).alias("_p"),
        "model_validation_scores",
    ).select(
        "ablation", "seed", F.col("_p.model").alias("model"), F.col("_p.weight").alias("weight"),
    )
    scored = records.select("ablation", "seed", F.explode("model_validation_scores").alias("model", "score"))
    # seeds x models of the ablation: both are configuration-sized lists, taken from aggregates
    models = pairs.groupBy("ablation").agg(F.collect_set("model").alias("_models"))
    grid = records.select("ablation", "seed").distinct().join(models, "ablation").select(
        "ablation", "seed", F.explode("_models").alias("model")
    )
    key = ["ablation", "seed", "model"]
    cells = grid.join(pairs, key, "left").join(scored, key, "left").select(
        *key, F.coalesce("weight", F.lit(0.0)).alias("weight"), nan_to_null(F.col("score")).alias("score")
    )
    per_model = cells.groupBy("ablation", "model").agg(
        F.avg("weight").alias("mean_weight"), F.stddev_pop("weight").alias("std_weight")
    )
    w = F.col("weight")
    seen = F.when(F.col("score").isNotNull(), w)
    per_seed = cells.groupBy("ablation", "seed").agg(
        (-F.sum(w * F.log(w + 1e-12))).alias("entropy"),
        F.count("score").alias("_n"), F.stddev_pop("score").alias("_ss"), F.stddev_pop(seen).alias("_sw"),
        F.covar_pop("score", seen).alias("_cov"),
    )
    usable = (F.col("_n") > 1) & (F.col("_ss") > 0) & (F.col("_sw") > 0)
    overall = per_seed.groupBy("ablation").agg(
        F.avg("entropy").alias("mean_entropy"), F.stddev_pop("entropy").alias("std_entropy"),
        F.avg(F.when(usable, F.col("_cov") / (F.col("_ss") * F.col("_sw")))).alias("mean_val_weight_correlation"),
    )
    return per_model, overall


def overfitting_report(rows: DataFrame) -> DataFrame:
    """Gap mean and deviation, test variance, and whether trained weights vary more than uniform ones."""
    clean = rows.select("ablation", "variant", *[nan_to_null(F.col(c)).alias(c) for c in ("generalization_gap", "test_f1")])
    per = clean.groupBy("ablation", "variant").agg(
        F.avg("generalization_gap").alias("mean_generalization_gap"),
        F.stddev_pop("generalization_gap").alias("std_generalization_gap"),
        F.var_pop("test_f1").alias("test_f1_variance"),
    )
    own = Window.partitionBy("ablation")

    def variance_of(variant: str) -> Column:
        return F.max(F.when(F.col("variant") == variant, F.col("test_f1_variance"))).over(own)

    flag = F.coalesce(variance_of("trainable_weights_soft_voting") > variance_of("uniform_soft_voting"), F.lit(False))
    return per.withColumn("possible_overfitting", flag)


def evaluate_scores(predictions: DataFrame, keys: Sequence[str] = ("model_id", "split"), y_true: str = "true_label",
                    y_pred: str = "predicted_label") -> DataFrame:
    """Macro metrics, micro f1, mcc and balanced accuracy per model and split in one plan."""
    out = macro_metrics(predictions, keys, y_true, y_pred)
    for extra in (micro_f1, mcc, balanced_accuracy):
        out = out.join(extra(predictions, keys, y_true, y_pred), list(keys))
    return out


def dataset_model_comparison(predictions: DataFrame, dataset_col: str = "dataset") -> DataFrame:
    """Sample counts and binary metrics per model and dataset."""
    keys = ["model_type", dataset_col]
    sizes = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_samples"))
    return sizes.join(binary_metrics(predictions, keys, pos_label=1), keys)


def species_comparison(predictions: DataFrame, species_col: str = "species") -> DataFrame:
    """The same comparison across species, with the difference to each model's mean f1."""
    rows = dataset_model_comparison(predictions, species_col)
    mean = rows.groupBy("model_type").agg(F.avg("f1").alias("_mean"))
    return rows.join(mean, "model_type").withColumn("f1_vs_mean", F.col("f1") - F.col("_mean")).drop("_mean")
