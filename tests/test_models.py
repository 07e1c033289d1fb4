"""Vectors, metrics, ensembles, benchmark tables, statistics, fits."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import benchmark as be
from pairloom.operators import ensembles as en
from pairloom.operators import explain as ex
from pairloom.operators import metrics as me
from pairloom.operators import neighbours as nb
from pairloom.operators import statistics as st
from pairloom.operators import sweeps as sw
from pairloom.operators import linear as li
from pairloom.operators import training as tr
from pairloom.operators import vectors as ve
from pairloom.sources import relational
from pairloom.streaming.score import score_stream


# -- vectors ---------------------------------------------------------------------------------------

def layer_rows(spark):
    return spark.createDataFrame(
        [("m", "P1", 7, [1.5, 3.0, 1.0]), ("m", "P2", 2, [4.0, 4.0, 4.0]), ("m", "P1", 2, [0.5, -1.0, 9.0]), ("m", "P2", 7, [0.0, 8.0, 2.0])],
        "model string, accession string, layer_index int, vec array<float>",
    )


@pytest.mark.parametrize("mode,want", [
    ("mean", [1, 1, 5]), ("attention", [1, 1, 5]), ("max", [1.5, 3, 9]), ("mean_max", [1, 1, 5, 1.5, 3, 9]), ("concat", [0.5, -1, 9, 1.5, 3, 1]),
])
def test_layer_modes(spark, mode, want):
    rows = {r["accession"]: list(r["vec"]) for r in ve.aggregate_layers(layer_rows(spark), mode).collect()}
    assert rows["P1"] == want and len(rows) == 2


def test_concatenation_plans_no_sort_of_vectors(spark):
    plan = ve.layers_concat(layer_rows(spark))._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan


def test_layer_views(spark):
    assert {r["view"] for r in ve.layers_none(layer_rows(spark)).collect()} == {"m__layer_2", "m__layer_7"}
    assert {r["view"] for r in ve.layers_none(layer_rows(spark).where("layer_index = 2")).collect()} == {"m"}
    with pytest.raises(ValueError):
        ve.aggregate_layers(layer_rows(spark), "other")


def test_strict_feature_join(spark):
    samples = spark.createDataFrame([("P2", "train"), ("P1", "train"), ("P3", "val")], "accession string, split string")
    views = spark.createDataFrame([("v", "P1", [1.0, 1.0]), ("v", "P2", [2.0, 2.0])], "view string, accession string, vec array<double>")
    with pytest.raises(ValueError, match="P3"):
        ve.features_join(samples, views)
    filled = {r["accession"]: list(r["vec"]) for r in ve.features_join(samples, views, ["v"]).collect()}
    assert filled == {"P1": [1, 1], "P2": [2, 2], "P3": [0, 0]}


def test_ontology_vectors(spark):
    rows = [("MF", "Q7", [0.25]), ("BP", "Q7", [9.0, -2.0]), ("CC", "Q7", [1.0, 1.5, 2.0]), ("CC", "Q8", [6.0, 5.0, 4.0])]
    vectors = spark.createDataFrame(rows, "ontology string, accession string, vec array<float>")
    ids = spark.createDataFrame([("Q9",), ("Q7",), ("Q8",)], "accession string")
    got = {r["accession"]: list(r["vec"]) for r in ve.go_concat(vectors, ids).collect()}
    assert got == {"Q7": [9, -2, 1, 1.5, 2, 0.25], "Q8": [0, 0, 6, 5, 4, 0], "Q9": [0] * 6}
    assert [ve.ontology_of(n) for n in ("terms_f_v2.tsv", "bp_all.csv", "my_cc", "misc")] == ["MF", "BP", "CC", "misc"]


def test_scaler_sees_train_only(spark):
    rows = [("v", "a", "train", [0.0, 5.0]), ("v", "b", "train", [2.0, 5.0]), ("v", "c", "test", [101.0, 6.0])]
    out = ve.standard_scale(spark.createDataFrame(rows, "view string, accession string, split string, vec array<double>"))
    assert {r["accession"]: list(r["vec"]) for r in out.collect()} == {"a": [-1, 0], "b": [1, 0], "c": [100, 1]}


def test_relational_store(spark):
    raw = bytearray(np.array([1.25, -3.5], dtype="<f4").tobytes())
    emb = spark.createDataFrame([(90, 4, 11, raw)], "sequence_id int, embedding_type_id int, layer_index int, embedding binary")
    seq = spark.createDataFrame([(90,)], "id int")
    prot = spark.createDataFrame([(17, 90)], "id int, sequence_id int")
    acc = spark.createDataFrame([(17, "Z9", False), (17, "K0AAA1", True)], "protein_id int, code string, primary boolean")
    row = relational.load_layer_embeddings(emb, seq, prot, acc, 4, 11).collect()
    assert len(row) == 1 and row[0]["accession"] == "K0AAA1" and list(row[0]["vec"]) == [1.25, -3.5]
    with pytest.raises(ValueError):
        relational.load_layer_embeddings(emb, seq, prot, acc, 4, 12)
    with pytest.raises(ValueError):
        relational.resolve_embedding_type(spark.createDataFrame([(1, "a")], "id int, name string"), "b")
    assert relational.load_proteins(prot, acc).first()["organism"] is None


# -- probabilities, decisions, ensembles -----------------------------------------------------------

def test_canonical_shapes(spark):
    one = spark.createDataFrame([([0.0],), ([0.35],), ([1.0],)], "probs array<double>")
    assert [[round(p, 9) for p in r["probs"]] for r in en.probs_canonical(one, "binary").collect()] == [[1.0, 0.0], [0.65, 0.35], [0.0, 1.0]]
    with pytest.raises(Exception, match="columns"):
        en.probs_canonical(spark.createDataFrame([([0.25, 0.25, 0.25, 0.25],)], "probs array<double>"), "binary").collect()


def test_better_model_weighs_more(spark):
    """Three models: one right, one wrong on a third, one always wrong."""
    y = [1, 1, 0, 0, 1, 0]
    given = {"good": y, "fair": [0, *y[1:5], 1], "bad": [1 - t for t in y]}
    rows = [(m, f"s{i}", t, [0.8 - 0.6 * p, 0.2 + 0.6 * p]) for m, ps in given.items() for i, (t, p) in enumerate(zip(y, ps))]
    probs = spark.createDataFrame(rows, "model_id string, accession string, y int, probs array<double>")
    weights = {r["model_id"]: r["weight"] for r in en.weights_validation(probs, "binary", 2).collect()}
    assert weights["good"] > weights["fair"] > weights["bad"] == 0.0 and math.isclose(sum(weights.values()), 1.0)
    found = {r["model_id"]: r["weight"] for r in en.weights_random_search(probs, list(given), "binary", 2).collect()}
    assert found["good"] + found["fair"] > found["bad"] and math.isclose(sum(found.values()), 1.0)
    vote = en.soft_vote(probs, spark.createDataFrame(list(weights.items()), "model_id string, weight double"), "binary", 2)
    assert [r["pred"] for r in vote.orderBy("accession").collect()] == y


def test_no_positive_weight_is_an_error(spark):
    rows = [("RF", "0", 0, [0.0, 1.0]), ("RF", "1", 1, [1.0, 0.0])]
    with pytest.raises(Exception, match="positive"):
        en.weights_validation(spark.createDataFrame(rows, "model_id string, accession string, y int, probs array<double>"), "binary", 2).collect()


def test_multilabel_weight_search(spark):
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 2, (60, 3))
    rows = []
    for i, t in enumerate(truth):
        rows.append(("good", str(i), t.tolist(), (t * 0.8 + 0.1).tolist()))
        rows.append(("bad", str(i), t.tolist(), rng.random(3).tolist()))
    probs = spark.createDataFrame(rows, "model_id string, accession string, y array<int>, probs array<double>")
    found = {r["model_id"]: r["weight"] for r in en.weights_random_search(probs, ["good", "bad"], "multilabel", 3, 64).collect()}
    assert found["good"] > 0.5


def test_weight_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    y, probs = rng.integers(0, 2, 80), rng.random((3, 80))
    rows = [(f"m{m}", str(i), int(y[i]), [float(1 - probs[m, i]), float(probs[m, i])]) for m in range(3) for i in range(80)]
    df = spark.createDataFrame(rows, "model_id string, accession string, y int, probs array<double>")
    weights = en.dirichlet_trials(["m0", "m1", "m2"], 40, 42)
    best, score = None, -1.0
    for t, w in enumerate(weights):
        pred = (w @ probs >= 0.5).astype(int)
        f1 = np.mean([2 * ((pred == c) & (y == c)).sum() / max(1, (pred == c).sum() + (y == c).sum()) for c in (0, 1)])
        if f1 > score + 1e-12:
            best, score = t, f1
    row = en.weights_random_search(df, ["m0", "m1", "m2"], "binary", 2, 40).first()
    assert row["trial"] == best and math.isclose(row["score"], score, abs_tol=1e-9)


def test_majority_ties_and_modes(spark):
    rows = [("s", "LR", "V1", 1), ("s", "LR", "V2", 0), ("s", "RF", "V1", 1), ("s", "RF", "V2", 0)]
    votes = spark.createDataFrame(rows, "accession string, model_type string, embedding_name string, pred int")
    assert [f(votes).first()["pred"] for f in (en.majority_global, en.majority_by_embedding, en.majority_by_classifier)] == [0, 0, 0]


# -- metrics ---------------------------------------------------------------------------------------

def area(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties_and_skew(spark, partitions):
    rng = random.Random(3)
    rows = [("hot", rng.randint(0, 1), rng.choice([0.5, rng.random()])) for _ in range(400)] + [("cold", i % 2, i / 10) for i in range(10)]
    rows += [("single", 1, 0.3)]
    df = spark.createDataFrame(rows, "k string, true_label int, score double")
    got = {r["k"]: r["roc_auc"] for r in me.roc_auc(df, ["k"]).collect()}
    for key in ("hot", "cold"):
        assert math.isclose(got[key], area([y for k, y, _ in rows if k == key], [s for k, _, s in rows if k == key]), abs_tol=1e-9)
    assert got["single"] is None


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([("m", 0, 0), ("m", 0, 0)], "k string, true_label int, predicted_label int")
    row = me.binary_metrics(df, ["k"], pos_label=1).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0, 0, 0, 1)
    assert me.mcc(df, ["k"]).first()["mcc"] == 0


# -- benchmark tables ------------------------------------------------------------------------------

TRUTH = [1, 0, 1, 1, 0, 0, 1, 0]
# positions that a model gets wrong, by seed
WRONG = {5: {"LR A": [0], "LR B": [1, 2], "RF A": [1, 2], "RF B": []}, 6: {"LR A": [], "LR B": [3], "RF A": [3], "RF B": [4, 5]}}


def combo_tables(spark):
    return spark.createDataFrame([("LR",), ("SVM",)], "model_type string"), spark.createDataFrame([("A",)], "embedding_name string")


def test_several_seeds(spark):
    rows = [
        (seed, *name.split(), str(i), t, 1 - t if i in wrong else t)
        for seed, models in WRONG.items() for name, wrong in models.items() for i, t in enumerate(TRUTH)
    ]
    preds = spark.createDataFrame(rows, "seed int, model_type string, embedding_name string, accession string, true_label int, predicted_label int")
    ranked = be.seed_rank(me.binary_metrics_by_model(preds).withColumn("strategy", F.lit("single")))
    table = {(r["model_type"], r["embedding_name"]): r for r in be.seed_aggregate(ranked).collect()}
    # seed 5: RF B 1, LR A 6/7, the other two share third place; seed 6: LR A 1, LR B and RF A 6/7, RF B 8/10
    assert {k: r["rank_sum"] for k, r in table.items()} == {("LR", "A"): 3, ("RF", "B"): 5, ("LR", "B"): 5, ("RF", "A"): 5}
    assert table["LR", "A"]["TP_mean"] == 3.5 and table["LR", "A"]["num_seeds"] == 2
    full = be.append_expected(be.seed_aggregate(ranked), be.expected_combos(*combo_tables(spark)))
    missing = [r for r in full.collect() if r["model_type"] == "SVM"]
    assert len(missing) == 1 and missing[0]["num_seeds"] == 0 and missing[0]["mean_f1"] is None and missing[0]["TP_mean"] == 0


def ranks_of(spark, values):
    df = spark.createDataFrame([(1, f"m{i}", float(v)) for i, v in enumerate(values)], "seed int, model_type string, f1 double")
    rows = be.seed_rank(df.withColumns({"embedding_name": F.lit("v"), "strategy": F.lit("single")})).orderBy("model_type").collect()
    return [r["rank"] for r in rows]


def test_a_tie_is_measured_from_the_leader_of_the_rank(spark):
    assert ranks_of(spark, [0.5, 0.5 - 0.8e-12, 0.5 - 1.6e-12]) == [1, 1, 3]
    assert ranks_of(spark, [0.2, 0.2, 0.2, 0.1, 0.1, 0.3]) == [2, 2, 2, 5, 5, 1]


def test_rank_ties_and_missing(spark):
    rows = [(1, "a", 0.5), (1, "b", 0.5 + 1e-14), (1, "c", 0.4), (1, "d", float("nan")), (1, "e", 0.9)]
    df = spark.createDataFrame(rows, "seed int, model_type string, f1 double").withColumns({"embedding_name": F.lit("v"), "strategy": F.lit("single")})
    assert {r["model_type"]: r["rank"] for r in be.seed_rank(df).collect()} == {"e": 1, "a": 2, "b": 2, "c": 4, "d": None}


def test_weight_records(spark):
    names, scores = ["A::x", "B::y", "C::z"], [[0.9, 0.6, 0.5], [0.8, 0.4, 0.7]]
    weights = [[0.5, 0.3, 0.2], [0.7, 0.1, 0.2]]
    rows = [(7 + i, "base", w, names, dict(zip(names, s))) for i, (w, s) in enumerate(zip(weights, scores))]
    df = spark.createDataFrame(rows, "seed int, ablation string, weights array<double>, models_used array<string>, model_validation_scores map<string,double>")
    per, overall = be.weights_analysis(df)
    got = {r["model"]: (round(r["mean_weight"], 9), round(r["std_weight"], 9)) for r in per.collect()}
    assert got == {"A::x": (0.6, 0.1), "B::y": (0.2, 0.1), "C::z": (0.2, 0.0)}
    want = np.mean([np.corrcoef(s, w)[0, 1] for s, w in zip(scores, weights)])
    assert math.isclose(overall.first()["mean_val_weight_correlation"], want, abs_tol=1e-9)


# -- statistics ------------------------------------------------------------------------------------

def scores_of(spark, lines):
    return st.score_matrix(spark.createDataFrame(
        [(run, name, v) for run, line in enumerate(lines) for name, v in zip("abc", line)], "seed int, model_config string, f1 double"
    ))


def test_friedman_by_hand(spark):
    """Ranks 1 2 3, 1 3 2, 1 2 3, 2 3 1: the statistic is 4 (1.25² + 2.5² + 2.25² - 12) = 3.5, its tail exp(-1.75)."""
    scores = scores_of(spark, [[0.70, 0.64, 0.58], [0.71, 0.60, 0.66], [0.69, 0.68, 0.50], [0.55, 0.52, 0.61]])
    ranks = st.average_ranks(st.rank_matrix(scores))
    assert {r["model_id"]: r["avg_rank"] for r in ranks.collect()} == {"a": 1.25, "b": 2.5, "c": 2.25}
    row = st.friedman(scores).first()
    assert math.isclose(row["statistic"], 3.5) and math.isclose(row["p_value"], math.exp(-1.75), rel_tol=1e-6) and not row["significant"]
    assert st.nemenyi_after_friedman(scores) is None


def test_pairs_after_a_clear_order(spark):
    """Six runs in the same order: 6 (1 + 4 + 9 - 12) = 12, tail exp(-6)."""
    scores = scores_of(spark, [[0.9 - i / 100, 0.8, 0.3 + i / 50] for i in range(6)])
    row = st.friedman(scores).first()
    assert math.isclose(row["statistic"], 12.0) and math.isclose(row["p_value"], math.exp(-6), rel_tol=1e-6) and row["significant"]
    pairs = st.nemenyi_after_friedman(scores).collect()
    assert [(r["model_a"], r["model_b"], r["rank_diff"]) for r in pairs] == [("a", "c", 2), ("a", "b", 1), ("b", "c", 1)]
    assert math.isclose(pairs[0]["critical_difference"], 3.314493 / math.sqrt(2) * math.sqrt(12 / 36), rel_tol=1e-5)


def test_more_models_than_a_block(spark):
    ranks = spark.createDataFrame([(f"m{i:04d}", float(i)) for i in range(1100)], "model_id string, avg_rank double")
    near = st.nemenyi(ranks.where("model_id < 'm0002'"), 4)
    assert near.count() == 1
    blocks = st.PAIR_BLOCK
    st.PAIR_BLOCK = 7
    try:
        few = ranks.where("avg_rank < 20")
        assert st.nemenyi(few, 4).select("model_a", "model_b").distinct().count() == 190
    finally:
        st.PAIR_BLOCK = blocks


def test_friedman_statuses(spark):
    scores = scores_of(spark, [[0.9, 0.8, 0.7], [0.6, 0.7, 0.5], [0.4, 0.3, 0.2]])
    assert st.friedman(scores.where("model_id in ('a', 'b')")).first()["status"] == "insufficient_models_for_friedman"
    assert st.friedman(scores.where("run_id = 1")).first()["status"] == "insufficient_data"
    assert st.complete_runs(scores.where("not (run_id = 2 and model_id = 'b')")).select("run_id").distinct().count() == 2
    tied = scores.withColumn("score", F.lit(0.5))
    assert st.friedman(tied).first()["statistic"] is None
    assert st.nemenyi_after_friedman(tied) is None


# -- fits ------------------------------------------------------------------------------------------

def separable(spark, n=160):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        y = i % 2
        vec = (rng.normal(0, 0.3, 4) + (2.0 if y else -2.0) * np.array([1, 1, 0, 0])).tolist()
        rows.append(("v", f"A{i}", y, "train" if i // 2 % 4 else "val", vec))
    return spark.createDataFrame(rows, "view string, accession string, label int, split string, vec array<double>")


@pytest.mark.parametrize("kind,params", [
    ("LR", {"C": 1.0, "class_weight": "balanced"}), ("RF", {"n_estimators": 5}), ("XGB", {"n_estimators": 3}), ("SVM", {}),
    ("MLP", {"epochs": 50, "custom_layer_config": {"hidden_layers_mode": "custom", "custom_hidden_layers": [4]}}),
    ("KNN-2", {"n_neighbors": 3, "p_metric": {"p": 1}, "weights": "distance"}),
])
def test_separable_data_is_learned(spark, kind, params):
    rows = separable(spark)
    fitted = tr.train_model(rows.where("split = 'train'"), kind, params)
    out = tr.batch_predict(fitted, rows.where("split = 'val'")).collect()
    assert all(r["label"] == r["predicted_label"] for r in out) and all(math.isclose(sum(r["probs"]), 1.0, abs_tol=1e-6) for r in out)


def test_multiclass_one_vs_rest_models(spark):
    rows = separable(spark).withColumn("label", F.when(F.col("vec")[0] > 0, 2).when(F.col("vec")[2] > 0, 1).otherwise(0))
    for kind, params in (("SVM", {"max_iter": 5}), ("GBT", {"n_estimators": 2}), ("KNN", {"n_neighbors": 3})):
        out = tr.batch_predict(tr.train_model(rows, kind, params), rows)
        assert out.where("abs(aggregate(probs, 0D, (a, x) -> a + x) - 1) > 1e-6").count() == 0


def test_forest_keeps_the_rows_nodes_and_is_the_same(spark):
    from pyspark.ml.classification import RandomForestClassifier

    rand = random.Random(4)
    rows = spark.createDataFrame([(x, int(x[0] + x[1] > 0)) for x in ([rand.gauss(0, 1) for _ in range(6)] for _ in range(300))], "vec array<double>, label int")
    fitted = tr.train_rf(rows, {"n_estimators": 4})
    assert fitted.model.getCacheNodeIds()
    plain = RandomForestClassifier(seed=42, featuresCol="_features", labelCol="_label", numTrees=4, maxDepth=30).fit(tr._ready(rows, [0, 1], "label"))
    same = [m.toDebugString.split("\n", 1)[1] for m in (fitted.model, plain)]
    assert same[0] == same[1] and fitted.model.totalNumNodes > 20


def test_matrix_sweep_and_retrain(spark):
    rows = separable(spark).withColumn("split", F.when(F.col("accession") < "A12", "test").otherwise(F.col("split")))
    table, models = tr.train_matrix(rows, ["LR", "RF"], {"RF": {"n_estimators": 3}}, normalization="l2", evaluate_test=True)
    assert set(models) == {("LR", "v"), ("RF", "v")}
    assert {r["value"] for r in table.where("metric = 'f1'").collect()} == {1.0}
    trials, best = tr.sweep_run(rows, "LR", {"C": {"min": 0.1, "max": 10.0}}, 2)
    assert best["trial"] == 0 and trials.select("trial").distinct().count() == 2
    again, _ = tr.final_retrain(rows, {"v": ("LR", {})})
    assert {r["split"] for r in again.collect()} == {"test", "refit_train_val"}


def test_settings_are_mapped_or_refused(spark):
    for kind, params in (("LR", {"gamma": 1}), ("RF", {"class_weight": "heavy"}), ("SVM", {"kernel_config": {"kernel": "rbf"}}), ("KNN", {"p": 3}), ("OTHER", {})):
        with pytest.raises(ValueError):
            tr.train_model(separable(spark, 8), kind, params)
    flat = tr.flat_params("RF", {"bootstrap_config": {"bootstrap": True, "max_samples": 0.5}, "criterion": "log_loss", "max_features": "sqrt", "n_jobs": 4})
    assert tr._mapped(flat, tr.RF_PARAMS) == {"bootstrap": True, "subsamplingRate": 0.5, "impurity": "entropy", "featureSubsetStrategy": "sqrt"}


def test_penalty_is_that_of_one_over_c_n(spark):
    """At the optimum the gradient of mean loss plus w² / (2 C n) vanishes; half the penalty would leave it large."""
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (60, 3)) * [1, 5, 0.2]
    y = (x @ [1.0, 0.2, -2.0] + rng.normal(0, 1, 60) > 0).astype(int)
    df = spark.createDataFrame([(f"a{i}", int(t), v.tolist()) for i, (t, v) in enumerate(zip(y, x))], "accession string, label int, vec array<double>")
    model = tr.train_lr(df, {"tol": 1e-10, "C": 0.5}).model
    w, b = model.coefficients.toArray(), model.intercept
    error = 1 / (1 + np.exp(-(x @ w + b))) - y
    gradient = error @ x / 60 + w / (0.5 * 60)
    assert np.abs(gradient).max() < 1e-5 and abs(error.sum()) < 1e-3
    assert np.abs(error @ x / 60 + w / (1.0 * 60)).max() > 1e-3


@pytest.mark.parametrize("classes", [2, 3])
def test_fits_together_meet_the_optimum_of_each(spark, classes, monkeypatch):
    """The gradient of every trial's own penalized loss vanishes, also where passes are added up in two levels."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (150, 3)) * [1, 8, 0.2]
    y = np.digitize(x @ [1.0, 0.1, -2.0] + rng.normal(0, 1, 150), [0.0] if classes == 2 else [-0.8, 0.8])
    rows = spark.createDataFrame([([int(t)], v.tolist()) for t, v in zip(y, x)], "target array<int>, vec array<double>").repartition(5)
    monkeypatch.setattr(li, "MOST_PARTIALS", 2)
    monkeypatch.setattr(li, "BLOCK_BYTES", 24 * 11)
    tasks = [li.Linear(c, mix, balanced, 200, 1e-7) for c in (0.05, 5.0) for mix, balanced in ((0.0, False), (0.0, True), (1.0, False))]
    one_hot = np.eye(classes)[y]
    counts = one_hot.sum(axis=0)
    for task, model in zip(tasks, li.fit_linear(rows, tasks, classes)):
        w = (150 / (classes * counts))[y] if task.balanced else np.ones(150)
        p = li._probabilities(x @ model.weights.T + model.bias)
        error = ((p - one_hot) * w[:, None])[:, 1:] if classes == 2 else (p - one_hot) * w[:, None]
        gradient = error.T @ x / w.sum()
        penalty = 1 / (task.C * 150)
        assert np.abs(error.sum(axis=0)).max() / w.sum() < 1e-5
        if task.l1_ratio == 0:
            assert np.abs(gradient + penalty * model.weights).max() < 1e-5
        else:  # a weight at zero may have any slope up to the penalty
            at = model.weights != 0
            assert np.abs(gradient[at] + penalty * np.sign(model.weights[at])).max(initial=0) < 1e-4 and np.abs(gradient[~at]).max(initial=0) <= penalty + 1e-5


def test_linear_sweep_takes_the_passes_of_its_slowest_trial(spark, monkeypatch):
    passes, original = [], li._summed
    monkeypatch.setattr(li, "_summed", lambda *a: passes.append(1) or original(*a))
    space = {"C": {"min": 0.1, "max": 10.0}, "class_weight": {"values": [None, "balanced"]}, "solver": {"values": ["liblinear", "lbfgs"]}}
    trials, best = tr.sweep_run(separable(spark), "LR", space, 8)
    assert trials.select("trial").distinct().count() == 8 and best["value"] == 1.0 and {r["dropped"] for r in trials.collect()} == {""}
    together = len(passes)
    passes.clear()
    for p in tr.trial_params(sw.sweep_trials(spark, space, 3)):
        tr.one_vs_rest(separable(spark).withColumn("labels", F.array("label")), "LR", [1], p)
    assert together < len(passes)


def test_settings_of_the_sweep_spaces(spark):
    """Every choice of the shipped spaces fits, or is named as dropped."""
    spaces = {
        "RF": {"criterion": {"values": ["gini", "entropy", "log_loss"]}, "min_samples_split": {"values": [2, 5, 10]}, "min_samples_leaf": {"values": [1, 5, 10]}, "max_features": {"values": ["sqrt", "log2", None]},
               "class_weight": {"values": [None, "balanced", "balanced_subsample"]}, "bootstrap_config": {"values": [{"bootstrap": True, "max_samples": 0.6}, {"bootstrap": False}]}},
        "SVM": {"kernel_config": {"values": [{"kernel": "linear"}]}, "C": {"min": 0.001, "max": 100.0}, "shrinking": {"values": [True, False]}, "tol": {"min": 1e-5, "max": 1e-2},
                "cache_size": {"values": [200, 500]}, "class_weight": {"values": [None, "balanced"]}, "max_iter": {"values": [-1, 1000]}},
        "MLP": {"hidden_layers_mode": {"values": ["quadratic_increase", "custom"]}, "num_hidden_layers": {"min": 1, "max": 5, "distribution": "int_uniform"},
                "custom_layer_config": {"values": [{"custom_hidden_layers": [128, 64], "num_hidden_layers": 2}]}, "dropout_rate": {"min": 0.0, "max": 0.5}, "activation_function": {"values": ["ReLU", "GELU"]},
                "use_batch_norm": {"values": [True, False]}, "output_activation": {"values": [None, "Tanh"]}, "initialization": {"values": [None, "xavier"]}, "optimizer_group": {"values": ["adaptive"]},
                "optimizer_name": {"values": ["Adam", "SGD"]}, "learning_rate": {"min": 1e-5, "max": 1e-2, "distribution": "log_uniform"}, "num_epochs": {"values": [100, 200]},
                "early_stopping_patience": {"values": [5, 10]}, "criterion_name": {"values": ["CrossEntropyLoss", "BCEWithLogitsLoss"]}, "batch_size": {"values": [32, 64]}},
    }
    for kind, space in spaces.items():
        for p in tr.trial_params(sw.sweep_trials(spark, space, 20)):
            flat, lost = tr.flat_params(kind, p), tr.dropped_settings(kind, p)
            if kind == "RF":
                assert lost == sorted((["class_weight"] if p["class_weight"] == "balanced_subsample" else []) + (["min_samples_split"] if p["min_samples_split"] != 2 else []))
            elif kind == "SVM":
                assert not lost and flat["max_iter"] in (2 ** 31 - 1, 1000)
            else:
                assert "learning_rate" in lost and "activation_function" in lost and tr.hidden_layers(flat, 64)[-1] in (64, 32)
        trials, _ = tr.sweep_run(separable(spark, 40), kind, {**space, **({"n_estimators": {"values": [3]}} if kind == "RF" else {})}, 2)
        assert trials.select("trial").distinct().count() == 2


def test_threshold_is_inclusive_and_looked_up(spark):
    rows = spark.createDataFrame([("t1", 0, [0.0]), ("t2", 1, [2.0])], "accession string, label int, vec array<double>")
    fitted = tr.train_model(rows, "KNN", {"n_neighbors": 2})
    query = spark.createDataFrame([("q", [1.0])], "accession string, vec array<double>")
    assert tr.batch_predict(fitted, query).first()["predicted_label"] == 1  # exactly one half
    assert tr.batch_predict(fitted, query, 0.6).first()["predicted_label"] == 0
    given = {"KNN::v": 0.9, "KNN": 0.7, "default": 0.4}
    assert [tr._threshold(given, *k) for k in (("KNN", "v"), ("KNN", "w"), ("LR", "v"))] == [0.9, 0.7, 0.4] and tr._threshold(None, "LR", "v") == 0.5


def test_grid_of_array_labels(spark):
    rows = separable(spark).withColumn("labels", F.array_compact(F.array(F.when(F.col("label") == 1, "a"), F.when(F.col("label") == 0, "b"))))
    table, models = tr.train_matrix(rows, ["LR", "KNN"], label="labels")
    assert list(models["LR", "v"]) == ["a", "b"]
    assert {(r["model_type"], r["metric"]): r["value"] for r in table.collect()} == {(k, m): 1.0 for k in ("LR", "KNN") for m in ("precision", "recall", "f1", "micro_f1")}


def test_only_the_owner_drops_a_cache(spark):
    rows = separable(spark).persist()
    tr.sweep_run(rows, "LR", {"C": {"min": 0.1, "max": 1.0}}, 2)
    assert rows.is_cached and rows.storageLevel.useMemory
    rows.unpersist()


def test_averages_over_classes(spark):
    rows = separable(spark).withColumn("label", F.when(F.col("accession") < "A13", 2).otherwise(F.col("label")))
    macro, _ = tr.train_matrix(rows, ["LR"])
    weighted, _ = tr.train_matrix(rows, ["LR"], metrics_average="weighted")
    pick = lambda t, m: t.where(f"metric = '{m}'").first()["value"]
    assert pick(macro, "accuracy") == pick(weighted, "accuracy") and pick(macro, "f1") != pick(weighted, "f1")
    with pytest.raises(ValueError):
        tr.train_matrix(rows, ["LR"], metrics_average="other")


def test_trial_values_stay_in_range(spark):
    space = {"k": {"min": 2, "max": 4, "distribution": "int_uniform"}, "c": {"min": 0.1, "max": 10.0, "distribution": "log_uniform"}, "s": {"values": ["a", "b"]}}
    params = sw.trial_params(sw.sweep_trials(spark, space, 50))
    assert {p["k"] for p in params} == {2, 3, 4} and {p["s"] for p in params} == {"a", "b"} and all(0.1 <= p["c"] <= 10 for p in params)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_neighbours_agree_with_brute_force(spark, metric):
    rng = np.random.default_rng(2)
    # one dense clump holds a third of the training rows
    train = np.vstack([rng.normal(0, 1, (200, 5)), rng.normal(4, 0.01, (100, 5))])
    query = np.vstack([rng.normal(0, 1, (30, 5)), rng.normal(4, 0.01, (10, 5))])
    t = spark.createDataFrame([(f"t{i:03d}", str(i % 3), v.tolist()) for i, v in enumerate(train)], "accession string, label string, vec array<double>")
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(query)], "accession string, vec array<double>")
    want = set()
    for i, v in enumerate(query):
        d = np.abs(train - v).sum(1) if metric == "manhattan" else np.sqrt(((train - v) ** 2).sum(1))
        want |= {(f"q{i}", f"t{j:03d}") for j in np.argsort(d, kind="stable")[:4]}
    for bounds in ({}, {"pivots": 8, "block_rows": 20}, {"pivots": 1, "block_rows": 7}):
        got = nb.nearest_neighbours(t, q, 4, metric, **bounds)
        assert {(r["accession"], r["neighbour"]) for r in got.collect()} == want


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_two_phases_compare_few_pairs(spark, metric):
    """Clusters in 32 dimensions: the first phase's bound leaves a small part of all pairs for whole comparisons."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 3, (12, 32))
    train, query = (centres[rng.integers(0, 12, n)] + rng.normal(0, 0.5, (n, 32)) for n in (900, 60))
    t = spark.createDataFrame([(f"t{i:03d}", "x", v.tolist()) for i, v in enumerate(train)], "accession string, label string, vec array<double>")
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(query)], "accession string, vec array<double>")
    seen = spark.sparkContext.accumulator(0)
    got = {(r["accession"], r["neighbour"]) for r in nb.nearest_neighbours(t, q, 5, metric, pivots=32, block_rows=100, compared=seen).collect()}
    d = [(np.abs(train - v).sum(1) if metric == "manhattan" else ((train - v) ** 2).sum(1)) for v in query]
    assert got == {(f"q{i}", f"t{j:03d}") for i, row in enumerate(d) for j in np.argsort(row, kind="stable")[:5]}
    assert 0 < seen.value < 900 * 60 / 4


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_small_blocks_make_few_copies_and_one_search(spark, metric):
    """Rows without clusters: blocks of 8 rows don't copy the queries once a block, and the result is there before it is read."""
    rng = np.random.default_rng(9)
    train, query = rng.normal(0, 1, (1500, 12)).astype(np.float32), rng.normal(0, 1, (150, 12)).astype(np.float32)
    train[7] = 1e6  # one value far off makes counted steps no wrong bound
    t = spark.createDataFrame([(f"t{i:04d}", "x", v.tolist()) for i, v in enumerate(train)], "accession string, label string, vec array<float>")
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(query)], "accession string, vec array<float>")
    groups = spark.sparkContext.accumulator(0)
    near = nb.nearest_neighbours(t, q, 3, metric, pivots=4, block_rows=8, compared=SimpleNamespace(add=lambda n: groups.add(1)))
    wide = train.astype(float)
    d = [(np.abs(wide - v).sum(1) if metric == "manhattan" else np.sqrt(((wide - v) ** 2).sum(1))) for v in query.astype(float)]
    want = {(f"q{i}", f"t{j:04d}"): row[j] for i, row in enumerate(d) for j in np.argsort(row, kind="stable")[:3]}
    got = {(r["accession"], r["neighbour"]): r["distance"] for r in near.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    assert 0 < groups.value <= 150 and "CoGroup" not in near._jdf.queryExecution().toString()


def test_bins_hold_all_pieces_of_their_cells():
    assert nb._cut(500_000, 100_000, 65_536, 12) == (8, 2) and nb._cut(5, 0, 10, 12) == (5, 3)
    of = nb._bins({0: 10, 3: 1, 5: 95, 9: 4}, 4)
    assert list(of) == [0, 3, 5, 9] and len(of[5]) == 4 and len(set(of[5])) >= 3 and max(x for at in of.values() for x in at) <= 5


def test_distance_weights_with_exact_hits(spark):
    t = spark.createDataFrame([("a", "x", [0.0]), ("b", "y", [1.0]), ("c", "y", [2.0])], "accession string, label string, vec array<double>")
    q = spark.createDataFrame([("q", [0.0])], "accession string, vec array<double>")
    assert [(r["label"], r["prob"]) for r in nb.train_knn(t, q, 3, weights="distance").collect()] == [("x", 1.0)]


# -- explanations ----------------------------------------------------------------------------------

def test_importance_finds_the_informative_features(spark):
    rows = separable(spark)
    for kind, params in (("LR", {}), ("RF", {"n_estimators": 5})):
        fitted = tr.train_model(rows, kind, params)
        top = {r["feature"] for r in ex.top_features(ex.importance_auto(fitted, rows), 2).collect()}
        assert top & {0, 1}
    drops = {r["feature"]: r["importance"] for r in ex.importance_permutation(tr.train_lr(rows), rows, n_repeats=2).collect()}
    assert set(drops) == {0, 1, 2, 3} and max(abs(drops[2]), abs(drops[3])) <= 0.05


@pytest.mark.parametrize("kind", ["LR", "SVM", "LR3"])
def test_margin_deltas_equal_scored_copies(spark, monkeypatch, kind):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (90, 3))
    y = np.digitize(x @ [1.0, -1.0, 0.2] + rng.normal(0, 0.5, 90), [0.0] if kind != "LR3" else [-0.7, 0.7])
    rows = spark.createDataFrame([(f"a{i:02d}", int(t), v.tolist()) for i, (t, v) in enumerate(zip(y, x))], "accession string, label int, vec array<double>")
    fitted = tr.train_model(rows, kind[:3].rstrip("3"), {"max_iter": 20})
    scored = ex.importance_permutation(fitted, rows, n_repeats=2)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    quick = {r["feature"]: (round(r["importance"], 9), round(r["std"], 9)) for r in scored.collect()}
    monkeypatch.setattr(ex, "_margins", lambda fitted: None)
    slow = {r["feature"]: (round(r["importance"], 9), round(r["std"], 9)) for r in ex.importance_permutation(fitted, rows, n_repeats=2).collect()}
    assert quick == slow and len(quick) == 3 and "lambdafunction(CASE WHEN (lambda i" not in plan


def test_many_trials_do_not_grow_the_plan(spark):
    probs = spark.createDataFrame([(m, f"s{i}", [1 - p, p], i % 2) for i in range(12) for m, p in (("a", 0.9 if i % 2 else 0.2), ("b", 0.5), ("c", i / 12))],
                                  "model_id string, accession string, probs array<double>, y int")
    sizes = []
    for n in (64, 10_000):
        found = en.weights_random_search(probs, ["a", "b", "c"], "binary", 2, n, 0.05)
        sizes.append(len(found._jdf.queryExecution().analyzed().toString()))
    assert abs(sizes[0] - sizes[1]) < 200 and len(found.collect()) == 3


def test_integrated_saliency_sums_to_the_difference(spark):
    w, b = [0.4, -0.3, 0.2], 0.1
    df = spark.createDataFrame([("a", [1.0, 2.0, -1.0])], "accession string, vec array<double>")
    total = sum(ex.saliency_integrated(df, w, b, steps=400).first()["saliency"])
    p = lambda z: 1 / (1 + math.exp(-z))
    assert math.isclose(total, p(0.4 - 0.6 - 0.2 + b) - p(b), abs_tol=1e-5)


def test_scoring_a_stream(spark, tmp_path):
    rows = separable(spark, 40)
    fitted = tr.train_lr(rows)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    score_stream(fitted, stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
