"""Roles of the test tables, as DataFrames and as the same CTEs in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.hashing import unit
from pairloom.operators.metrics import binary_metrics_by_model, binary_metrics_by_strategy

# Synthetic models (name, share of the true label in the score), views and seeds.
MODELS = (("LR", 0.30), ("RF", 0.25), ("GBT", 0.10))
VIEWS = ("V1", "V2")
SEEDS = (42, 43, 44)
LANGUAGE_ALIASES = {"english": ["en"], "french": ["fr"], "german": ["de"], "spanish": ["es"]}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, without negative zeros."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), digits) + 0.0).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def u_sql(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE)"


def _explode(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


# -- proteins: documents, their language standing for the organism ---------------------------------

def proteins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("accession"), F.col("lang").alias("organism"))


PROTEINS = "proteins AS (SELECT doc_id::VARCHAR AS accession, lang AS organism FROM documents)"


def label_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Labels, plus rows of accessions that are no proteins."""
    rows = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("accession"), F.col("quality").cast("string").alias("label"),
        F.col("doc_id").alias("row_order"),
    )
    unknown = rows.where("label = '1'").select(F.concat(F.lit("X"), "accession").alias("accession"), "label", "row_order")
    return rows.unionByName(unknown)


LABEL_ROWS = """label_rows AS (
  SELECT doc_id::VARCHAR AS accession, quality::VARCHAR AS label, doc_id AS row_order FROM labels
  UNION ALL SELECT 'X' || doc_id, quality::VARCHAR, doc_id FROM labels WHERE quality = 1)"""


# -- binary predictions of several models, views and seeds -----------------------------------------

def preds(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("accession"), F.col("quality").cast("long").alias("true_label")
    )
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model_type"), F.lit(w).alias("w")) for m, w in MODELS]))
    rows = _explode(_explode(base.select("*", models.alias("_m")).select("*", "_m.*").drop("_m"), "embedding_name", VIEWS), "seed", SEEDS)
    u = unit(F.md5(F.concat_ws("|", "model_type", "embedding_name", F.col("seed").cast("string"), "accession")))
    score = F.round(u * (1.0 - F.col("w")) + F.col("w") * F.col("true_label"), 3)
    head = F.substring(F.md5(F.concat(F.lit("split:"), "accession")), 1, 1)
    return rows.withColumn("score", score).select(
        "seed", "model_type", "embedding_name", F.concat_ws("::", "model_type", "embedding_name").alias("model_id"),
        "accession", F.when(head < "8", "validation").otherwise("test").alias("split"), "true_label", "score",
        (F.col("score") >= 0.5).cast("long").alias("predicted_label"),
    )


_MODEL_VALUES = ", ".join(f"('{m}', {w}::DOUBLE)" for m, w in MODELS)
_VIEW_VALUES = ", ".join(f"('{v}')" for v in VIEWS)
_SEED_VALUES = ", ".join(f"({s})" for s in SEEDS)
PREDS = f"""scored AS (
  SELECT seed, model_type, embedding_name, doc_id::VARCHAR AS accession, quality::BIGINT AS true_label,
    round({u_sql("concat_ws('|', model_type, embedding_name, seed::VARCHAR, doc_id::VARCHAR)")} * (1.0::DOUBLE - w) + w * quality, 3) AS score
  FROM labels, (VALUES {_MODEL_VALUES}) m(model_type, w), (VALUES {_VIEW_VALUES}) v(embedding_name), (VALUES {_SEED_VALUES}) s(seed)),
preds AS (
  SELECT seed, model_type, embedding_name, model_type || '::' || embedding_name AS model_id, accession,
    CASE WHEN substr(md5('split:' || accession), 1, 1) < '8' THEN 'validation' ELSE 'test' END AS split,
    true_label, score, (score >= 0.5)::BIGINT AS predicted_label FROM scored)"""


def binary_sql(keys: str, source: str, truth: str = "true_label", pred: str = "predicted_label") -> str:
    """Counts and metrics of 0/1 labels, as a subquery body."""
    return f"""SELECT *, (TP + TN)::DOUBLE / (TP + TN + FP + FN) AS accuracy,
    CASE WHEN TP + FP = 0 THEN 0.0::DOUBLE ELSE TP::DOUBLE / (TP + FP) END AS "precision",
    CASE WHEN TP + FN = 0 THEN 0.0::DOUBLE ELSE TP::DOUBLE / (TP + FN) END AS recall,
    CASE WHEN 2 * TP + FP + FN = 0 THEN 0.0::DOUBLE ELSE (2 * TP)::DOUBLE / (2 * TP + FP + FN) END AS f1
  FROM (SELECT {keys}, count(*) FILTER (WHERE {truth} = 1 AND {pred} = 1)::BIGINT AS TP,
    count(*) FILTER (WHERE {truth} = 0 AND {pred} = 0)::BIGINT AS TN,
    count(*) FILTER (WHERE {truth} = 0 AND {pred} = 1)::BIGINT AS FP,
    count(*) FILTER (WHERE {truth} = 1 AND {pred} = 0)::BIGINT AS FN FROM {source} GROUP BY {keys})"""


BINARY_ROUNDED = ('TP, TN, FP, FN, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", '
                  "round(recall, 6) AS recall, round(f1, 6) AS f1")


# -- ensemble predictions of the same samples ------------------------------------------------------

def ensemble_preds(spark: SparkSession, sf: str) -> DataFrame:
    per = preds(spark, sf).groupBy("seed", "accession").agg(
        F.min("true_label").alias("true_label"), F.avg("score").alias("m"), F.sum("predicted_label").alias("v"),
        F.max("score").alias("x"), F.count(F.lit(1)).alias("n"),
    )
    options = F.array(
        F.struct(F.lit("uniform_soft_voting").alias("strategy"), (F.round("m", 9) >= 0.5).cast("long").alias("predicted_label")),
        F.struct(F.lit("majority_global").alias("strategy"), (2 * F.col("v") > F.col("n")).cast("long").alias("predicted_label")),
        F.struct(F.lit("trainable_weights_soft_voting").alias("strategy"), (F.col("x") >= 0.8).cast("long").alias("predicted_label")),
    )
    return per.select("seed", "accession", "true_label", F.explode(options).alias("_o")).select(
        "seed", "accession", "true_label", "_o.*"
    )


ENSEMBLE_PREDS = """per AS (SELECT seed, accession, min(true_label) AS true_label, avg(score) AS m, sum(predicted_label) AS v,
    max(score) AS x, count(*) AS n FROM preds GROUP BY seed, accession),
ensemble_preds AS (
  SELECT seed, accession, true_label, 'uniform_soft_voting' AS strategy, (round(m, 9) >= 0.5)::BIGINT AS predicted_label FROM per
  UNION ALL SELECT seed, accession, true_label, 'majority_global', (2 * v > n)::BIGINT FROM per
  UNION ALL SELECT seed, accession, true_label, 'trainable_weights_soft_voting', (x >= 0.8)::BIGINT FROM per)"""


# -- metric rows per seed --------------------------------------------------------------------------

def seed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Single-model rows on the test split."""
    test = preds(spark, sf).where("split = 'test'")
    return binary_metrics_by_model(test).withColumn("strategy", F.lit("single"))


def ensemble_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = binary_metrics_by_strategy(ensemble_preds(spark, sf))
    return rows.withColumn("model_type", F.lit("Ensemble")).withColumn("embedding_name", F.lit("all"))


SEED_ROWS = f"""{PREDS},
seed_rows AS (SELECT *, 'single' AS strategy FROM (
  {binary_sql("seed, model_type, embedding_name", "(SELECT * FROM preds WHERE split = 'test')")}))"""
ENSEMBLE_ROWS = f"""{PREDS}, {ENSEMBLE_PREDS},
ensemble_rows AS (SELECT *, 'Ensemble' AS model_type, 'all' AS embedding_name FROM ({binary_sql("seed, strategy", "ensemble_preds")}))"""


# -- multiclass probabilities over the embedding table ---------------------------------------------

CLASSES = ("c0", "c1", "c2")
MC_MODELS = ("A::V1", "A::V2", "B::V1")


def class_probs(spark: SparkSession, sf: str) -> DataFrame:
    """(model_id, accession, y, probs): three classes, the true one favoured."""
    base = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("accession"), (F.col("label") % 3).cast("int").alias("y")
    )
    rows = _explode(base, "model_id", MC_MODELS)

    def raw(i: int):
        return unit(F.md5(F.concat_ws("|", "model_id", "accession", F.lit(str(i))))) + F.when(F.col("y") == i, 0.25).otherwise(0.0)

    total = raw(0) + raw(1) + raw(2)
    halves = F.split("model_id", "::")
    return rows.select(
        "model_id", halves[0].alias("model_type"), halves[1].alias("embedding_name"), "accession", "y",
        F.array(*[raw(i) / total for i in range(3)]).alias("probs"),
    )


def _raw_sql(i: int) -> str:
    return f"({u_sql(f'''model_id || '|' || accession || '|{i}' ''')} + CASE WHEN y = {i} THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END)"


CLASS_PROBS = f"""class_raw AS (SELECT *, {_raw_sql(0)} AS r0, {_raw_sql(1)} AS r1, {_raw_sql(2)} AS r2 FROM (
    SELECT model_id, vec_id::VARCHAR AS accession, (label % 3)::INTEGER AS y
    FROM embeddings, (VALUES {", ".join(f"('{m}')" for m in MC_MODELS)}) m(model_id))),
class_probs AS (SELECT model_id, split_part(model_id, '::', 1) AS model_type, split_part(model_id, '::', 2) AS embedding_name,
    accession, y, r0 / (r0 + r1 + r2) AS p0, r1 / (r0 + r1 + r2) AS p1, r2 / (r0 + r1 + r2) AS p2 FROM class_raw)"""


# -- vectors and layers ----------------------------------------------------------------------------

def layers(spark: SparkSession, sf: str) -> DataFrame:
    """Four 16-wide layers per vector; model M1 only has layer 0."""
    base = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("accession"), "embedding")
    parts = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(i).alias("layer_index"), F.slice("embedding", 16 * i + 1, 16).alias("vec"))
        for m, i in (("M0", 0), ("M0", 1), ("M0", 2), ("M0", 3), ("M1", 0))
    ]))
    return base.select("accession", parts.alias("_p")).select("accession", "_p.*")


LAYERS = """layers AS (SELECT m AS model, vec_id::VARCHAR AS accession, i AS layer_index,
    embedding[16 * i + 1 : 16 * i + 16]::DOUBLE[] AS vec
  FROM embeddings, (VALUES ('M0', 0), ('M0', 1), ('M0', 2), ('M0', 3), ('M1', 0)) l(m, i)),
layer_cells AS (SELECT model, accession, layer_index, generate_subscripts(vec, 1) AS pos, unnest(vec) AS x FROM layers)"""


def features(spark: SparkSession, sf: str, view: str = "V") -> DataFrame:
    """(view, accession, label, split, vec) of the embedding table: label % 2, md5 split."""
    head = F.substring(F.md5(F.concat(F.lit("split:"), F.col("vec_id").cast("string"))), 1, 1)
    return table(spark, sf, "embeddings").select(
        F.lit(view).alias("view"), F.col("vec_id").cast("string").alias("accession"), (F.col("label") % 2).cast("int").alias("label"),
        F.when(head < "a", "train").when(head < "d", "val").otherwise("test").alias("split"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


FEATURES = """features AS (SELECT vec_id::VARCHAR AS accession, (label % 2)::INTEGER AS label,
    CASE WHEN substr(md5('split:' || vec_id), 1, 1) < 'a' THEN 'train' WHEN substr(md5('split:' || vec_id), 1, 1) < 'd' THEN 'val' ELSE 'test' END AS split,
    embedding::DOUBLE[] AS vec FROM embeddings)"""


def cells(df: DataFrame, *keys: str, col: str = "vec", digits: int = 6) -> DataFrame:
    """Vector elements as rows, for comparison."""
    return r6(df.select(*keys, F.posexplode(F.col(col).cast("array<double>")).alias("pos", "x")), digits).withColumn(
        "pos", F.col("pos").cast("long")
    )


# -- universe: suppliers and the parts they supplied -----------------------------------------------

def universe_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Long universe: target = supplier, candidates = its parts in key order, organism = nation."""
    pairs = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    nations = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey").join(
        table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey"
    ).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("organism"))
    return pairs.join(nations, "l_suppkey").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("candidate_id"),
        F.col("l_suppkey").alias("source_row_id"), "organism", F.col("l_partkey").alias("pos"),
    )


UNIVERSE = """universe AS (SELECT 'S' || l_suppkey AS target_id, 'P' || l_partkey AS candidate_id, l_suppkey AS source_row_id,
    n_name AS organism, l_partkey AS pos
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation ON n_nationkey = s_nationkey)"""


# -- text universe: documents, their words standing for candidates ---------------------------------

def text_universe(spark: SparkSession, sf: str) -> DataFrame:
    """Raw text rows with a blank target for some documents."""
    doc = F.col("doc_id").cast("string")
    return table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 50 == 7, " ").otherwise(doc).alias("target_id"),
        F.regexp_replace("text", r"[\s;]+", ";").alias("candidate_ids"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("lang")).alias("target_label"),
        F.col("lang").alias("organism"), F.concat(F.col("source"), F.lit(" ")).alias("batch"),
    )


TEXT_UNIVERSE = r"""text_universe AS (
  SELECT doc_id::VARCHAR AS target_id, CASE WHEN doc_id % 3 = 0 THEN 'positive' ELSE lang END AS target_label, lang AS organism,
    [x FOR x IN string_split(regexp_replace("text", '[\s;]+', ';', 'g'), ';') IF x <> ''] AS candidate_ids, source AS batch
  FROM documents WHERE doc_id % 50 <> 7)"""
