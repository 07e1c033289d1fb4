"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import quality as q
from pairloom.plans import query
from pairloom.plans.fixtures import CLASS_PROBS, PREDS, PROTEINS, SEED_ROWS, class_probs, longs, preds, proteins, r6, seed_rows, table
from pairloom.operators.benchmark import expected_combos
from pairloom.operators.splits import split_random


@query("dq_required_columns", "SELECT true AS ok, false AS missing_ok, count(*) AS n_rows FROM orders")
def _required(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return orders.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(q.dq_required_columns(orders, ["o_orderkey", "o_custkey"])).alias("ok"),
        F.lit(q.dq_required_columns(orders, ["o_orderkey", "absent"])).alias("missing_ok"), "n_rows",
    )


@query("dq_types", "SELECT true AS ok, false AS wrong_ok, count(*) AS n_rows FROM orders")
def _types(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return orders.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(q.dq_types(orders, {"o_orderkey": "int", "o_totalprice": "float", "absent": "str"})).alias("ok"),
        F.lit(q.dq_types(orders, {"o_orderkey": "str"})).alias("wrong_ok"), "n_rows",
    )


@query("dq_null_proportion", """SELECT 'null_proportion' AS "check", observed <= 0.5 AS ok, round(observed, 6) AS observed FROM (
  SELECT (count(*) FILTER (WHERE l.doc_id IS NULL) * 2)::DOUBLE / (count(*) * 3) AS observed
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def _nulls(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return r6(q.dq_null_proportion(joined, 0.5))


@query("dq_range", """SELECT 'range' AS "check", count(*) FILTER (WHERE l_quantity < 1 OR l_quantity > 40) = 0 AS ok,
  count(*) FILTER (WHERE l_quantity < 1 OR l_quantity > 40)::DOUBLE AS observed FROM lineitem""")
def _range(spark: SparkSession, sf: str) -> DataFrame:
    return q.dq_range(table(spark, sf, "lineitem"), "l_quantity", 1, 40)


@query("dq_unique", """SELECT 'unique' AS "check", count(*) = count(DISTINCT l_partkey) AS ok,
  (count(*) - count(DISTINCT l_partkey))::DOUBLE AS observed FROM lineitem""")
def _unique(spark: SparkSession, sf: str) -> DataFrame:
    return q.dq_unique(table(spark, sf, "lineitem"), "l_partkey")


@query("dq_report", """SELECT 'null_proportion' AS "check", '' AS "column", true AS ok, 0.0::DOUBLE AS observed
  UNION ALL SELECT 'range', 'l_discount', count(*) FILTER (WHERE l_discount > 0.05) = 0, count(*) FILTER (WHERE l_discount > 0.05)::DOUBLE FROM lineitem
  UNION ALL SELECT 'range', 'absent', false, NULL
  UNION ALL SELECT 'unique', 'l_orderkey', count(*) = count(DISTINCT l_orderkey), (count(*) - count(DISTINCT l_orderkey))::DOUBLE FROM lineitem
  UNION ALL SELECT 'required_columns', '', true, NULL
  UNION ALL SELECT 'types', '', false, NULL""")
def _report(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_discount", "l_returnflag")
    spec = q.TableSpec(
        required_columns=["l_orderkey"], types={"l_discount": "int"}, unique=["l_orderkey"],
        ranges={"l_discount": (None, 0.05), "absent": (0, 1)},
    )
    return r6(q.dq_report(lines, spec))


@query("universe_validate", """WITH rows AS (SELECT CASE WHEN doc_id % 50 = 7 THEN '' ELSE (doc_id % 900)::VARCHAR END AS target_id,
    CASE WHEN n_chars % 10 = 3 THEN 0 ELSE 1 END AS n FROM documents)
  SELECT target_id, 'empty target_id' AS error FROM rows WHERE target_id = ''
  UNION ALL SELECT target_id, 'no candidates' FROM rows WHERE n = 0
  UNION ALL SELECT target_id, 'duplicate target_id' FROM rows WHERE target_id <> '' GROUP BY target_id HAVING count(*) > 1""")
def _universe(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 50 == 7, "").otherwise((F.col("doc_id") % 900).cast("string")).alias("target_id"),
        F.when(F.col("n_chars") % 10 == 3, F.array().cast("array<string>")).otherwise(F.array("source")).alias("candidate_ids"),
    )
    return q.universe_validate(rows)


@query("vectors_validate", """WITH v AS (SELECT vec_id % 400 AS accession, CASE WHEN vec_id % 7 = 0 THEN 32 ELSE 64 END AS w FROM embeddings)
  SELECT 'duplicate accession' AS error, count(*)::BIGINT AS n FROM (SELECT accession FROM v GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
  UNION ALL SELECT 'unequal vector length', (max(w) - min(w))::BIGINT FROM v HAVING max(w) > min(w)
  UNION ALL SELECT 'row count', count(*)::BIGINT FROM v HAVING count(*) <> 123""")
def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 400).alias("accession"),
        F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("vec"),
    )
    return q.vectors_validate(rows, 123)


@query("split_leakage_check", f"""WITH {PROTEINS}, placed AS (
    SELECT accession, 'train' AS split FROM proteins WHERE accession::BIGINT % 10 < 8
    UNION ALL SELECT accession, 'test' FROM proteins WHERE accession::BIGINT % 10 IN (7, 8)
    UNION ALL SELECT 'Y' || accession, 'test' FROM proteins WHERE accession::BIGINT % 100 = 0)
  SELECT CASE WHEN n > 1 THEN 'overlap' WHEN p.accession IS NULL THEN 'missing' ELSE 'extra' END AS kind,
    coalesce(p.accession, a.accession) AS accession
  FROM (SELECT accession, count(DISTINCT split) AS n FROM placed GROUP BY accession) p
  FULL JOIN proteins a ON a.accession = p.accession WHERE n > 1 OR p.accession IS NULL OR a.accession IS NULL""")
def _leakage(spark: SparkSession, sf: str) -> DataFrame:
    base = proteins(spark, sf)
    digit = F.col("accession").cast("long") % 10
    samples = base.select("accession", F.explode(F.array_compact(F.array(
        F.when(digit < 8, "train"), F.when(digit.isin(7, 8), "test")
    ))).alias("split"))
    extra = base.where(F.col("accession").cast("long") % 100 == 0).select(
        F.concat(F.lit("Y"), "accession").alias("accession"), F.lit("test").alias("split")
    )
    return q.split_leakage_check(samples.unionByName(extra), base)


@query("split_csv_duplicates", """SELECT l_partkey::VARCHAR AS accession, count(DISTINCT l_returnflag) AS n_values
  FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1""")
def _duplicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("accession"), F.col("l_returnflag").alias("split"))
    return q.split_csv_duplicates(rows, ["A", "R"], examples=None)


@query("probs_validate", f"""WITH {CLASS_PROBS}, damaged AS (SELECT model_id, p0 + CASE WHEN accession::BIGINT % 5 = 0 THEN 0.01 ELSE 0 END AS p0,
    CASE WHEN accession::BIGINT % 11 = 0 THEN -0.5 ELSE p1 END AS p1, p2 FROM class_probs)
  SELECT model_id, 'out of range' AS error, count(*) AS n FROM damaged WHERE least(p0, p1, p2) < -1e-6 OR greatest(p0, p1, p2) > 1 + 1e-6 GROUP BY 1
  UNION ALL SELECT model_id, 'row sum', count(*) FROM damaged WHERE abs(p0 + p1 + p2 - 1) > 1.01e-3 GROUP BY 1""")
def _probs(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("accession").cast("long")
    p = F.col("probs")
    rows = class_probs(spark, sf).withColumn("probs", F.array(
        p[0] + F.when(key % 5 == 0, 0.01).otherwise(0.0), F.when(key % 11 == 0, -0.5).otherwise(p[1]), p[2]
    ))
    return q.probs_validate(rows, "multiclass", 3)


@query("model_contract_check", f"""WITH {PREDS}, m AS (SELECT DISTINCT model_id, model_type FROM preds)
  SELECT 'class order differs' AS error WHERE (SELECT count(DISTINCT model_type = 'RF') FROM m) > 1
  UNION ALL SELECT 'fewer than 9 models' WHERE (SELECT count(*) FROM m) < 9""")
def _contract(spark: SparkSession, sf: str) -> DataFrame:
    models = preds(spark, sf).select("model_id", "model_type").distinct().select(
        "model_id", F.lit("binary").alias("problem_type"),
        F.when(F.col("model_type") == "RF", F.array(F.lit("1"), F.lit("0"))).otherwise(F.array(F.lit("0"), F.lit("1"))).alias("classes"),
        F.lit("none").alias("normalization"),
    )
    return q.model_contract_check(models, min_models=9)


@query("seed_coverage", f"""WITH {SEED_ROWS}
  SELECT s.seed, m.model_type, v.embedding_name FROM (VALUES (42), (43), (44), (45)) s(seed), (VALUES ('LR'), ('RF'), ('SVM')) m(model_type),
    (VALUES ('V1'), ('V2')) v(embedding_name)
  WHERE NOT EXISTS (SELECT 1 FROM seed_rows r WHERE r.seed = s.seed AND r.model_type = m.model_type AND r.embedding_name = v.embedding_name)""")
def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([("LR",), ("RF",), ("SVM",)], "model_type string"), spark.createDataFrame([("V1",), ("V2",)], "embedding_name string")
    expected = expected_combos(*names).withColumn(
        "seed", F.explode(F.array(*[F.lit(s) for s in (42, 43, 44, 45)]))
    )
    return q.seed_coverage(expected, seed_rows(spark, sf), ["seed", "model_type", "embedding_name"])


@query("run_consistency", """SELECT DISTINCT o_orderkey AS tp_id FROM orders
  WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)""")
def _consistency(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tp_id"))
    assigned = table(spark, sf, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("target_id"))
    return q.run_consistency(pairs, assigned)


@query("split_summary", f"""WITH {PROTEINS}, r AS (SELECT accession, row_number() OVER (ORDER BY md5('7:' || accession), accession) AS k,
    (SELECT count(*) FROM proteins) AS n FROM proteins)
  SELECT CASE WHEN k <= floor(n * 0.2::DOUBLE) THEN 'test' WHEN k <= floor(n * 0.2::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split,
    count(*) AS n FROM r GROUP BY 1""")
def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return longs(split_random(proteins(spark, sf), seed=7).groupBy("split").agg(F.count(F.lit(1)).alias("n")), "n")
