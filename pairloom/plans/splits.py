"""Split queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import splits as sp
from pairloom.plans import query
from pairloom.plans.fixtures import LANGUAGE_ALIASES, PROTEINS, UNIVERSE, longs, proteins, table, universe_pairs


def ranked_sql(seed: str, source: str = "proteins", key: str = "accession") -> str:
    return f"(SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || {key}), {key}) AS k, count(*) OVER () AS n FROM {source})"


def _three(test: float, val: float) -> str:
    a, b = f"floor(n * {test}::DOUBLE)", f"floor(n * {val}::DOUBLE)"
    return f"CASE WHEN k <= {a} THEN 'test' WHEN k <= {a} + {b} THEN 'val' ELSE 'train' END"


@query("split_random", f"WITH {PROTEINS} SELECT accession, organism, {_three(0.2, 0.1)} AS split FROM {ranked_sql('42')}")
def _random(spark: SparkSession, sf: str) -> DataFrame:
    return sp.split_random(proteins(spark, sf))


@query("split_train_val", f"""WITH {PROTEINS} SELECT accession, organism,
  CASE WHEN k <= floor(n * 0.25::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM {ranked_sql('5')}""")
def _train_val(spark: SparkSession, sf: str) -> DataFrame:
    return sp.split_train_val(proteins(spark, sf), test_size=0.25, seed=5)


@query("split_multi_seed", f"""WITH {PROTEINS} SELECT accession, organism, seed, {_three(0.2, 0.1)} AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || accession), accession) AS k, count(*) OVER (PARTITION BY seed) AS n
  FROM proteins, (VALUES (42), (43), (44)) s(seed))""")
def _multi_seed(spark: SparkSession, sf: str) -> DataFrame:
    return sp.split_multi_seed(proteins(spark, sf))


# fold of position k: the first n mod 5 folds hold one row more
FOLD = """(CASE WHEN k <= (n % 5) * (n // 5 + 1) THEN (k - 1) // (n // 5 + 1)
  ELSE (n % 5) + (k - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) END)"""


@query("split_kfold", f"""WITH {PROTEINS}, folds AS (SELECT accession, organism, {FOLD} AS fold FROM {ranked_sql('42')}),
  train AS (SELECT *, row_number() OVER (ORDER BY accession) AS p, count(*) OVER () AS m FROM folds WHERE fold <> 2)
  SELECT accession, organism, 'test' AS split FROM folds WHERE fold = 2
  UNION ALL SELECT accession, organism, CASE WHEN p <= greatest(1, floor(m * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END FROM train""")
def _kfold(spark: SparkSession, sf: str) -> DataFrame:
    return sp.split_kfold(proteins(spark, sf), fold_index=7)


@query("kfold_all", f"""WITH {PROTEINS}, folds AS (SELECT accession, organism, {FOLD} AS mine FROM {ranked_sql('42')}),
  every AS (SELECT accession, organism, fold, mine FROM folds, range(5) f(fold)),
  train AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY accession) AS p, count(*) OVER (PARTITION BY fold) AS m FROM every WHERE fold <> mine)
  SELECT accession, organism, fold, 'test' AS split FROM every WHERE fold = mine
  UNION ALL SELECT accession, organism, fold, CASE WHEN p <= greatest(1, floor(m * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END FROM train""")
def _kfold_all(spark: SparkSession, sf: str) -> DataFrame:
    return longs(sp.kfold_all(proteins(spark, sf)), "fold")


def split_table(spark: SparkSession, sf: str) -> DataFrame:
    """A split file: values by source, some unused, some ids unknown."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("accession"), F.col("source"))
    named = (
        F.when(F.col("source").isin("src1", "src2"), "validation").when(F.col("source") == "src3", "test")
        .when(F.col("source") == "src4", "zero_shot").when(F.col("source") == "src5", "spare").otherwise("train")
    )
    rows = docs.select("accession", named.alias("split"))
    return rows.unionByName(rows.where("split = 'test'").withColumn("accession", F.concat(F.lit("Q"), "accession")))


SPLIT_TABLE = """split_base AS (SELECT doc_id::VARCHAR AS accession, CASE WHEN source IN ('src1', 'src2') THEN 'validation' WHEN source = 'src3' THEN 'test'
    WHEN source = 'src4' THEN 'zero_shot' WHEN source = 'src5' THEN 'spare' ELSE 'train' END AS split FROM documents),
  split_table AS (SELECT * FROM split_base UNION ALL SELECT 'Q' || accession, split FROM split_base WHERE split = 'test')"""


@query("split_csv", f"""WITH {PROTEINS}, {SPLIT_TABLE} SELECT accession, CASE split WHEN 'validation' THEN 'val' ELSE split END AS split FROM split_table
  WHERE split IN ('train', 'validation', 'test') AND accession IN (SELECT accession FROM proteins)""")
def _csv(spark: SparkSession, sf: str) -> DataFrame:
    return sp.split_csv(proteins(spark, sf), split_table(spark, sf))




@query("organism_match", """SELECT c_custkey, CASE WHEN contains(o, 'nation 1') THEN 'Nation-1' WHEN contains(o, 'nation 2') OR contains(o, 'nation 3') THEN 'twos' END AS matched_group
  FROM (SELECT c_custkey, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS o FROM customer JOIN nation ON n_nationkey = c_nationkey)""")
def _match(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    aliases = {"nation 1": ["nation 1"], "twos": ["nation 2", "nation 3"]}
    return sp.organism_match(named, "n_name", ["Nation-1", "twos"], aliases).select("c_custkey", "matched_group")


@query("split_organism", f"""WITH {PROTEINS}, pool AS {ranked_sql('42', "(SELECT * FROM proteins WHERE organism = 'en')")}
  SELECT accession, organism, CASE organism WHEN 'fr' THEN 'test' WHEN 'de' THEN 'val' ELSE 'train' END AS split FROM proteins WHERE organism <> 'en'
  UNION ALL SELECT accession, organism, CASE WHEN k <= floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END FROM pool""")
def _organism(spark: SparkSession, sf: str) -> DataFrame:
    return sp.split_organism(
        proteins(spark, sf), test=["french"], train_test=["English"], val=["GERMAN"], aliases=LANGUAGE_ALIASES
    )


@query("split_organism_rest", f"""WITH {PROTEINS}, pool AS {ranked_sql('42', "(SELECT * FROM proteins WHERE organism = 'en')")}
  SELECT accession, organism, CASE organism WHEN 'fr' THEN 'test' ELSE 'val' END AS split FROM proteins WHERE organism <> 'en'
  UNION ALL SELECT accession, organism, CASE WHEN k <= floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END FROM pool""")
def _organism_rest(spark: SparkSession, sf: str) -> DataFrame:
    return sp.split_organism(
        proteins(spark, sf), test=["french"], train_test=["english"], val=["all_others"], aliases=LANGUAGE_ALIASES
    )


@query("split_independent", f"""WITH {PROTEINS},
  val AS (SELECT accession FROM {ranked_sql('42')} WHERE k <= floor(n * 0.1::DOUBLE)),
  zero AS (SELECT accession FROM {ranked_sql('9')} WHERE k <= floor(n * 0.05::DOUBLE)),
  test AS (SELECT accession FROM {ranked_sql('42', "(SELECT * FROM proteins WHERE accession NOT IN (SELECT accession FROM val))")} WHERE k <= floor(n * 0.2::DOUBLE))
  SELECT accession, organism, CASE WHEN accession IN (SELECT accession FROM zero) THEN 'zero_shot' WHEN accession IN (SELECT accession FROM val) THEN 'val'
    WHEN accession IN (SELECT accession FROM test) THEN 'test' ELSE 'train' END AS split FROM proteins""")
def _independent(spark: SparkSession, sf: str) -> DataFrame:
    return sp.split_independent(proteins(spark, sf), sp.IndependentSplit(zero_shot="random", zero_size=0.05, zero_seed=9))


@query("split_independent_scoped", f"""WITH {PROTEINS}, {SPLIT_TABLE},
  val AS (SELECT accession FROM split_table WHERE split = 'validation'),
  pool AS (SELECT accession, {FOLD} AS fold FROM {ranked_sql('42', "(SELECT * FROM proteins WHERE organism IN ('en', 'fr') AND accession NOT IN (SELECT accession FROM val))")})
  SELECT accession, organism, CASE WHEN organism = 'es' THEN 'zero_shot' WHEN accession IN (SELECT accession FROM val) THEN 'val'
    WHEN accession IN (SELECT accession FROM pool WHERE fold = 1) THEN 'test' ELSE 'train' END AS split FROM proteins""")
def _scoped(spark: SparkSession, sf: str) -> DataFrame:
    conf = sp.IndependentSplit(
        validation="csv", train_test="cross_validation", fold_index=1, scoped_organisms=["english", "french"],
        zero_shot="organism", zero_organisms=["spanish"], aliases=LANGUAGE_ALIASES,
    )
    return sp.split_independent(proteins(spark, sf), conf, validation_table=split_table(spark, sf))


@query("split_independent_organism", f"""WITH {PROTEINS}, {SPLIT_TABLE},
  test AS (SELECT accession FROM {ranked_sql('3', "(SELECT * FROM proteins WHERE organism = 'en')")} WHERE k <= floor(n * 0.3::DOUBLE))
  SELECT accession, organism, CASE WHEN accession IN (SELECT accession FROM split_table WHERE split = 'zero_shot') THEN 'zero_shot'
    WHEN organism <> 'en' THEN 'val' WHEN accession IN (SELECT accession FROM test) THEN 'test' ELSE 'train' END AS split FROM proteins""")
def _independent_organism(spark: SparkSession, sf: str) -> DataFrame:
    conf = sp.IndependentSplit(
        validation="organism", val_organisms=["all others"], scoped_organisms=["english"], test_size=0.3, train_test_seed=3,
        zero_shot="csv", aliases=LANGUAGE_ALIASES,
    )
    return sp.split_independent(proteins(spark, sf), conf, zero_table=split_table(spark, sf))


@query("split_group_by_target", f"""WITH {UNIVERSE}, targets AS (SELECT organism, target_id, row_number() OVER (PARTITION BY organism ORDER BY md5('42:' || target_id), target_id) AS k,
    count(*) OVER (PARTITION BY organism) AS n FROM (SELECT DISTINCT organism, target_id FROM universe))
  SELECT u.organism AS variant_id, u.target_id, u.candidate_id AS protein_id, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train'
    WHEN k <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM universe u JOIN targets t ON t.target_id = u.target_id""")
def _group(spark: SparkSession, sf: str) -> DataFrame:
    rows = universe_pairs(spark, sf).select(
        F.col("organism").alias("variant_id"), "target_id", F.col("candidate_id").alias("protein_id")
    )
    return sp.split_group_by_target(rows).select("variant_id", "target_id", "protein_id", "split")


@query("train_plus_val", f"""WITH {PROTEINS} SELECT accession, organism, split FROM (
  SELECT accession, organism, {_three(0.2, 0.1)} AS split FROM {ranked_sql('42')}) WHERE split <> 'test'""")
def _both(spark: SparkSession, sf: str) -> DataFrame:
    return sp.train_plus_val(sp.split_random(proteins(spark, sf)))
