"""Rank-statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import statistics as st
from pairloom.plans import query
from pairloom.plans.fixtures import ENSEMBLE_ROWS, SEED_ROWS, ensemble_rows, r6, seed_rows

RECORDS = f"{SEED_ROWS}, records AS (SELECT seed, embedding_name || ' + ' || model_type AS model_config, f1 FROM seed_rows)"
SCORES = f"{RECORDS}, scores AS (SELECT seed AS run_id, model_config AS model_id, avg(f1) AS score FROM records GROUP BY seed, model_config)"
RANKS = f"""{SCORES}, ranks AS (SELECT *, rank() OVER (PARTITION BY run_id ORDER BY score DESC) + (count(*) OVER (PARTITION BY run_id, score) - 1) / 2.0::DOUBLE AS "rank" FROM scores)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    return st.stat_records(seed_rows(spark, sf), "model_embedding")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return st.score_matrix(records(spark, sf))


@query("stat_records", f"""WITH {SEED_ROWS}, n AS (SELECT *, row_number() OVER (ORDER BY seed, model_type, embedding_name) AS i FROM seed_rows)
  SELECT seed, embedding_name || ' + ' || model_type AS model_config, round(f1, 6) AS f1 FROM n WHERE embedding_name <> 'V2' OR model_type <> 'RF'""")
def _records(spark: SparkSession, sf: str) -> DataFrame:
    rows = seed_rows(spark, sf)
    blank = F.when((F.col("embedding_name") == "V2") & (F.col("model_type") == "RF"), float("nan")).otherwise(F.col("f1"))
    return r6(st.stat_records(rows.withColumn("f1", blank), "model_embedding"))


@query("stat_records_ensemble", f"WITH {ENSEMBLE_ROWS} SELECT seed, strategy AS model_config, round(f1, 6) AS f1 FROM ensemble_rows")
def _records_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    return r6(st.stat_records(ensemble_rows(spark, sf), "ensemble_strategy"))


@query("score_matrix", f"WITH {SCORES} SELECT run_id, model_id, round(score, 6) AS score FROM scores")
def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    return r6(scores(spark, sf))


@query("complete_runs", f"WITH {SCORES} SELECT run_id, model_id, round(score, 6) AS score FROM scores WHERE run_id <> 43")
def _complete(spark: SparkSession, sf: str) -> DataFrame:
    return r6(st.complete_runs(scores(spark, sf).where("not (run_id = 43 and model_id = 'V1 + LR')")))


@query("rank_matrix", f'WITH {RANKS} SELECT run_id, model_id, round(score, 6) AS score, "rank" FROM ranks')
def _ranks(spark: SparkSession, sf: str) -> DataFrame:
    return r6(st.rank_matrix(scores(spark, sf)))


@query("average_ranks", f'WITH {RANKS} SELECT model_id, round(avg("rank"), 6) AS avg_rank FROM ranks GROUP BY model_id ORDER BY 2, 1')
def _average(spark: SparkSession, sf: str) -> DataFrame:
    return r6(st.average_ranks(st.rank_matrix(scores(spark, sf))))


# chi-square upper 5 % point at five degrees of freedom
_CHI2_5 = "11.070497693516351::DOUBLE"


# its upper tail from s on, by Simpson's rule over the density; 1.329340388179137 is the gamma function at 2.5
_CHI2_5_TAIL = """SELECT 1 - sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(s * i / 4000.0::DOUBLE, 1.5) * exp(-s * i / 8000.0::DOUBLE)) * s / 12000.0::DOUBLE
    / (pow(2.0::DOUBLE, 2.5) * 1.329340388179137::DOUBLE) FROM range(4001) g(i)"""


@query("friedman", f"""WITH {RANKS}, t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM ranks GROUP BY run_id, score)),
  r AS (SELECT sum(x * x) AS ss, count(*)::DOUBLE AS k, max(n)::DOUBLE AS n FROM (SELECT sum("rank") AS x, count(*) AS n FROM ranks GROUP BY model_id)),
  f AS (SELECT (12.0 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS s, k, n FROM r, t)
  SELECT 'model_embedding' AS scope, round(s, 6) AS statistic, k::BIGINT AS num_models, n::BIGINT AS num_runs, s > {_CHI2_5} AS significant, 'ok' AS status, round(({_CHI2_5_TAIL}), 6) AS p_value FROM f""")
def _friedman(spark: SparkSession, sf: str) -> DataFrame:
    return r6(st.friedman(scores(spark, sf)).select("scope", "statistic", "num_models", "num_runs", "significant", "status", "p_value"))


# studentized range: upper 5 % point of six groups, infinite degrees of freedom
_Q6 = "4.030092::DOUBLE"


@query("critical_difference", f"""WITH {SCORES}, n AS (SELECT count(DISTINCT model_id)::DOUBLE AS k, count(DISTINCT run_id)::DOUBLE AS n FROM scores)
  SELECT k::BIGINT AS num_models, n::BIGINT AS num_runs, round({_Q6} / sqrt(2.0) * sqrt(k * (k + 1) / (6 * n)), 4) AS critical_difference FROM n""")
def _difference(spark: SparkSession, sf: str) -> DataFrame:
    n = scores(spark, sf).agg(F.count_distinct("model_id").alias("k"), F.count_distinct("run_id").alias("n")).first()
    value = st.critical_difference(n["k"], n["n"])
    return spark.createDataFrame([(n["k"], n["n"], round(value, 4))], "num_models long, num_runs long, critical_difference double")


@query("nemenyi", f"""WITH {RANKS}, a AS (SELECT model_id, avg("rank") AS r FROM ranks GROUP BY model_id)
  SELECT x.model_id AS model_a, y.model_id AS model_b, round(abs(x.r - y.r), 6) AS rank_diff, abs(x.r - y.r) > {_Q6} / sqrt(2.0) * sqrt(6.0 * 7 / (6 * 3)) AS significant
  FROM a x JOIN a y ON x.model_id < y.model_id""")
def _nemenyi(spark: SparkSession, sf: str) -> DataFrame:
    out = st.nemenyi(st.average_ranks(st.rank_matrix(scores(spark, sf))), 3)
    return r6(out.select("model_a", "model_b", "rank_diff", "significant"))


# the studentized range's upper tail: an integral over z of the normal density times a power of its mass on (z - q, z), by the
# trapezoid rule outside and Simpson's rule inside
@query("nemenyi_p_values", f"""WITH {RANKS}, a AS (SELECT model_id, avg("rank") AS r FROM ranks GROUP BY model_id),
  n AS (SELECT count(DISTINCT model_id)::DOUBLE AS k, count(DISTINCT run_id)::DOUBLE AS n FROM ranks),
  p AS (SELECT x.model_id AS model_a, y.model_id AS model_b, abs(x.r - y.r) AS d, k, n, sqrt(k * (k + 1) / (6 * n)) AS e FROM a x JOIN a y ON x.model_id < y.model_id, n),
  m AS (SELECT model_a, model_b, z, any_value(k) AS k, sum(CASE WHEN i IN (0, 80) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z - q + q * i / 80.0::DOUBLE, 2) / 2)) * any_value(q) / 240.0::DOUBLE / sqrt(2 * pi()) AS mass
    FROM (SELECT *, d / e * sqrt(2.0::DOUBLE) AS q FROM p), (SELECT -8 + j / 40.0::DOUBLE AS z FROM range(801) t(j)), range(81) g(i) GROUP BY model_a, model_b, z),
  t AS (SELECT model_a, model_b, 1 - any_value(k) * sum(exp(-z * z / 2) / sqrt(2 * pi()) * pow(mass, k - 1)) / 40.0::DOUBLE AS p_value FROM m GROUP BY model_a, model_b)
  SELECT model_a, model_b, round(p_value, 4) + 0.0 AS p_value, round(d, 4) AS rank_diff, round({_Q6} / sqrt(2.0) * e, 4) AS critical_difference, d > {_Q6} / sqrt(2.0) * e AS significant FROM p JOIN t USING (model_a, model_b)""")
def _nemenyi_p(spark: SparkSession, sf: str) -> DataFrame:
    ranked = st.rank_matrix(scores(spark, sf))
    runs = ranked.select("run_id").distinct().count()
    return r6(st.nemenyi(st.average_ranks(ranked), runs), 4)
