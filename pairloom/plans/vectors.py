"""Vector queries; elements are compared as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import vectors as ve
from pairloom.plans import query
from pairloom.plans.fixtures import FEATURES, LAYERS, cells, features, layers, r6, table



@query("layers_mean", f"WITH {LAYERS} SELECT model AS \"view\", accession, (pos - 1)::BIGINT AS pos, round(avg(x), 5) + 0.0 AS x FROM layer_cells GROUP BY model, accession, pos")
def _mean(spark: SparkSession, sf: str) -> DataFrame:
    return cells(ve.layers_mean(layers(spark, sf)), "view", "accession", digits=5)


@query("layers_max", f"WITH {LAYERS} SELECT model AS \"view\", accession, (pos - 1)::BIGINT AS pos, round(max(x), 5) + 0.0 AS x FROM layer_cells GROUP BY model, accession, pos")
def _max(spark: SparkSession, sf: str) -> DataFrame:
    return cells(ve.layers_max(layers(spark, sf)), "view", "accession", digits=5)


@query("layers_mean_max", f"""WITH {LAYERS}, a AS (SELECT model, accession, pos, avg(x) AS m, max(x) AS h FROM layer_cells GROUP BY model, accession, pos)
  SELECT model AS "view", accession, (pos - 1)::BIGINT AS pos, round(m, 5) + 0.0 AS x FROM a UNION ALL SELECT model, accession, (pos + 15)::BIGINT, round(h, 5) + 0.0 FROM a""")
def _mean_max(spark: SparkSession, sf: str) -> DataFrame:
    return cells(ve.layers_mean_max(layers(spark, sf)), "view", "accession", digits=5)


@query("layers_concat", f"""WITH {LAYERS} SELECT model AS "view", accession, (layer_index * 16 + pos - 1)::BIGINT AS pos, round(x, 5) + 0.0 AS x FROM layer_cells""")
def _concat(spark: SparkSession, sf: str) -> DataFrame:
    return cells(ve.layers_concat(layers(spark, sf)), "view", "accession", digits=5)


@query("layers_none", f"""WITH {LAYERS} SELECT CASE model WHEN 'M1' THEN 'M1' ELSE model || '__layer_' || layer_index END AS "view", accession,
  (pos - 1)::BIGINT AS pos, round(x, 5) + 0.0 AS x FROM layer_cells""")
def _none(spark: SparkSession, sf: str) -> DataFrame:
    return cells(ve.layers_none(layers(spark, sf)), "view", "accession", digits=5)


def ontologies(spark: SparkSession, sf: str) -> DataFrame:
    """BP for all, MF twice for some, CC for some; widths 16, 12 and 8."""
    base = table(spark, sf, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("accession"), "embedding")
    parts = [
        base.select("accession", F.lit("BP").alias("ontology"), F.slice("embedding", 1, 16).alias("vec"), F.lit(0).alias("ord")),
        base.where("vec_id % 3 = 0").select("accession", F.lit("MF").alias("ontology"), F.slice("embedding", 17, 12).alias("vec"), F.lit(0).alias("ord")),
        base.where("vec_id % 6 = 0").select("accession", F.lit("MF").alias("ontology"), F.slice("embedding", 29, 12).alias("vec"), F.lit(1).alias("ord")),
        base.where("vec_id % 5 = 1").select("accession", F.lit("CC").alias("ontology"), F.slice("embedding", 41, 8).alias("vec"), F.lit(0).alias("ord")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _wanted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 4 <> 3").select(F.col("vec_id").cast("string").alias("accession"))


@query("go_concat", """WITH a AS (SELECT vec_id, vec_id::VARCHAR AS accession, list_concat(embedding[1:16],
    CASE WHEN vec_id % 5 = 1 THEN embedding[41:48] ELSE [0, 0, 0, 0, 0, 0, 0, 0]::FLOAT[] END,
    CASE WHEN vec_id % 6 = 0 THEN embedding[29:40] WHEN vec_id % 3 = 0 THEN embedding[17:28] ELSE [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]::FLOAT[] END) AS vec
    FROM embeddings WHERE vec_id % 4 <> 3)
  SELECT accession, (pos - 1)::BIGINT AS pos, round(x::DOUBLE, 5) + 0.0 AS x FROM (SELECT accession, generate_subscripts(vec, 1) AS pos, unnest(vec) AS x FROM a)""")
def _go(spark: SparkSession, sf: str) -> DataFrame:
    return cells(ve.go_concat(ontologies(spark, sf), _wanted(spark, sf), "ord"), "accession", digits=5)


@query("go_missing_report", """SELECT o AS ontology, vec_id::VARCHAR AS accession FROM embeddings, (VALUES ('BP'), ('MF'), ('CC')) t(o)
  WHERE vec_id % 4 <> 3 AND NOT (o = 'BP' OR (o = 'MF' AND vec_id % 3 = 0) OR (o = 'CC' AND vec_id % 5 = 1))""")
def _go_missing(spark: SparkSession, sf: str) -> DataFrame:
    return ve.go_missing_report(ontologies(spark, sf), _wanted(spark, sf))


def _views(spark: SparkSession, sf: str) -> DataFrame:
    full = features(spark, sf, "V1").select("view", "accession", "vec")
    part = features(spark, sf, "V2").where(F.col("accession").cast("long") % 7 != 0).select("view", "accession", F.slice("vec", 1, 8).alias("vec"))
    return full.unionByName(part)


@query("features_join", f"""WITH {FEATURES}, wide AS (SELECT 'V1' AS "view", accession, split, vec FROM features UNION ALL
    SELECT 'V2', accession, split, CASE WHEN accession::BIGINT % 7 = 0 THEN [0, 0, 0, 0, 0, 0, 0, 0]::DOUBLE[] ELSE vec[1:8] END FROM features)
  SELECT "view", accession, split, (pos - 1)::BIGINT AS pos, round(x, 5) + 0.0 AS x FROM (SELECT "view", accession, split, generate_subscripts(vec, 1) AS pos, unnest(vec) AS x FROM wide)""")
def _join(spark: SparkSession, sf: str) -> DataFrame:
    samples = features(spark, sf).select("accession", "split", "label")
    return cells(ve.features_join(samples, _views(spark, sf), ["V2"]), "view", "accession", "split", digits=5)


@query("features_missing_report", """SELECT 'V2' AS "view", vec_id::VARCHAR AS accession FROM embeddings WHERE vec_id % 7 = 0""")
def _missing(spark: SparkSession, sf: str) -> DataFrame:
    return ve.features_missing_report(features(spark, sf), _views(spark, sf))


@query("l2_normalize", f"""WITH {FEATURES}, n AS (SELECT accession, vec, sqrt(list_sum([v * v FOR v IN vec])) AS norm FROM features)
  SELECT accession, (pos - 1)::BIGINT AS pos, round(x / norm, 5) + 0.0 AS x FROM (SELECT accession, norm, generate_subscripts(vec, 1) AS pos, unnest(vec) AS x FROM n)""")
def _l2(spark: SparkSession, sf: str) -> DataFrame:
    return cells(ve.l2_normalize(features(spark, sf)), "accession", digits=5)


@query("standard_scale", f"""WITH {FEATURES}, c AS (SELECT accession, split, generate_subscripts(vec, 1) AS pos, unnest(vec) AS x FROM features),
    s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS d FROM c WHERE split = 'train' GROUP BY pos)
  SELECT accession, split, (c.pos - 1)::BIGINT AS pos, round((x - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 5) + 0.0 AS x FROM c JOIN s ON s.pos = c.pos""")
def _scale(spark: SparkSession, sf: str) -> DataFrame:
    return cells(ve.standard_scale(features(spark, sf)), "accession", "split", digits=5)


@query("layer_sweep", f"""WITH {LAYERS}, n AS (SELECT layer_index, accession, sqrt(sum(x * x)) AS norm FROM layer_cells GROUP BY model, layer_index, accession)
  SELECT layer_index, count(*) AS n, round(avg(norm), 5) AS mean_norm FROM n GROUP BY layer_index""")
def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    from pairloom.functions.scalars import norm2

    return r6(ve.layer_sweep(layers(spark, sf), aggregates=[
        F.count(F.lit(1)).alias("n"), F.avg(norm2(F.col("vec"))).alias("mean_norm"),
    ]), 5)


@query("view_select", f"""WITH {LAYERS} SELECT model, count(*) AS n FROM layers WHERE model = 'M0' GROUP BY model""")
def _select(spark: SparkSession, sf: str) -> DataFrame:
    chosen = ve.view_select(layers(spark, sf), "model", names=["m-0"], group="all", groups={"all": ["M0", "M1"]})
    return chosen.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("enabled_views", """SELECT DISTINCT p_brand AS "view" FROM part WHERE p_size > 45 ORDER BY 1""")
def _enabled(spark: SparkSession, sf: str) -> DataFrame:
    return ve.enabled_views(table(spark, sf, "part").select(F.col("p_brand").alias("name"), (F.col("p_size") > 45).alias("enabled")))
