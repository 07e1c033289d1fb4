"""Reader and writer queries; files are written from the tables into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.labels import class_list
from pairloom.operators.predictions import dataset_snapshot
from pairloom.operators.splits import split_group_by_target, split_random
from pairloom.operators.universe import universe_manifest
from pairloom.operators.variants import VariantPolicy, variant_generate
from pairloom.plans import query
from pairloom.plans.fixtures import PREDS, PROTEINS, TEXT_UNIVERSE, longs, preds, proteins, r6, table, text_universe, universe_pairs
from pairloom.plans.splits import _three, ranked_sql
from pairloom.plans.universes import greedy_sql
from pairloom.sources import files, relational, runs, sinks
from pairloom.session import drop_table, scratch_path


@query("read_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def _csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "orders")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    sinks.write_csv(table(spark, sf, "orders").select(*columns), path)
    return r6(files.read_csv(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"), 2)


@query("load_data", "SELECT s_suppkey, s_name FROM supplier")
def _load(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "supplier")
    sinks.write_csv(table(spark, sf, "supplier").select("s_suppkey", "s_name"), path)
    return files.load_data(spark, path, "csv", schema="s_suppkey long, s_name string")


@query("read_universe_csv", f"""WITH {TEXT_UNIVERSE} SELECT target_id, target_label, organism, len(candidate_ids)::BIGINT AS candidate_count,
  md5(array_to_string(candidate_ids, '|')) AS digest, batch FROM text_universe WHERE len(candidate_ids) > 0""")
def _universe_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "universe")
    sinks.write_csv(text_universe(spark, sf), path)
    return longs(files.read_universe_csv(spark, path).select(
        "target_id", "target_label", "organism", "candidate_count", F.md5(F.array_join("candidate_ids", "|")).alias("digest"),
        F.col("raw_payload").getItem("batch").alias("batch"),
    ), "candidate_count")


@query("read_universe_csv_rows", "SELECT 1 + (row_number() OVER (ORDER BY doc_id) - 1) AS source_row_id, doc_id::VARCHAR AS target_id FROM documents")
def _universe_rows(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "universe")
    rows = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("target_id"), F.col("source").alias("candidate_ids"))
    # one file, so that the row numbers of the file are those of the sorted table
    sinks.write_csv(rows.repartition(1).sortWithinPartitions("doc_id").drop("doc_id"), path)
    return files.read_universe_csv(spark, path).select("source_row_id", "target_id")


@query("read_universe_jsonl", f"""WITH {TEXT_UNIVERSE} SELECT target_id, organism, len(candidate_ids)::BIGINT AS candidate_count, md5(array_to_string(candidate_ids, '|')) AS digest,
  'supplied' AS generation_source FROM text_universe WHERE len(candidate_ids) > 0""")
def _universe_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "universe")
    parsed = files.parse_universe(text_universe(spark, sf)).select("target_id", "target_label", "organism", "candidate_ids", "pool_metadata")
    good = parsed.select(F.to_json(F.struct(*parsed.columns)).alias("value"))
    # a broken twin of some lines must be skipped
    broken = good.where(F.length("value") % 7 == 0).select(F.substring("value", 1, 40).alias("value"))
    good.unionByName(broken).write.text(path)
    rows = files.read_universe_jsonl(spark, path, files.pool_metadata("supplied"))
    return longs(rows.select(
        "target_id", "organism", "candidate_count", F.md5(F.array_join("candidate_ids", "|")).alias("digest"),
        F.col("pool_metadata.generation_source").alias("generation_source"),
    ), "candidate_count")


@query("read_json_records", "SELECT doc_id, quality::BIGINT AS quality FROM labels UNION ALL SELECT doc_id, toxic::BIGINT FROM labels")
def _records(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "payload")
    item = F.array(F.struct("doc_id", F.col("quality").alias("quality")), F.struct("doc_id", F.col("toxic").alias("quality")))
    table(spark, sf, "labels").select(F.struct(item.alias("items")).alias("data")).write.json(path)
    return files.read_json_records(spark, path, "data.items", "data struct<items:array<struct<doc_id:long,quality:long>>>", multi_line=False)


# -- relational store --------------------------------------------------------------------------------

def store(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Two model types, two layers, a primary and a secondary accession per vector."""
    base = table(spark, sf, "embeddings")
    layers = F.explode(F.array(*[
        F.struct(F.lit(t).alias("embedding_type_id"), F.lit(i).alias("layer_index"), F.slice("embedding", 32 * i + 16 * t - 15, 16).alias("embedding"))
        for t in (1, 2) for i in (0, 1)
    ]))
    codes = F.explode(F.array(
        F.struct(F.concat(F.lit("A"), F.col("vec_id").cast("string")).alias("code"), F.lit(True).alias("primary")),
        F.struct(F.concat(F.lit("B"), F.col("vec_id").cast("string")).alias("code"), F.lit(False).alias("primary")),
    ))
    return {
        "embeddings": base.select(F.col("vec_id").alias("sequence_id"), layers.alias("_l")).select("sequence_id", "_l.*"),
        "types": spark.createDataFrame([(1, "esm"), (2, "prot")], "id int, name string"),
        "sequence": base.select(F.col("vec_id").alias("id")),
        "protein": base.select((F.col("vec_id") + 100000).alias("id"), F.col("vec_id").alias("sequence_id"), F.col("label").cast("string").alias("species")),
        "accession": base.select((F.col("vec_id") + 100000).alias("protein_id"), codes.alias("_c")).select("protein_id", "_c.*"),
    }


@query("load_proteins", "SELECT 'A' || vec_id AS accession, label::VARCHAR AS organism FROM embeddings")
def _proteins(spark: SparkSession, sf: str) -> DataFrame:
    tables = store(spark, sf)
    return relational.load_proteins(tables["protein"], tables["accession"])


def _sum(column: str = "vec"):
    return F.aggregate(F.col(column).cast("array<double>"), F.lit(0.0), lambda a, x: a + x)


@query("load_layer_embeddings", "SELECT 'A' || vec_id AS accession, round(list_sum(embedding[33:48]::DOUBLE[]), 5) AS total FROM embeddings")
def _layer(spark: SparkSession, sf: str) -> DataFrame:
    t = store(spark, sf)
    rows = relational.load_layer_embeddings(t["embeddings"], t["sequence"], t["protein"], t["accession"], 1, 1)
    return r6(rows.select("accession", _sum().alias("total")), 5)


@query("resolve_embedding_type", "SELECT 2 AS type_id, count(*) AS n FROM embeddings")
def _resolve(spark: SparkSession, sf: str) -> DataFrame:
    t = store(spark, sf)
    type_id = relational.resolve_embedding_type(t["types"], "prot")
    rows = t["embeddings"].where((F.col("embedding_type_id") == type_id) & (F.col("layer_index") == 0))
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(type_id).alias("type_id"), "n")


@query("load_model_layers", """SELECT 'prot' AS model, 'A' || vec_id AS accession, i AS layer_index, round(list_sum(embedding[32 * i + 17 : 32 * i + 32]::DOUBLE[]), 5) AS total
  FROM embeddings, (VALUES (0), (1)) l(i) WHERE vec_id % 3 = 0""")
def _model_layers(spark: SparkSession, sf: str) -> DataFrame:
    t = store(spark, sf)
    wanted = t["accession"].where(F.col("protein_id") % 3 == (100000 % 3)).select(F.col("code").alias("accession"))
    rows = relational.load_model_layers(
        t["embeddings"], t["types"], t["sequence"], t["protein"], t["accession"], "prot", [1, 0, 1], wanted
    )
    return r6(rows.select("model", "accession", "layer_index", _sum().alias("total")), 5)


@query("scan_embeddings_ordered", "SELECT 'A' || vec_id AS accession, 16::BIGINT AS width FROM embeddings ORDER BY 1")
def _ordered(spark: SparkSession, sf: str) -> DataFrame:
    t = store(spark, sf)
    rows = relational.scan_embeddings_ordered(t["embeddings"], t["sequence"], t["protein"], t["accession"], 1, 0)
    return rows.select("accession", F.size("vec").cast("long").alias("width"))


@query("coerce_vector", "SELECT vec_id, 64::BIGINT AS width, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def _coerce(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("[ "), F.array_join(F.col("embedding").cast("array<string>"), ", "), F.lit("]"))
    rows = relational.coerce_vector(table(spark, sf, "embeddings").select("vec_id", text.alias("embedding")))
    return r6(rows.select("vec_id", F.size("vec").cast("long").alias("width"), _sum().alias("total")), 5)


# -- runs ---------------------------------------------------------------------------------------------

RUN_OF = {"en": "run_b", "fr": "run_a"}
RUN_SQL = "CASE lang WHEN 'en' THEN 'run_b' WHEN 'fr' THEN 'run_a' ELSE 'run_' || lang END"


def write_runs(spark: SparkSession, sf: str) -> str:
    """A run folder per language of the documents: targets are documents, candidates their words."""
    base = scratch_path(spark, "runs")
    words = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z0-9]+", ","), ","), lambda w: w != "")
    documents = table(spark, sf, "documents")
    langs = class_list(documents, "lang")
    # texts are cut into words once, in a folder per language, so that a run reads its own documents only
    place = F.array_position(F.array(*[F.lit(x) for x in langs]).cast("array<string>"), F.col("lang")).cast("int")
    split = documents.where(F.col("lang").isNotNull()).select(
        "lang", F.col("doc_id").cast("string").alias("target_id"), words.alias("w"), place.alias("place"))
    path = scratch_path(spark, "run-words")
    split.write.partitionBy("place").parquet(path)
    for i, lang in enumerate(langs, 1):
        docs = spark.read.schema(split.schema).parquet(path).where(F.col("place") == i)
        run = RUN_OF.get(lang, f"run_{lang}")
        target, other = ("target_id", "non_target_id") if run == "run_a" else ("tp_id", "ntp_id")
        mine = docs.select("target_id", "w")
        pairs = mine.select(F.col("target_id").alias(target), F.explode("w").alias(other))
        sinks.write_csv(pairs, f"{base}/{run}/{'target_non_target_pairs.csv' if run == 'run_a' else 'final_dataset.csv'}", **sinks.COMPACT)
        name = "mf_id" if run == "run_a" else "target_id"
        sinks.write_csv(
            mine.select(F.col("target_id").alias(name), F.size("w").alias("num_candidates"), F.array_join("w", ",").alias("candidates")),
            f"{base}/{run}/{'mf_assignments.csv' if run == 'run_a' else 'target_assignments.csv'}", **sinks.COMPACT,
        )
        meta = mine.agg(F.count(F.lit(1)).alias("final_rows")).select(
            F.lit(run).alias("run_id"), F.lit(lang).alias("species_category"), F.lit(42).alias("random_seed"), "final_rows"
        )
        sinks.write_json(meta, f"{base}/{run}/run_metadata.json")
    drop_table(spark, path)
    return base


WORDS = r"""words AS (SELECT lang, doc_id::VARCHAR AS target_id, [w FOR w IN string_split(regexp_replace("text", '[^A-Za-z0-9]+', ',', 'g'), ',') IF w <> ''] AS w FROM documents)"""


@query("list_runs", f"SELECT {RUN_SQL} AS run_id FROM documents WHERE lang IS NOT NULL GROUP BY 1 ORDER BY 1")
def _list(spark: SparkSession, sf: str) -> DataFrame:
    return runs.list_runs(spark, write_runs(spark, sf))


@query("load_run", f"WITH {WORDS} SELECT tp_id, ntp_id, count(*) AS n FROM (SELECT target_id AS tp_id, unnest(w) AS ntp_id FROM words WHERE lang = 'fr') GROUP BY ALL")
def _run(spark: SparkSession, sf: str) -> DataFrame:
    pairs = runs.load_run(spark, write_runs(spark, sf), "run_a")["pairs"]
    return pairs.groupBy("tp_id", "ntp_id").agg(F.count(F.lit(1)).alias("n"))


@query("load_runs_union", f"""WITH {WORDS} SELECT {RUN_SQL} AS run_id, lang AS species, count(*) AS n, count(DISTINCT tp_id) AS targets
  FROM (SELECT lang, target_id AS tp_id, unnest(w) AS ntp_id FROM words) GROUP BY lang""")
def _union(spark: SparkSession, sf: str) -> DataFrame:
    base = write_runs(spark, sf)
    rows = runs.load_runs_union(spark, base, class_list(runs.list_runs(spark, base), "run_id"))
    return rows.groupBy("run_id", "species").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tp_id").alias("targets"))


@query("parse_assignments", f"""WITH {WORDS}, e AS (SELECT target_id, unnest(w) AS candidate_id, unnest(range(len(w))) AS pos FROM words)
  SELECT target_id, count(*) AS n, bool_and(true) AS count_ok, max(pos)::BIGINT AS last_pos, count(DISTINCT candidate_id) AS candidates FROM e GROUP BY target_id""")
def _assignments(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "assignments")
    words = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z0-9]+", ","), ","), lambda w: w != "")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("target_id"), words.alias("w"))
    sinks.write_csv(docs.select("target_id", F.size("w").alias("num_candidates"), F.array_join("w", ",").alias("candidates")), path)
    rows = files.parse_assignments(files.read_csv(spark, path, "target_id string, num_candidates int, candidates string"))
    return longs(rows.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("count_ok").alias("count_ok"), F.max("pos").alias("last_pos"),
        F.count_distinct("candidate_id").alias("candidates"),
    ), "last_pos")


@query("run_validate", """SELECT 'error' AS level, 'missing file: ' || f AS message FROM documents, (VALUES ('final_dataset.csv'), ('pipeline.log')) t(f) GROUP BY f
  UNION ALL SELECT 'warning', 'metadata field missing: species' UNION ALL SELECT 'warning', 'legacy column mf_id'""")
def _validate(spark: SparkSession, sf: str) -> DataFrame:
    return runs.run_validate(spark, write_runs(spark, sf), "run_a", ["final_dataset.csv", "run_metadata.json", "pipeline.log", "mf_assignments.csv"])


@query("run_catalog", "SELECT 'run_' || lang AS run_id, lang AS species_category, count(*)::VARCHAR AS final_rows FROM documents GROUP BY lang")
def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "catalog")
    per = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("final_rows"))
    # a catalog holds one entry per run, here one per language
    entries = per.agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat(F.lit("run_"), "lang"), F.struct(F.col("lang").alias("species_category"), "final_rows")
    ))).alias("runs"))
    entries.select(F.to_json(F.struct("runs")).alias("value")).coalesce(1).write.text(f"{base}/runs_catalog.json")
    return runs.run_catalog(spark, base).select(
        "run_id", "species_category", F.get_json_object("info", "$.final_rows").alias("final_rows")
    )


@query("export_dataset", f"WITH {WORDS} SELECT count(*) AS n, count(DISTINCT target_id) AS targets FROM (SELECT target_id, unnest(w) FROM words WHERE lang = 'en')")
def _export(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "export")
    sinks.export_dataset(spark, write_runs(spark, sf), "run_b", path, "json", include_metadata=True)
    return spark.read.schema("tp_id string, ntp_id string").json(f"{path}/pairs").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("tp_id").alias("targets")
    )


# -- sinks --------------------------------------------------------------------------------------------

@query("write_csv", "SELECT doc_id, lang, md5(\"text\") AS digest FROM documents")
def _write_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "documents")
    sinks.write_csv(table(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    back = files.read_csv(spark, path, "doc_id long, lang string, text string", multiLine=True, lineSep="\n")
    return back.select("doc_id", "lang", F.md5("text").alias("digest"))


@query("write_jsonl", "SELECT doc_id, lang, md5(\"text\") AS digest FROM documents")
def _write_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "documents")
    sinks.write_jsonl(table(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    return spark.read.schema("doc_id long, lang string, text string").json(path).select("doc_id", "lang", F.md5("text").alias("digest"))


@query("write_json", "SELECT count(*) AS n, max(n_chars) AS longest FROM documents")
def _write_json(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "summary")
    sinks.write_json(table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest")), path)
    return spark.read.schema("n long, longest long").option("multiLine", True).json(path)


@query("write_predictions_partitioned", f"WITH {PREDS} SELECT seed, model_type, embedding_name, count(*) AS n, sum(predicted_label)::BIGINT AS positives FROM preds GROUP BY ALL")
def _partitioned(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "predictions")
    sinks.write_predictions_partitioned(preds(spark, sf).select("accession", "true_label", "predicted_label", "model_type", "embedding_name", "seed"), path)
    back = spark.read.schema("accession string, true_label long, predicted_label long, seed int, model_type string, embedding_name string").option("header", True).csv(path)
    return back.groupBy("seed", "model_type", "embedding_name").agg(F.count(F.lit(1)).alias("n"), F.sum("predicted_label").alias("positives"))


@query("dataset_snapshot", f"""WITH {PROTEINS} SELECT accession, CASE WHEN organism = 'en' THEN '["en","x"]' ELSE organism END AS label, split AS dataset_split FROM (
  SELECT *, {_three(0.2, 0.1)} AS split FROM {ranked_sql('42')}) WHERE accession::BIGINT % 10 <> 0""")
def _snapshot(spark: SparkSession, sf: str) -> DataFrame:
    labels = F.when(F.col("organism") == "en", F.array("organism", F.lit("x"))).otherwise(F.array("organism"))
    rows = split_random(proteins(spark, sf)).withColumn("labels", labels)
    held = F.when(F.col("accession").cast("long") % 10 == 0, "zero_shot").otherwise(F.col("split"))
    return dataset_snapshot(rows.withColumn("split", held))


@query("export_bundle", f"""WITH RECURSIVE {greedy_sql(3)}, t AS (SELECT target_id, row_number() OVER (ORDER BY md5('42:' || target_id), target_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT target_id FROM assignments))
  SELECT CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split, role, count(*) AS n
  FROM assignments JOIN t USING (target_id) GROUP BY 1, 2""")
def _bundle(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "bundle")
    universe = universe_pairs(spark, sf)
    rows, events = variant_generate(universe, VariantPolicy(ratio="1:3", order="hash"))
    sinks.export_bundle(split_group_by_target(rows), events, universe_manifest(universe, "u1"), path)
    return spark.read.option("header", True).csv(f"{path}/split").groupBy("split", "role").agg(F.count(F.lit(1)).alias("n"))


@query("artifact_fingerprints")
def _fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    names = ("orders", "documents", "embeddings", "absent")
    found = sinks.artifact_fingerprints(spark, [f"{sf}/{n}.parquet" for n in names])
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "sha256")


@query("lineage_record")
def _lineage(spark: SparkSession, sf: str) -> DataFrame:
    found = sinks.artifact_fingerprints(spark, [f"{sf}/orders.parquet", f"{sf}/labels.parquet"])
    row = sinks.lineage_record(found, "variant_000042", 42, "2024-01-01T00:00:00")
    return row.select("lineage_id", "variant_id", "seed", F.size("artifacts").alias("n_artifacts"), F.size("steps").alias("n_steps"))
