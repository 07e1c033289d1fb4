"""Writers.  Tables are written in parallel; only one-row manifests are gathered into one file."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.variants import bundle_summary, variant_manifest
from pairloom.sources.runs import load_run, path_exists

FORMATS = ("csv", "json", "parquet")
# Text files that repeat their ids in every row shrink to a fraction at the fastest level already.
COMPACT = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", **options) -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').options(**options).csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, text kept as UTF-8."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Small results only: one pretty-printed object per row in a single part file."""
    text = F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"})
    df.select(text.alias("value")).coalesce(1).write.mode(mode).text(path)


def export_dataset(spark: SparkSession, base: str, run_id: str, path: str, fmt: str = "csv", include_metadata: bool = False) -> None:
    """A run's pairs, optionally with metadata and assignments. Text files are compressed, since pairs repeat their ids and field names."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    run = load_run(spark, base, run_id)
    run["pairs"].write.format(fmt).options(**({} if fmt == "parquet" else COMPACT), **({"header": "true"} if fmt == "csv" else {})).save(f"{path}/pairs")
    if include_metadata:
        write_json(run["metadata"], f"{path}/metadata")
        write_csv(run["assignments"], f"{path}/assignments", **COMPACT)


def export_bundle(assignments: DataFrame, events: DataFrame, universe_manifest: DataFrame, path: str) -> None:
    """Instances, assignments by split, manifests, events and summary of a split variant."""
    assignments = assignments.persist()
    write_csv(assignments.select("variant_id", "protein_id", "role", "target_id"), f"{path}/instances")
    write_csv(assignments.drop("split"), f"{path}/assignments")
    assignments.write.partitionBy("split").option("header", True).csv(f"{path}/split")
    write_json(variant_manifest(assignments, events), f"{path}/variant_manifest")
    write_json(universe_manifest, f"{path}/universe_manifest")
    write_json(bundle_summary(assignments, events), f"{path}/summary")
    write_jsonl(events, f"{path}/scarcity_events")
    assignments.unpersist()


def write_predictions_partitioned(predictions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per (seed, model, embedding), or per (seed, strategy) for ensembles."""
    keys = ["seed", "strategy"] if "strategy" in predictions.columns else ["seed", "model_type", "embedding_name"]
    predictions.write.mode(mode).partitionBy(*keys).option("header", True).csv(path)


#: Files up to this size are read as one row; larger ones in blocks.
WHOLE_FILE_BYTES = 128 << 20


def _streamed_digests(batches):
    """SHA-256 of each path's file, read in blocks of a few megabytes where the task runs."""
    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            system, name = pafs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(name) as stream:
                while block := stream.read(8 << 20):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(digests, pa.string())], ["path", "sha256"])


def artifact_fingerprints(spark: SparkSession, paths: list[str], whole_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """(path, sha256) of files, computed where they are read; a missing file gives ``unknown``.

    A file above ``whole_bytes`` is digested in blocks by one task, so its size has no bound. The executors must reach it by its path.
    """
    there = [p for p in paths if path_exists(spark, p)]
    lost = [(p, "unknown") for p in paths if p not in there]
    out = spark.createDataFrame(lost, "path string, sha256 string")
    if there:
        listed = spark.read.format("binaryFile").load(there).select("path", "length")  # without contents
        sizes = {r["path"]: r["length"] for r in listed.collect()}
        large = [p for p, n in sizes.items() if n > whole_bytes]
        # files without a byte are not listed
        empty = [(p, hashlib.sha256().hexdigest()) for p in there if not any(p.split(":", 1)[-1].lstrip("/") in x for x in sizes)]
        if empty:
            out = out.unionByName(spark.createDataFrame(empty, "path string, sha256 string"))
        small = spark.read.format("binaryFile").load(there).where(F.col("length") <= whole_bytes)
        out = out.unionByName(small.select("path", F.sha2("content", 256).alias("sha256")))
        if large:
            rows = spark.createDataFrame([(p,) for p in large], "path string").repartition(len(large), "path")
            out = out.unionByName(rows.mapInArrow(_streamed_digests, "path string, sha256 string"))
    return out


# Transform steps recorded in every lineage row.
LINEAGE_STEPS = ("normalize_input", "apply_dataset_policy", "generate_variant", "generate_split")


def lineage_record(fingerprints: DataFrame, variant_id: str, seed: int, created_at: str | None = None) -> DataFrame:
    """One lineage row; its id hashes artifacts, steps, seed and time."""
    stamp = F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    facts = fingerprints.agg(F.sort_array(F.collect_list("sha256")).alias("artifacts")).select(
        "artifacts", F.array(*[F.lit(s) for s in LINEAGE_STEPS]).alias("steps"), F.lit(variant_id).alias("variant_id"),
        F.lit(seed).alias("seed"), stamp.alias("created_at"),
    )
    text = F.concat_ws("|", F.concat_ws(",", "artifacts"), F.concat_ws(",", "steps"), F.col("seed").cast("string"), "created_at")
    return facts.withColumn("lineage_id", F.concat(F.lit("lineage_"), F.substring(F.sha2(text, 256), 1, 16)))
