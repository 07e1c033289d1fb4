"""Run directories: pair files, assignments, metadata and the catalog."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File names of a run.
REQUIRED_FILES = (
    "final_dataset.csv", "run_metadata.json", "pipeline.log", "target_assignments.csv", "mf_assignments.csv",
    "mf_metricas.csv", "candidatas_metricas.csv", "filter1_output.csv", "filter2_output.csv", "filter3_output.csv",
)
PAIR_FILES = ("final_dataset.csv", "target_non_target_dataset.csv", "target_non_target_pairs.csv")
ASSIGNMENT_FILES = ("target_assignments.csv", "mf_assignments.csv")
OPTIONAL_FILES = {
    "tp_metrics": "mf_metricas.csv", "ntp_metrics": "candidatas_metricas.csv",
    "filter1": "filter1_output.csv", "filter2": "filter2_output.csv", "filter3": "filter3_output.csv",
}
METADATA_FIELDS = ("run_id", "species", "random_seed", "final_rows")
METADATA_SCHEMA = (
    "run_id string, species string, species_category string, filter1_rows long, filter2_rows long, filter3_rows long, "
    "final_rows long, duration_seconds double, random_seed long"
)


def _files(spark: SparkSession, base: str) -> DataFrame:
    """(run_id, file) of the entries one level below the runs of a base folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path")
    root = re.escape(re.sub(r"^[a-z0-9]+:/*", "/", base.rstrip("/")))
    return found.select(
        F.regexp_extract("path", root + r"/([^/]+)/([^/]+)", 1).alias("run_id"),
        F.regexp_extract("path", root + r"/([^/]+)/([^/]+)", 2).alias("file"),
    ).where("run_id <> ''").distinct()


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _first_file(spark: SparkSession, folder: str, names: Sequence[str]) -> str:
    for name in names:
        if path_exists(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    raise FileNotFoundError(f"none of {list(names)} in {folder}")


def list_runs(spark: SparkSession, base: str) -> DataFrame:
    """Runs that have metadata, sorted."""
    return _files(spark, base).where("file = 'run_metadata.json'").select("run_id").distinct().orderBy("run_id")


def read_metadata(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.option("multiLine", True).schema(METADATA_SCHEMA).json(path)


def standard_pairs(pairs: DataFrame) -> DataFrame:
    """tp_id, ntp_id whatever the file called them."""
    if {"tp_id", "ntp_id"} <= set(pairs.columns):
        return pairs
    return pairs.withColumnsRenamed({"target_id": "tp_id", "non_target_id": "ntp_id"})


def standard_assignments(assignments: DataFrame) -> DataFrame:
    return assignments.withColumnRenamed("mf_id", "target_id") if "mf_id" in assignments.columns else assignments


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').csv(path)


def load_run(spark: SparkSession, base: str, run_id: str, load_all: bool = False) -> dict[str, DataFrame]:
    """Pairs, assignments and metadata of a run; with ``load_all`` also its metric and filter files."""
    folder = f"{base}/{run_id}"
    if not path_exists(spark, folder):
        raise FileNotFoundError(folder)
    out = {
        "metadata": read_metadata(spark, f"{folder}/run_metadata.json"),
        "pairs": standard_pairs(_csv(spark, _first_file(spark, folder, PAIR_FILES))),
        "assignments": standard_assignments(_csv(spark, _first_file(spark, folder, ASSIGNMENT_FILES))),
    }
    if load_all:
        out |= {k: _csv(spark, f"{folder}/{f}") for k, f in OPTIONAL_FILES.items() if path_exists(spark, f"{folder}/{f}")}
        if path_exists(spark, f"{folder}/pipeline.log"):
            out["log"] = spark.read.text(f"{folder}/pipeline.log")
    return out


def _run_of(base: str) -> Column:
    """The run a row was read from, by the path of its file."""
    root = re.escape(re.sub(r"^[a-z0-9]+:/*", "/", base.rstrip("/")))
    return F.regexp_extract(F.url_decode("_metadata.file_path"), root + r"/([^/]+)/", 1)


def _first_line(spark: SparkSession, path) -> str | None:
    """First line of a file, None if it is empty; nothing after it is read but what fills a buffer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stream = path.getFileSystem(conf).open(path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        return reader.readLine()
    finally:
        reader.close()


def _headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Data files by their first line; of each file only that line is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found: dict[str, list[str]] = {}
    for path in paths:
        root = jvm.org.apache.hadoop.fs.Path(path)
        for status in root.getFileSystem(conf).listStatus(root):  # the files of one run
            name = status.getPath().getName()
            if status.isFile() and status.getLen() and not name.startswith(("_", ".")):
                line = _first_line(spark, status.getPath())
                if line is not None:
                    found.setdefault(line, []).append(status.getPath().toString())
    return {line: sorted(files) for line, files in sorted(found.items(), key=lambda x: min(x[1]))}


def load_runs_union(spark: SparkSession, base: str, run_ids: Sequence[str], species: dict[str, str] | None = None) -> DataFrame:
    """Pairs of several runs with ``run_id`` and ``species``.

    Files are found by one listing and read by one scan per distinct header, so the plan does not grow with the number of runs.
    """
    held: dict[str, set[str]] = {}
    for r in _files(spark, base).collect():  # the entries of a folder's runs
        held.setdefault(r["run_id"], set()).add(r["file"])
    paths = []
    for run_id in dict.fromkeys(run_ids):
        names = held.get(run_id)
        if names is None:
            raise FileNotFoundError(f"{base}/{run_id}")
        name = next((n for n in PAIR_FILES if n in names), None)
        if name is None:
            raise FileNotFoundError(f"none of {list(PAIR_FILES)} in {base}/{run_id}")
        paths.append(f"{base}/{run_id}/{name}")
    if not paths:
        return spark.createDataFrame([], "tp_id string, ntp_id string, run_id string, species string")
    out = None
    for same in _headers(spark, paths).values():
        read = spark.read.option("header", True).option("escape", '"').csv(same)
        part = standard_pairs(read.select("*", _run_of(base).alias("run_id")))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if species is None:
        metadata = read_metadata(spark, [f"{base}/{r}/run_metadata.json" for r in dict.fromkeys(run_ids)])
        named = metadata.select(_run_of(base).alias("run_id"), F.col("species_category").alias("species")).dropDuplicates(["run_id"])
    else:
        named = spark.createDataFrame([(r, species[r]) for r in run_ids if r in species], "run_id string, species string").dropDuplicates(["run_id"])
    return out.drop("species").join(named, "run_id", "left").select(*[c for c in out.columns if c not in ("run_id", "species")], "run_id", "species")


def run_catalog(spark: SparkSession, base: str) -> DataFrame:
    """(run_id, position, species_category, info) of the JSON catalog, in its order."""
    text = spark.read.text(f"{base}/runs_catalog.json", wholetext=True)
    runs = F.from_json(F.get_json_object("value", "$.runs"), "map<string,string>")
    return text.select(F.posexplode(F.map_entries(runs)).alias("position", "_e")).select(
        F.col("_e.key").alias("run_id"), "position",
        F.get_json_object("_e.value", "$.species_category").alias("species_category"), F.col("_e.value").alias("info"),
    )


def run_of_category(catalog: DataFrame, category: str) -> str | None:
    """First run of a species category."""
    row = catalog.where(F.col("species_category") == category).orderBy("position").select("run_id").first()
    return row["run_id"] if row else None


def species_of(spark: SparkSession, base: str, run_id: str, catalog: DataFrame | None = None) -> str:
    """Category from the catalog, else from the run's metadata, else ``unknown``."""
    if catalog is not None:
        row = catalog.where(F.col("run_id") == run_id).select("species_category").first()
        if row:
            return row["species_category"] or "unknown"
    path = f"{base}/{run_id}/run_metadata.json"
    row = read_metadata(spark, path).select("species_category").first() if path_exists(spark, path) else None
    return (row["species_category"] if row else None) or "unknown"


def run_validate(spark: SparkSession, base: str, run_id: str, required: Sequence[str] = REQUIRED_FILES) -> DataFrame:
    """(level, message) rows: missing files and wrong columns are errors, odd metadata warnings."""
    folder = f"{base}/{run_id}"
    present = _files(spark, base).where(F.col("run_id") == run_id).select("file")
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(f) for f in required])).alias("file"))
    out = wanted.join(present, "file", "left_anti").select(
        F.lit("error").alias("level"), F.concat(F.lit("missing file: "), "file").alias("message")
    )
    found: list[tuple[str, str]] = []
    if path_exists(spark, f"{folder}/run_metadata.json"):
        text = spark.read.text(f"{folder}/run_metadata.json", wholetext=True).first()[0]
        lost = [f for f in METADATA_FIELDS if f not in json.loads(text)]
        found += [("warning", f"metadata field missing: {f}") for f in lost]
    if path_exists(spark, f"{folder}/{PAIR_FILES[0]}"):
        if not {"tp_id", "ntp_id"} <= set(_csv(spark, f"{folder}/{PAIR_FILES[0]}").columns):
            found.append(("error", "pair file lacks tp_id, ntp_id"))
    name = next((f for f in ASSIGNMENT_FILES if path_exists(spark, f"{folder}/{f}")), None)
    if name:
        columns = _csv(spark, f"{folder}/{name}").columns
        if "mf_id" in columns:
            found.append(("warning", "legacy column mf_id"))
        if "candidates" not in columns:
            found.append(("error", "assignment file lacks candidates"))
    return out.unionByName(spark.createDataFrame(found, "level string, message string")) if found else out
