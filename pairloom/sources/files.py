"""Readers for tables, universes and landed payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.scalars import split_list, strip
from pairloom.sources.relational import load_proteins

KNOWN = ("target_id", "candidate_ids", "target_label", "organism", "taxonomy_id")
POOL_METADATA = "struct<generation_source:string,len_variance:double,max_sequence_identity:double,min_candidates:int>"
DEFAULT_SOURCE = "matches_primer_filtro"

JSONL_SCHEMA = (
    "target_id string, target_label string, candidate_ids array<string>, source_file string, source_row_id string, "
    "organism string, taxonomy_id string, raw_payload map<string,string>, _bad string"
)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType | None = None, **options) -> DataFrame:
    """Header CSV; give a schema where the column types matter."""
    reader = spark.read.option("header", True).option("sep", ",").option("escape", '"').options(**options)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_jdbc_query(spark: SparkSession, query: str, url: str, partition_column: str | None = None,
                    bounds: tuple[int, int] | None = None, partitions: int = 16, **options) -> DataFrame:
    """A SQL query as a table; with a partition column it is read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column is None:
        return reader.option("query", query).load()
    low, high = bounds or (0, 1)
    return (
        reader.option("dbtable", f"({query}) q").option("partitionColumn", partition_column)
        .option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions).load()
    )


def _at(df: DataFrame, path: str) -> DataFrame:
    return df.select(F.col(path).alias("_r")) if path else df.select(F.struct(*df.columns).alias("_r"))


def records(df: DataFrame, records_path: str = "") -> DataFrame:
    """Rows below a dotted path: a list gives its items, an object one row, anything else is an error."""
    found = _at(df, records_path)
    kind = found.schema["_r"].dataType
    if isinstance(kind, T.ArrayType):
        found = found.select(F.explode("_r").alias("_r"))
        kind = found.schema["_r"].dataType
    if not isinstance(kind, T.StructType):
        raise ValueError(f"no records at {records_path!r}: {kind.simpleString()}")
    return found.select("_r.*")


def read_json_records(spark: SparkSession, path: str, records_path: str = "", schema: str | None = None,
                      multi_line: bool = True) -> DataFrame:
    """Flatten landed JSON payloads: one document per file, or per line without ``multi_line``."""
    reader = spark.read.option("multiLine", multi_line)
    return records((reader.schema(schema) if schema else reader).json(path), records_path)


def load_data(spark: SparkSession, source: str, kind: str, **options) -> DataFrame:
    """Dispatch by source type: csv, db, api (landed JSON) or protein."""
    if kind == "csv":
        return read_csv(spark, source, **options)
    if kind == "db":
        return read_jdbc_query(spark, source, **options)
    if kind == "api":
        return read_json_records(spark, source, **options)
    if kind == "protein":
        return load_proteins(spark.read.parquet(f"{source}/protein"), spark.read.parquet(f"{source}/accession"))
    raise ValueError(f"unsupported source type: {kind}")


def pool_metadata(source: str = DEFAULT_SOURCE, len_variance: float | None = None,
                  max_sequence_identity: float | None = None, min_candidates: int | None = None) -> Column:
    values = [F.lit(source), F.lit(len_variance), F.lit(max_sequence_identity), F.lit(min_candidates)]
    return F.struct(*values).cast(POOL_METADATA)


def parse_universe(raw: DataFrame, separator: str = ";", default_label: str = "positive",
                   metadata: Column | None = None) -> DataFrame:
    """Raw text rows to universe records; rows without a target or candidates are skipped."""
    lacking = {"target_id", "candidate_ids"} - set(raw.columns)
    if lacking:
        raise ValueError(f"missing required columns: {sorted(lacking)}")

    def optional(name: str) -> Column:
        return F.nullif(strip(F.col(name)), F.lit("")) if name in raw.columns else F.lit(None).cast("string")

    kept = ("source_file", "source_row_id")
    extra = [c for c in raw.columns if c not in KNOWN and c not in kept and not c.startswith("_")]
    payload = F.create_map(*[x for c in extra for x in (F.lit(c), strip(F.col(c)))]) if extra else F.lit(None)
    out = raw.select(
        strip(F.col("target_id")).alias("target_id"),
        F.coalesce(optional("target_label"), F.lit(default_label)).alias("target_label"),
        split_list(F.col("candidate_ids"), separator).alias("candidate_ids"),
        *[F.col(c) for c in kept if c in raw.columns],
        optional("organism").alias("organism"), optional("taxonomy_id").alias("taxonomy_id"),
        (pool_metadata() if metadata is None else metadata).alias("pool_metadata"),
        payload.cast("map<string,string>").alias("raw_payload"),
    ).where((F.col("target_id") != "") & (F.size("candidate_ids") > 0))
    return out.withColumn("candidate_count", F.size("candidate_ids"))


def number_rows(df: DataFrame) -> DataFrame:
    """Add ``source_file`` and ``source_row_id``, the 1-based data row inside each file.

    A task reads the rows of a file block one after another, so a row's place is its running id less the block's first, shifted by the sizes
    of the blocks before it: one count per block is joined, and no row is sorted. With ``multi_line`` a file is one block.
    """
    placed = df.select(
        "*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    sizes = placed.groupBy("source_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("source_file").orderBy("_block")) - F.col("_n")
    offsets = sizes.select("source_file", "_block", (before - F.col("_first") + 1).alias("_shift"))
    numbered = placed.join(offsets, ["source_file", "_block"]).withColumn("source_row_id", F.col("_seq") + F.col("_shift"))
    return numbered.drop("_block", "_seq", "_shift")


def read_universe_csv(spark: SparkSession, path: str, separator: str = ";", default_label: str = "positive",
                      metadata: Column | None = None, columns: Sequence[str] | None = None,
                      multi_line: bool = False) -> DataFrame:
    """Target-to-candidates CSV; unknown columns are kept as payload, all values are text.

    Quoted cells with line breaks need ``multi_line``, which gives up splitting the files.
    """
    if columns is None:
        columns = read_csv(spark, path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = read_csv(spark, path, schema, mode="PERMISSIVE", multiLine=multi_line)
    return parse_universe(number_rows(raw), separator, default_label, metadata)


def read_universe_jsonl(spark: SparkSession, path: str, metadata: Column | None = None) -> DataFrame:
    """One record per line; blank and malformed lines are skipped, the reader's pool metadata is used."""
    raw = (
        spark.read.schema(JSONL_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    )
    good = raw.where(F.col("_bad").isNull() & (F.trim("target_id") != "") & (F.size("candidate_ids") > 0)).drop("_bad")
    return good.withColumn("pool_metadata", pool_metadata() if metadata is None else metadata).withColumn(
        "candidate_count", F.size("candidate_ids")
    )


def parse_assignments(assignments: DataFrame) -> DataFrame:
    """(target_id, pos, candidate_id, count_ok) from comma lists."""
    # split below the generator, so the list is built once per row and not once per candidate
    listed = assignments.select("target_id", "num_candidates", split_list(F.col("candidates"), ",").alias("_ids")).select(
        "target_id", "_ids", (F.size("_ids") == F.col("num_candidates").cast("int")).alias("count_ok")
    )
    return listed.select("target_id", "count_ok", F.posexplode("_ids").alias("pos", "candidate_id"))
