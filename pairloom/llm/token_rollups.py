"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A store is a folder with three tables. ``ledger`` has, per batch, signed rows by document; ``deltas`` the same rows summed to the totals'
keys; ``commits`` the batches that count. A batch writes its ledger and its deltas into partitions of its own, over whatever an earlier
try left there, and its commit row last. Readers join with the commits, so a batch counts wholly or not at all, and once, however often it
is tried or sent again. Totals are sums of small delta tables; the texts are read for the changed documents only.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer_version"]
LEDGER = "doc_id long, source string, lang string, tokenizer_version string, docs long, tokens long, batch string"
DELTAS = "source string, lang string, tokenizer_version string, docs long, tokens long, batch string"
COMMITS = "batch string, changes long"


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def rank_file_tokens(text: Column, path: str, pattern: str) -> Column:
    """Number of tokens of a text by a file of byte-pair ranks; null reads as empty. Special tokens' strings are ordinary text."""
    def each(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = _encoding(path, pattern).encode_ordinary
        for texts in parts:
            yield pa.array([len(encode(t.as_py() or "")) for t in texts], pa.int64())

    return F.arrow_udf(each, "long")(text.cast("string"))


def word_tokens(text: Column) -> Column:
    """Number of runs without ASCII white space; null reads as empty."""
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def change(docs: DataFrame, op: str, versions: Mapping[str, Column]) -> DataFrame:
    """Changes (op, doc_id, source, lang, tokenizer_version, tokens) for one kind of operation: insert, revise or delete.

    ``versions`` maps a tokenizer version to the expression that counts a text's tokens; a delete counts nothing.
    """
    counts = [F.struct(F.lit(v).alias("tokenizer_version"), (F.lit(0).cast("long") if op == "delete" else c).alias("tokens")) for v, c in versions.items()]
    return docs.select(
        F.lit(op).alias("op"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.inline(F.array(*counts)))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def _committed(spark: SparkSession, store: str, name: str, schema: str) -> DataFrame:
    commits = _table(spark, f"{store}/commits", COMMITS).select("batch").distinct()
    return _table(spark, f"{store}/{name}", schema).join(commits, "batch", "left_semi")


def commit_batch(spark: SparkSession, store: str, batch: str, changes: DataFrame) -> bool:
    """Apply a batch of changes; False, without reading them, if the batch was committed before.

    An insert adds its row; a delete takes back everything counted for its document and tokenizer version; a revision does both, with the
    new source and language. Deletes and revisions of documents not counted take nothing back. Within a batch the inserts and the
    revisions of one document add up, and a delete of it takes back what earlier batches counted only. Null ids can be inserted, not
    deleted or revised; null sources and languages are keys of their own. An empty batch is committed too.
    """
    done = _table(spark, f"{store}/commits", COMMITS).where(F.col("batch") == batch)
    if not done.isEmpty():
        return False
    removed = changes.where(F.col("op").isin("delete", "revise") & F.col("doc_id").isNotNull()).select("doc_id", "tokenizer_version").distinct()
    old = _committed(spark, store, "ledger", LEDGER).join(removed, ["doc_id", "tokenizer_version"], "left_semi")
    old = old.groupBy("doc_id", *KEYS).agg((-F.sum("docs")).alias("docs"), (-F.sum("tokens")).alias("tokens")).where("docs <> 0 or tokens <> 0")
    new = changes.where((F.col("op") == "insert") | ((F.col("op") == "revise") & F.col("doc_id").isNotNull())).select(
        "doc_id", *KEYS, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))
    ledger_path = f"{store}/ledger/batch={batch}"
    old.unionByName(new).write.mode("overwrite").parquet(ledger_path)
    written = spark.read.schema(LEDGER.rpartition(", ")[0]).parquet(ledger_path)
    written.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{store}/deltas/batch={batch}")
    spark.createDataFrame([(batch, written.count())], COMMITS).write.mode("append").parquet(f"{store}/commits")
    return True


def totals(spark: SparkSession, store: str) -> DataFrame:
    """(source, lang, tokenizer_version, n_docs, n_tokens) over the committed batches; keys whose documents are all gone are left out."""
    sums = _committed(spark, store, "deltas", DELTAS).groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
    return sums.where("n_docs <> 0 or n_tokens <> 0")
