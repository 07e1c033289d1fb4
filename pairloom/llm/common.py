"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; a null id falls in fold -1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)), F.lit(-1)).cast("int")


def texts_of(batch, name: str = "text") -> Iterator[str]:
    """Texts of an Arrow batch, one at a time; null reads as empty."""
    for value in batch.column(name):
        text = value.as_py()
        yield "" if text is None else text


def sliced(batches, rows: int = 512):
    """The batches in slices, so that one slice of long texts stays small next to its results."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _columns(fn, texts: list[str | None], schema: T.StructType) -> list[pa.Array]:
    """Results of ``fn`` per text, one tuple each, as Arrow columns."""
    rows = [fn(t) for t in texts]
    made = zip(*rows) if rows else ((),) * len(schema)
    return [pa.array(column, to_arrow_type(f.dataType)) for column, f in zip(made, schema)]


def text_table(docs: DataFrame, make, ddl: str) -> DataFrame:
    """(doc_id, columns of ``ddl``): ``make()`` gives, once per task, the function from a text (or None) to a tuple of the columns."""
    schema = T.StructType.fromDDL(ddl)
    names = ["doc_id", *schema.names]

    def each(batches):
        fn = make()
        for batch in sliced(batches, 256):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_columns(fn, batch.column("text").to_pylist(), schema)], names)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(each, T.StructType([T.StructField("doc_id", T.LongType()), *schema]))


def text_columns(docs: DataFrame, make, ddl: str) -> DataFrame:
    """Each row as the struct ``doc``, whatever its columns are named, next to the columns of ``ddl`` made from its text."""
    schema, at = T.StructType.fromDDL(ddl), docs.columns.index("text")
    packed = docs.select(F.struct("*").alias("doc"))

    def each(batches):
        fn = make()
        for batch in sliced(batches, 256):
            rows = batch.column("doc")
            yield pa.RecordBatch.from_arrays([rows, *_columns(fn, rows.field(at).to_pylist(), schema)], ["doc", *schema.names])

    return packed.mapInArrow(each, T.StructType([*packed.schema, *schema]))
