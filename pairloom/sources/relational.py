"""Joins over the relational embedding store: accession -> protein -> sequence -> embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.scalars import coerce_vector as _coerce

# Column names that may hold the organism, in order of preference.
ORGANISM_COLUMNS = ("organism", "organism_name", "species", "taxon_name")


def load_proteins(protein: DataFrame, accession: DataFrame) -> DataFrame:
    """(accession, organism) of primary accessions; organism is NULL where no such column exists."""
    named = next((c for c in ORGANISM_COLUMNS if c in protein.columns), None)
    organism = F.col(f"p.{named}").cast("string") if named else F.lit(None).cast("string")
    primary = accession.where(F.col("primary")).select("protein_id", F.col("code").alias("accession")).alias("a")
    return primary.join(protein.alias("p"), F.col("a.protein_id") == F.col("p.id")).select("accession", organism.alias("organism"))


def coerce_vector(df: DataFrame, column: str = "embedding", out: str = "vec") -> DataFrame:
    return df.withColumn(out, _coerce(F.col(column), df.schema[column].dataType))


def _vectors(embeddings: DataFrame, sequence: DataFrame, protein: DataFrame, accession: DataFrame) -> DataFrame:
    """Joined store; filters on the embedding table stay below the joins."""
    primary = accession.where(F.col("primary")).select("protein_id", F.col("code").alias("accession"))
    proteins = protein.select(F.col("id").alias("protein_id"), "sequence_id")
    sequences = sequence.select(F.col("id").alias("sequence_id"))
    return embeddings.join(sequences, "sequence_id").join(proteins, "sequence_id").join(primary, "protein_id")


def resolve_embedding_type(types: DataFrame, name: str) -> int:
    """Id of a model name; an unknown name is an error."""
    row = types.where(F.col("name") == name).select("id").first()
    if row is None:
        raise ValueError(f"unknown embedding type: {name}")
    return row["id"]


def load_layer_embeddings(embeddings: DataFrame, sequence: DataFrame, protein: DataFrame, accession: DataFrame,
                          type_id: int, layer: int, check: bool = True) -> DataFrame:
    """(accession, vec) of one model and layer; an empty result is an error."""
    wanted = embeddings.where((F.col("embedding_type_id") == type_id) & (F.col("layer_index") == layer))
    out = coerce_vector(_vectors(wanted, sequence, protein, accession)).select("accession", "vec")
    if check and out.isEmpty():
        raise ValueError(f"no embeddings for type {type_id}, layer {layer}")
    return out


def load_model_layers(embeddings: DataFrame, types: DataFrame, sequence: DataFrame, protein: DataFrame, accession: DataFrame,
                      model: str, layers: Sequence[int], accessions: DataFrame | None = None) -> DataFrame:
    """(model, accession, layer_index, vec) by model name; the accession list is a semi-join, not IN chunks."""
    chosen = types.where(F.col("name") == model).select(F.col("id").alias("embedding_type_id"), F.col("name").alias("model"))
    wanted = embeddings.where(F.col("layer_index").isin(sorted(set(layers)))).join(chosen, "embedding_type_id")
    out = coerce_vector(_vectors(wanted, sequence, protein, accession))
    if accessions is not None:
        out = out.join(accessions.select("accession"), "accession", "left_semi")
    return out.select("model", "accession", "layer_index", "vec")


def scan_embeddings_ordered(embeddings: DataFrame, sequence: DataFrame, protein: DataFrame, accession: DataFrame,
                            type_id: int, layer: int) -> DataFrame:
    """The same rows in accession order, for ordered sinks."""
    return load_layer_embeddings(embeddings, sequence, protein, accession, type_id, layer, check=False).orderBy("accession")
