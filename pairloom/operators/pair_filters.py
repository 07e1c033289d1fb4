"""Documented pair-filter stages over metric columns the caller supplies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.hashing import pri, unit
from pairloom.operators.splits import in_groups


def pairs_prepare(pairs: DataFrame, organisms: Sequence[str] | None = None, organism_col: str = "organism",
                  blacklist: DataFrame | None = None, candidate_col: str = "ntp_id",
                  aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Organism filter, then candidates on the blacklist removed."""
    out = pairs if not organisms else pairs.where(in_groups(F.col(organism_col), organisms, aliases))
    if blacklist is not None:
        out = out.join(blacklist.select(F.col("accession").alias(candidate_col)).distinct(), candidate_col, "left_anti")
    return out


def pairs_filter_sequence(pairs: DataFrame, variance_col: str = "len_variance", identity_col: str = "identity",
                          max_variance: float = 0.05, max_identity: float = 0.95) -> DataFrame:
    return pairs.where((F.col(variance_col) < max_variance) & (F.col(identity_col) < max_identity))


def targets_without_match(pairs: DataFrame, kept: DataFrame, target_col: str = "tp_id") -> DataFrame:
    """Targets whose pairs were all filtered out."""
    return pairs.select(target_col).distinct().join(kept.select(target_col).distinct(), target_col, "left_anti")


def pairs_rank_assign(pairs: DataFrame, n: int, seed: int = 42, weight: Column | None = None, target_col: str = "tp_id",
                      candidate_col: str = "ntp_id", similarity_col: str = "sim_wang_avg", breadth_col: str = "mbl_avg") -> DataFrame:
    """``n`` pairs per target, sampled without replacement by weight.

    Candidates are ranked by |similarity - breadth|; the default weight decays exponentially with that
    distance.  The smallest of -ln(u)/weight are a weighted sample, so a top-n per target suffices.
    """
    distance = F.abs(F.col(similarity_col) - F.col(breadth_col))
    w = F.exp(-distance) if weight is None else weight
    u = unit(pri(seed, F.col(target_col), F.col(candidate_col))) + F.lit(0.5 / 4294967296.0)
    keyed = pairs.withColumn("distance", distance).withColumn("_key", -F.log(u) / w)
    nth = Window.partitionBy(target_col).orderBy("_key", candidate_col)
    return keyed.withColumn("pick", F.row_number().over(nth)).where(F.col("pick") <= n).drop("_key")


def pairs_filter_outlier(pairs: DataFrame, threshold: float, similarity_col: str = "sim_wang_max",
                         breadth_col: str = "mbl_min") -> DataFrame:
    return pairs.where(F.abs(F.col(similarity_col) - F.col(breadth_col)) <= threshold)


# Stage names of a run and the metadata fields that hold their row counts.
STAGES = {"filter1": "filter1_rows", "filter2": "filter2_rows", "filter3": "filter3_rows", "final": "final_rows"}


def stage_funnel(metadata: DataFrame) -> DataFrame:
    """(run_id, stage, rows)."""
    cells = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(c).cast("long").alias("rows")) for s, c in STAGES.items()])
    return metadata.select("run_id", F.inline(cells))
