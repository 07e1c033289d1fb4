"""Target -> candidate-pool universes.

A universe has one row per target with a ``candidate_ids`` array (as read from files), or it is
already *long*: one row per (target, position, candidate).  Operators accept both; the long form is
the one to keep for pools too large for one cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.quality import duplicate_keys

ATTRIBUTES = ("source_row_id", "organism")


def as_pairs(universe: DataFrame) -> DataFrame:
    """Long form (target_id, candidate_id, pos, source_row_id, organism)."""
    kept = [c for c in ATTRIBUTES if c in universe.columns]
    if "candidate_ids" in universe.columns:
        return universe.select("target_id", *kept, F.posexplode("candidate_ids").alias("pos", "candidate_id"))
    return universe.select("target_id", "candidate_id", "pos", *kept)


def pool_sizes(universe: DataFrame) -> DataFrame:
    """(target_id, candidate_count, attributes); duplicates inside a pool count. A table of sizes is returned as it is."""
    if "candidate_count" in universe.columns:
        return universe
    kept = [c for c in ATTRIBUTES if c in universe.columns]
    if "candidate_ids" in universe.columns:
        return universe.select("target_id", F.size("candidate_ids").cast("long").alias("candidate_count"), *kept)
    return universe.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("candidate_count"), *[F.min(c).alias(c) for c in kept]
    )


def universe_normalize(universe: DataFrame) -> DataFrame:
    """The universe unchanged, or an error when it is empty or repeats a target."""
    if universe.isEmpty():
        raise ValueError("universe is empty")
    repeated = duplicate_keys(universe, ["target_id"]).take(1)
    if repeated:
        raise ValueError(f"duplicate target_id: {repeated[0]['target_id']}")
    return universe


def universe_manifest(universe: DataFrame, universe_id: str, schema_version: str = "1.0",
                      stamp: bool = False) -> DataFrame:
    """One row of counts; ``stamp`` adds the generation time."""
    sizes = pool_sizes(universe)
    out = sizes.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_distinct("target_id").alias("target_count"),
        F.coalesce(F.sum("candidate_count"), F.lit(0)).alias("total_candidates"),
    ).select(
        F.lit(universe_id).alias("universe_id"), "record_count", "target_count", "total_candidates",
        F.lit(schema_version).alias("schema_version"),
    )
    return out.withColumn("generated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")) if stamp else out


def pool_size_distribution(universe: DataFrame) -> DataFrame:
    """Histogram of pool sizes over the whole universe."""
    return pool_sizes(universe).groupBy("candidate_count").agg(F.count(F.lit(1)).alias("n"))


def scarcity_pool(universe: DataFrame, min_pool_size: int = 5, mode: str = "drop_target") -> tuple[DataFrame, DataFrame]:
    """(kept targets, scarcity events) by raw pool size.

    ``drop_target`` and ``relax_ratio`` both leave short targets out and record why;
    ``use_available`` keeps every target.
    """
    if mode not in ("drop_target", "relax_ratio", "use_available"):
        raise ValueError(f"unknown scarcity mode: {mode}")
    sizes = pool_sizes(universe)
    short = F.col("candidate_count") < min_pool_size
    if mode == "use_available":
        kept, lost = sizes, sizes.where(F.lit(False))
    else:
        kept, lost = sizes.where(~short), sizes.where(short)
    reason = "insufficient_candidates" if mode == "drop_target" else "relax_ratio_skipped"
    events = lost.select(
        "target_id", F.lit(reason).alias("reason"),
        F.format_string(f"Need {min_pool_size} candidates, have %d", "candidate_count").alias("details"),
    )
    return kept, events
