"""Exact global order statistics without a single-partition window.

Every function cuts the key space into buckets, ranks inside a bucket and adds the bucket's
offset.  Buckets are either the leading hex digits of an md5 key (uniform by construction) or
the gaps between splitters: a deterministic sample of the distinct order keys, taken with a
``min_by`` per hash slot, so it combines map-side and never depends on partitioning.  A row finds
its gap on two levels, so its cost grows with the root of the number of buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.session import cut_lineage

LEAST_SLOTS = 64


def slots_of(df: DataFrame) -> int:
    """Buckets a table is cut into: four to a shuffle partition, so that ranks are spread as widely as the session asks."""
    return max(LEAST_SLOTS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def prefix_digits(df: DataFrame) -> int:
    """Leading hex digits of an md5 key that give at least sixteen buckets a slot."""
    digits = 3
    while 16 ** digits < 16 * slots_of(df):
        digits += 1
    return digits


def attach(df: DataFrame, small: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Bring columns of a per-group table to every row.

    For a single group this is a scalar subquery.  Otherwise the group table is written first, so the
    planner knows its size: below the broadcast threshold the rows are not shuffled on their (often
    few and skewed) group keys, above it the join falls back to a shuffle.
    """
    if by:
        return df.join(cut_lineage(small.select(*by, *columns), "groups"), list(by), "left")
    packed = small.select(F.struct(*columns).alias("_packed")).scalar()
    return df.withColumn("_packed", packed).withColumns(
        {name: F.col("_packed").getField(name) for name in columns}
    ).drop("_packed")


def with_buckets(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), hashed: bool = False,
                 slots: int | None = None) -> DataFrame:
    """Add the order key ``_o`` and its bucket ``_b``; buckets are monotone in ``_o``."""
    keyed = df.withColumn("_o", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    if hashed:
        return keyed.withColumn("_b", F.conv(F.substring(F.col("_o.k0"), 1, prefix_digits(df)), 16, 10).cast("int"))
    picked = (
        keyed.groupBy(*by, F.pmod(F.xxhash64("_o"), F.lit(slots or slots_of(df))).alias("_slot"))
        .agg(F.min_by("_o", F.xxhash64(F.lit("splitter"), F.col("_o"))).alias("_pick"))
    )
    # Two levels of splitters: a row carries and looks at about twice the root of their number.
    width = math.isqrt(slots or slots_of(df)) + 1
    place = Window.partitionBy(*by).orderBy("_pick") if by else Window.partitionBy(F.lit(0)).orderBy("_pick")
    placed = cut_lineage(picked.withColumn("_c", F.floor((F.row_number().over(place) - 1) / width).cast("int") + 1), "splitters")
    fine = placed.groupBy(*by, "_c").agg(F.sort_array(F.collect_list("_pick")).alias("_fine"))
    coarse = fine.groupBy(*by).agg(F.sort_array(F.collect_list(F.get("_fine", F.lit(0)))).alias("_coarse"))

    def at_or_below(splitters: str) -> Column:
        return F.coalesce(F.size(F.filter(splitters, lambda s: s <= F.col("_o"))), F.lit(0))

    out = attach(keyed, coarse, by, ["_coarse"]).withColumn("_c", at_or_below("_coarse")).drop("_coarse")
    out = attach(out, fine, [*by, "_c"], ["_fine"])
    return out.withColumn("_b", F.when(F.col("_c") > 0, (F.col("_c") - 1) * width + at_or_below("_fine")).otherwise(0)).drop("_fine", "_c")


def _bucket_offsets(bucketed: DataFrame, by: Sequence[str]) -> DataFrame:
    sizes = bucketed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return sizes.select(
        *by, "_b", "_c",
        (F.sum("_c").over(group.orderBy("_b")) - F.col("_c")).alias("_off"),
        F.sum("_c").over(group).alias("_n"),
    )


def dist_rank(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), hashed: bool = False,
              rank_col: str = "rank", total_col: str | None = None) -> DataFrame:
    """``row_number`` over ``order`` inside each ``by`` group, as one shuffle on (by, bucket)."""
    bucketed = with_buckets(df, order, by, hashed)
    offsets = _bucket_offsets(bucketed, by)
    inside = Window.partitionBy(*by, "_b").orderBy("_o")
    out = bucketed.join(offsets, [*by, "_b"]).withColumn(
        rank_col, (F.row_number().over(inside) + F.col("_off")).cast("long")
    )
    if total_col:
        out = out.withColumn(total_col, F.col("_n"))
    return out.drop("_o", "_b", "_c", "_off", "_n")


def cut_keys(bucketed: DataFrame, by: Sequence[str], sizes) -> DataFrame:
    """Order keys at the given 1-based positions, as an array ``_cuts`` per group.

    ``sizes(n)`` maps the group size column to the position columns.  Only the buckets that hold a
    cut are ranked; the other rows never move.  Position 0 gives a NULL cut.
    """
    offsets = _bucket_offsets(bucketed, by)
    positions = F.posexplode(F.array(*[p.cast("long") for p in sizes(F.col("_n"))]))
    # one entry per cut
    wanted = (
        offsets.select("*", positions.alias("_i", "_pos"))
        .where((F.col("_pos") > F.col("_off")) & (F.col("_pos") <= F.col("_off") + F.col("_c")))
        .groupBy(*by).agg(F.collect_list(F.struct("_b", "_i", (F.col("_pos") - F.col("_off")).alias("_in"))).alias("_wanted"))
    )
    here = attach(bucketed.select(*by, "_b", "_o"), wanted, by, ["_wanted"]).where(
        F.exists("_wanted", lambda w: w.getField("_b") == F.col("_b"))
    )
    inside = Window.partitionBy(*by, "_b").orderBy("_o")
    hits = here.withColumn("_rn", F.row_number().over(inside).cast("long")).select(
        *by, "_b", "_rn", "_o", F.explode("_wanted").alias("_w")
    ).where((F.col("_w._b") == F.col("_b")) & (F.col("_w._in") == F.col("_rn")))
    return hits.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_w._i").alias("_i"), "_o"))).alias("_cuts"))


def label_by_cuts(df: DataFrame, order: Sequence[Column], sizes, out: str, by: Sequence[str] = (),
                  hashed: bool = False) -> DataFrame:
    """Add ``out`` = how many of the cut positions lie strictly before the row.

    With positions p0 <= p1 <= ..., the first p0 rows get 0, the next p1 - p0 get 1, and so on.
    The rows themselves are labelled map-side by comparing their key with the cut keys.
    """
    bucketed = with_buckets(df, order, by, hashed)
    cuts = cut_keys(bucketed, by, sizes)
    n_cuts = len(sizes(F.lit(0)))
    joined = attach(bucketed, cuts, by, ["_cuts"])
    # A position of 0 has no cut key: every row lies past it.
    passed = [
        F.coalesce((F.col("_o") > F.col("_cuts").getItem(i)).cast("int"), F.lit(1)) for i in range(n_cuts)
    ]
    total = passed[0]
    for term in passed[1:]:
        total = total + term
    return joined.withColumn(out, total).drop("_o", "_b", "_cuts")


def label_by_many(df: DataFrame, specs: Sequence[tuple]) -> DataFrame:
    """Several ``label_by_cuts`` over hashed orders at once: (out, order, sizes, rows that take part).

    Bucket counts and cut keys of all orders come from one pass each; rows that take no part in one get NULL there.
    """
    keys = [F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]) for _, order, _, _ in specs]
    entries = F.array(*[F.struct(F.lit(i).alias("_g"), cond.alias("_in"), key.alias("_o")) for i, ((_, _, _, cond), key) in enumerate(zip(specs, keys))])
    tall = df.select(F.explode(entries).alias("_e")).where("_e._in").select("_e._g", "_e._o")
    bucketed = tall.withColumn("_b", F.conv(F.substring(F.col("_o.k0"), 1, prefix_digits(df)), 16, 10).cast("int"))
    counts = [len(sizes(F.lit(0))) for _, _, sizes, _ in specs]

    def positions(n: Column) -> list[Column]:
        out = []
        for j in range(max(counts)):
            at = F.lit(None).cast("long")
            for i, (_, _, sizes, _) in enumerate(specs):
                if j < counts[i]:
                    at = F.when(F.col("_g") == i, sizes(n)[j].cast("long")).otherwise(at)
            out.append(at)
        return out

    # one entry per order
    cuts = cut_keys(bucketed, ["_g"], positions).agg(F.map_from_entries(F.collect_list(F.struct("_g", "_cuts"))).alias("_all"))
    out = attach(df, cuts, (), ["_all"])
    for i, (name, _, _, cond) in enumerate(specs):
        passed = sum((F.coalesce((keys[i] > F.try_element_at(F.try_element_at("_all", F.lit(i)), F.lit(j))).cast("int"), F.lit(1)) for j in range(counts[i])), F.lit(0))
        out = out.withColumn(name, F.when(cond, passed))
    return out.drop("_all")


def prefix_sums(df: DataFrame, order: Sequence[Column], values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """For each value column add ``<value>_before``, the sum over strictly smaller keys, and ``<value>_all``.

    The order key must be unique inside a group (aggregate ties first).
    """
    bucketed = with_buckets(df, order, by)
    totals = bucketed.groupBy(*by, "_b").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offsets = totals.select(
        *by, "_b",
        *[(F.sum(f"_t_{v}").over(group.orderBy("_b")) - F.col(f"_t_{v}")).alias(f"_off_{v}") for v in values],
        *[F.sum(f"_t_{v}").over(group).alias(f"{v}_all") for v in values],
    )
    inside = Window.partitionBy(*by, "_b").orderBy("_o")
    out = bucketed.join(offsets, [*by, "_b"])
    for v in values:
        out = out.withColumn(
            f"{v}_before", F.sum(v).over(inside) - F.col(v) + F.col(f"_off_{v}")
        )
    return out.drop("_o", "_b", *[f"_off_{v}" for v in values])
