"""Dataset variants: one positive per target, ``neg`` negatives, no candidate used twice.

The definition is sequential: targets take their most preferred free candidates in order.  That
outcome is the only fixpoint of "every target answers the current holders": a candidate is open to a
target when nobody earlier holds it, the target proposes to its ``neg`` best open candidates (none if
it has to be dropped), and each candidate is held by its earliest proposer.  By induction over the
order, a target is right one round after all earlier ones are, so any rounds of answers converge to it.

A target seldom looks far down its pool, so it starts with a short list, its most preferred candidates. The lists of a variant are cut
into blocks of consecutive targets, and each round solves all blocks at once by the sequential rule, a block to a task, given what
targets of earlier blocks picked in the round before. A block whose predecessors picked as before was solved right, so the first of the
blocks is settled in any case, and all of them once no pick changes. A target whose list ends before it is served gets a longer one, of
what the settled targets left. Settled targets leave the table, and what they took leaves the lists.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.hashing import pri
from pairloom.functions.ranks import dist_rank
from pairloom.operators.universe import ATTRIBUTES, as_pairs, pool_sizes, scarcity_pool
from pairloom.session import cut_lineage

#: Rows (target, candidate) that one task solves in order, and consecutive targets that are never cut apart.
BLOCK_ROWS, UNIT = 400_000, 64
#: How many times its need a target's first list holds, and how many blocks of a variant a round looks at.
PATIENCE, SPAN = 4, 32
#: By how much a list that was too short grows, and how many candidates of a target are sorted as one array.
LONGER, CHUNK = 4, 8192

MODES = ("sample_without_replacement", "sample_with_replacement", "use_all")


@dataclass(frozen=True)
class VariantPolicy:
    """Accepted settings; anything the engine would have to ignore is refused."""

    ratio: str = "1:1"
    min_pool_size: int = 5
    scarcity_mode: str = "drop_target"
    selection: str = "sample_without_replacement"
    order: str = "source"
    policy_id: str = "policy"
    variant_count: int = 25

    def __post_init__(self) -> None:
        if self.selection not in MODES:
            raise ValueError(f"unknown selection mode: {self.selection}")
        if self.order not in ("hash", "source"):
            raise ValueError(f"unknown target order: {self.order}")
        if self.negatives < 1:
            raise ValueError(f"ratio needs at least one negative: {self.ratio}")

    @property
    def negatives(self) -> int:
        positive, negative = self.ratio.split(":")
        if int(positive) != 1:
            raise ValueError("only ratios of the form 1:n have a meaning")
        return int(negative)


def variant_seed(policy_id: str, index: int) -> Column:
    """A stable 32-bit seed for the i-th variant of a policy."""
    return F.conv(F.substring(F.md5(F.lit(f"{policy_id}:{index}")), 1, 8), 16, 10).cast("long")


def _variant_rows(specs: Sequence[tuple[str, Column, int]]) -> Column:
    return F.explode(F.array(*[
        F.struct(F.lit(v).alias("variant_id"), s.cast("long").alias("seed"), F.lit(n).alias("neg")) for v, s, n in specs
    ])).alias("_v")


def _keys(policy: VariantPolicy, candidate: Column, pos: Column) -> list[Column]:
    """Preference keys of a target's candidate, one a list: a draw with replacement has an order of its own."""
    if policy.selection == "use_all":
        return [F.lpad(pos.cast("string"), 20, "0")]
    if policy.selection == "sample_with_replacement":
        return [pri(F.col("seed"), F.lit(i), F.col("target_id"), candidate) for i in range(policy.negatives)]
    return [pri(F.col("seed"), F.col("target_id"), candidate)]


_OWN = ["variant_id", "target_id", "_at"]
_LIST = [*_OWN, "neg", "_len", "_d", "_rn", "candidate_id", "_more"]


def _ended(rows: DataFrame) -> DataFrame:
    """The lists with a row of draw -1 for every target whose pool holds more, so that it is asked again when others took its whole list."""
    own = F.struct("_d", "_rn", "candidate_id")
    end = F.struct(F.lit(-1).alias("_d"), F.lit(0).alias("_rn"), F.lit(None).cast(rows.schema["candidate_id"].dataType).alias("candidate_id"))
    once = (F.col("_d") == 0) & (F.col("_rn") == 1) & F.col("_more")
    return rows.select(*_OWN, "neg", "_len", "_more", F.explode(F.when(once, F.array(own, end)).otherwise(F.array(own))).alias("_e")).select(
        *_OWN, "neg", "_len", "_e.*", "_more").select(*_LIST)


def _first_lists(pool: DataFrame, targets: DataFrame, policy: VariantPolicy) -> DataFrame:
    """The ``_len`` most preferred candidates of every target, best first as ``_rn``; ``_more`` where its pool holds others.

    Pools are gathered in arrays of about ``CHUNK`` candidates, of which only the best are rows again, whatever the number of variants.
    """
    chunk = F.pmod(F.xxhash64("candidate_id"), F.ceil(F.col("_size") / CHUNK)).alias("_chunk")
    chunks = pool.join(targets.select("target_id", "_size").distinct(), "target_id").groupBy("target_id", chunk).agg(
        F.collect_list(F.struct("candidate_id", "pos")).alias("_c"))

    def best(d: int) -> Column:
        keyed = F.transform("_c", lambda c: F.struct(_keys(policy, c["candidate_id"], c["pos"])[d].alias("p"), c["candidate_id"].alias("candidate_id")))
        return F.transform(F.slice(F.sort_array(keyed), F.lit(1), F.col("_len")), lambda c: F.struct(F.lit(d).alias("_d"), c["p"].alias("p"), c["candidate_id"].alias("candidate_id")))

    draws = len(_keys(policy, F.lit(None), F.lit(None)))
    some = chunks.join(targets, "target_id").select(*_OWN, "neg", "_len", "_size", F.explode(F.flatten(F.array(*[best(d) for d in range(draws)]))).alias("_e"))
    nth = Window.partitionBy(*_OWN, "_d").orderBy("p", "candidate_id")
    return _ended(some.select(*_OWN, "neg", "_len", "_size", "_e.*").withColumn("_rn", F.row_number().over(nth)).where("_rn <= _len").withColumn(
        "_more", F.col("_size") > F.col("_len")))


def _longer_lists(pool: DataFrame, targets: DataFrame, taken: DataFrame, policy: VariantPolicy) -> DataFrame:
    """Lists of ``_len`` of what ``taken`` (variant_id, candidate_id) leaves of the given targets' pools."""
    open_ = pool.join(targets, "target_id").join(taken, ["variant_id", "candidate_id"], "left_anti")
    keys = F.posexplode(F.array(*_keys(policy, F.col("candidate_id"), F.col("pos")))).alias("_d", "p")
    whole = Window.partitionBy(*_OWN, "_d")
    return _ended(open_.select("*", keys).withColumn("_rn", F.row_number().over(whole.orderBy("p", "candidate_id"))).withColumn(
        "_more", F.count(F.lit(1)).over(whole) > F.col("_len")).where("_rn <= _len"))


def conflict_components(pairs: DataFrame) -> DataFrame:
    """(variant_id, target_id, component): targets of a variant that share candidates, directly or over others.

    A target takes the least label around its candidates, and then the label of the target it is named after, so that a chain halves
    with every round.  Both steps are aggregates that combine map-side; rounds are written tables.
    """
    links = pairs.select("variant_id", "target_id", "candidate_id")
    own = ["variant_id", "target_id"]
    labels = cut_lineage(links.select(*own).distinct().withColumn("component", F.col("target_id")), "components")
    while True:
        around = links.join(labels, own).groupBy("variant_id", "candidate_id").agg(F.min("component").alias("component"))
        lower = links.join(around, ["variant_id", "candidate_id"]).groupBy(*own).agg(F.min("component").alias("_low"))
        named = lower.select("variant_id", F.col("target_id").alias("_low"), F.col("_low").alias("_lower"))
        after = cut_lineage(
            labels.join(lower, own).join(named, ["variant_id", "_low"], "left")
            .select(*own, "component", F.coalesce("_lower", "_low").alias("_next")), "components")
        if after.where("_next <> component").isEmpty():
            return labels
        labels = after.select(*own, F.col("_next").alias("component"))


def _in_turn(policy: VariantPolicy):
    """The sequential rule over one block's rows: picks, and a row without a candidate for a target whose list was too short."""
    drops, again = policy.scarcity_mode == "drop_target", policy.selection == "sample_with_replacement"

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        at, draw = rows["_at"].to_numpy(), rows["_d"].to_numpy()
        order = np.lexsort((rows["_rn"].to_numpy(), draw, at))
        at, draw, names = at[order], draw[order], rows["candidate_id"].to_numpy(dtype=object)[order].tolist()
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        taken, out = set(), []
        first = rows.iloc[order[starts]]
        facts = zip(starts.tolist(), [*starts[1:].tolist(), len(at)], first["target_id"], at[starts].tolist(), first["neg"], first["_len"], first["_more"])
        for a, b, target, place, neg, length, more in facts:
            a += draw[a] < 0
            if again:
                lists: dict[int, list] = {}
                for d, c in zip(draw[a:b].tolist(), names[a:b]):
                    if c not in taken:
                        lists.setdefault(d, []).append(c)
                free, best = len({c for own in lists.values() for c in own}), {d: own[0] for d, own in lists.items()}
                picks = [(i, best[i]) for i in range(neg) if i in best]
                short = len(picks) < neg or drops and free < neg
            else:
                picks = []
                for c in names[a:b]:
                    if c not in taken:
                        picks.append((len(picks), c))
                        if len(picks) == neg:
                            break
                short = len(picks) < neg
            if short and more:
                out.append((target, place, None, -1, length))
            if short and drops:
                continue
            taken.update(c for _, c in picks if c is not None)
            out += [(target, place, c, i, length) for i, c in picks]
        made = pd.DataFrame(out, columns=["target_id", "_at", "candidate_id", "draw", "_len"])
        made.insert(0, "variant_id", rows["variant_id"].iloc[0])
        return made

    return solve


def _unit() -> Column:
    return F.floor((F.col("_at") - 1) / UNIT)


def _blocks(lists: DataFrame) -> DataFrame:
    """(variant_id, _unit, _block, _start, _end): consecutive targets of about ``BLOCK_ROWS`` rows, numbered from 1 in each variant."""
    sizes = lists.groupBy("variant_id", _unit().alias("_unit")).agg(F.count(F.lit(1)).alias("n"))
    # one row per unit of targets
    before = F.sum("n").over(Window.partitionBy("variant_id").orderBy("_unit")) - F.col("n")
    cut = sizes.withColumn("_cut", F.floor(before / BLOCK_ROWS))
    whole = Window.partitionBy("variant_id", "_cut")
    return cut_lineage(cut.select(
        "variant_id", "_unit", F.dense_rank().over(Window.partitionBy("variant_id").orderBy("_cut")).alias("_block"),
        (F.min("_unit").over(whole) * UNIT + 1).alias("_start"), ((F.max("_unit").over(whole) + 1) * UNIT).alias("_end")), "blocks")


def _solve(lists: DataFrame, before: DataFrame | None, policy: VariantPolicy) -> tuple[DataFrame, dict, bool]:
    """(answers, cuts, done): the answers of the first ``SPAN`` blocks given the picks ``before``, up to which place of each variant they
    are settled, and whether that is all."""
    blocks = _blocks(lists)
    rows = lists.withColumn("_unit", _unit()).join(blocks.where(F.col("_block") <= SPAN), ["variant_id", "_unit"])
    if before is not None:
        held = before.groupBy("variant_id", "candidate_id").agg(F.min("_at").alias("_holder"))
        rows = rows.join(held, ["variant_id", "candidate_id"], "left").where(F.col("_holder").isNull() | (F.col("_holder") >= F.col("_start")))
    names = [*_OWN, "candidate_id", "draw", "_len"]
    types = {**{c: lists.schema[c].dataType.simpleString() for c in (*_OWN, "candidate_id", "_len")}, "draw": "int"}
    answers = cut_lineage(rows.select("_block", *_LIST).groupBy("variant_id", "_block").applyInPandas(
        _in_turn(policy), ", ".join(f"{c} {types[c]}" for c in names)), "answers")
    tagged = answers.where("draw >= 0").withColumn("_tag", F.lit(1))
    if before is not None:
        tagged = tagged.unionByName(before.withColumn("_tag", F.lit(-1)))
    same = tagged.groupBy(*_OWN, "candidate_id", "draw").agg(F.sum("_tag").alias("_tag"))
    changed = same.where("_tag <> 0").groupBy("variant_id").agg(F.min("_at").alias("_changed"))
    short = answers.where("draw < 0").groupBy("variant_id").agg(F.min("_at").alias("_short"))
    seen = blocks.groupBy("variant_id").agg(F.max(F.when(F.col("_block") <= SPAN, F.col("_end"))).alias("_seen"), F.max("_end").alias("_last"))
    ends = blocks.select("variant_id", F.col("_start").alias("_from"), F.col("_end").alias("_to")).distinct()
    place = seen.join(changed, "variant_id", "left").join(short, "variant_id", "left")
    placed = place.join(ends, (ends["variant_id"] == place["variant_id"]) & F.col("_changed").between(F.col("_from"), F.col("_to")), "left").select(
        place["variant_id"], F.least(F.coalesce("_to", "_seen"), F.col("_short") - 1).alias("_cut"), "_last").collect()  # one row a variant
    return answers, {r["variant_id"]: r["_cut"] for r in placed}, all(r["_cut"] >= r["_last"] for r in placed)


def _settled(answers: DataFrame, cuts: dict) -> Column:
    limits = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
    return F.col("_at") <= F.coalesce(F.try_element_at(limits, F.col("variant_id")), F.lit(0))


def _next_picks(pool: DataFrame, targets: DataFrame, lists: DataFrame, answers: DataFrame, cuts: dict, picks: Sequence[DataFrame],
                policy: VariantPolicy) -> tuple[DataFrame, DataFrame, dict, bool]:
    """The lists of the targets not settled yet, and the next answers to them."""
    settled, key = _settled(answers, cuts), ["variant_id", "candidate_id"]
    short = answers.where("draw < 0").select(*_OWN, (F.col("_len") * LONGER).alias("_len"))
    kept = lists.where(~settled).join(short.select(*_OWN), _OWN, "left_anti").join(picks[-1].select(*key), key, "left_anti")
    taken = reduce(DataFrame.unionByName, picks).select(*key)
    longer = _longer_lists(pool, targets.drop("_len").join(short, _OWN), taken, policy)
    rest = cut_lineage(kept.select(*_LIST).unionByName(longer), "lists")
    return rest, *_solve(rest, answers.where((F.col("draw") >= 0) & ~settled), policy)


def _fixpoint(pool: DataFrame, targets: DataFrame, policy: VariantPolicy) -> DataFrame:
    lists = cut_lineage(_first_lists(pool, targets, policy), "lists")
    answers, cuts, done = _solve(lists, None, policy)
    picks: list[DataFrame] = []
    while True:  # every round settles at least the first target left, or gives it a longer list, so the loop ends
        picks.append(answers.where((F.col("draw") >= 0) & _settled(answers, cuts)))
        if done:
            return reduce(DataFrame.unionByName, picks)
        lists, answers, cuts, done = _next_picks(pool, targets, lists, answers, cuts, picks, policy)


def _generate(universe: DataFrame, policy: VariantPolicy, specs: Sequence[tuple[str, Column, int]]) -> tuple[DataFrame, DataFrame]:
    widest = replace(policy, ratio=f"1:{max(n for _, _, n in specs)}")
    # The pool is written once, whatever the number of variants; sampling is on distinct candidates.
    pairs = as_pairs(universe)
    facts = [c for c in ATTRIBUTES if c in pairs.columns]
    pool = cut_lineage(pairs.groupBy("target_id", "candidate_id").agg(
        F.min("pos").alias("pos"), F.count(F.lit(1)).alias("candidate_count"), *[F.min(c).alias(c) for c in facts]), "pool")
    if "candidate_ids" not in universe.columns:  # a long universe is read once: its sizes follow from the pool
        sized = pool.groupBy("target_id").agg(F.sum("candidate_count").alias("candidate_count"), *[F.min(c).alias(c) for c in facts])
    else:
        sized = pool_sizes(universe)
    kept, short = scarcity_pool(sized, policy.min_pool_size, policy.scarcity_mode)
    targets = kept.select("*", _variant_rows(specs)).select("*", "_v.*").drop("_v")
    rank = (
        F.lpad(F.col("source_row_id").cast("string"), 20, "0") if policy.order == "source"
        else pri(F.col("seed"), F.col("target_id"))
    )
    # short lists: of what a target needs, or of some to each draw
    first = F.lit(2 * PATIENCE) if policy.selection == "sample_with_replacement" else F.col("neg") * PATIENCE
    targets = targets.select("variant_id", "target_id", "seed", "neg", first.cast("int").alias("_len"), rank.alias("_o"))
    ranked = dist_rank(targets.withColumnRenamed("_o", "_by"), [F.col("_by"), F.col("target_id")], ["variant_id"], policy.order == "hash", "_at")
    pool = pool.select("target_id", "candidate_id", "pos")
    counts = pool.groupBy("target_id").agg(F.count(F.lit(1)).alias("_size"))
    targets = cut_lineage(ranked.drop("_by").join(counts, "target_id", "left"), "targets")
    picks = _fixpoint(pool, targets, widest)
    negatives = picks.select(
        "variant_id", "target_id", F.col("candidate_id").alias("protein_id"), F.lit("negative").alias("role"), "draw"
    )
    filled = negatives.groupBy("variant_id", "target_id").agg(F.count(F.lit(1)).alias("_n"))
    answered = targets.join(filled, ["variant_id", "target_id"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    lacking = F.col("_n") < F.col("neg")
    drops = policy.scarcity_mode == "drop_target"
    positives = (answered.where(~lacking) if drops else answered).select(
        "variant_id", "target_id", F.col("target_id").alias("protein_id"), F.lit("positive").alias("role"),
        F.lit(-1).alias("draw"),
    )
    assignments = positives.unionByName(negatives).withColumn("paired_target_id", F.col("target_id"))
    late = answered.where(lacking).select(
        "variant_id", "target_id", F.lit("insufficient_candidates_for_ratio").alias("reason"),
        F.format_string("Need %d unique candidates", "neg").alias("details"),
    )
    early = short.select("*", _variant_rows(specs)).select(
        F.col("_v.variant_id").alias("variant_id"), "target_id", "reason", "details"
    )
    return assignments, early.unionByName(late)


def variant_generate(universe: DataFrame, policy: VariantPolicy = VariantPolicy(), seed: int = 42,
                     variant_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(assignments, scarcity events) of one variant."""
    variant_id = variant_id or f"variant_{seed:06d}"
    return _generate(universe, policy, [(variant_id, F.lit(seed), policy.negatives)])


def variants_multi(universe: DataFrame, policy: VariantPolicy = VariantPolicy(), n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All variants of a policy in one fixpoint; ``variant_id`` is a grouping key."""
    n = policy.variant_count if n is None else n
    specs = [
        (f"{policy.policy_id}_variant_{i:04d}", variant_seed(policy.policy_id, i), policy.negatives) for i in range(n)
    ]
    return _generate(universe, policy, specs)


def variants_ratio_families(universe: DataFrame, policy: VariantPolicy = VariantPolicy(),
                            ratios: Sequence[str] = ("1:1", "1:3", "1:5"), seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """One variant per ratio, all from the same seed."""
    specs = [
        (f"{policy.policy_id}_ratio_{r.replace(':', '_')}", F.lit(seed), replace(policy, ratio=r).negatives) for r in ratios
    ]
    return _generate(universe, policy, specs)


def variant_manifest(assignments: DataFrame, events: DataFrame) -> DataFrame:
    """Counts and realized ratio per variant."""
    roles = assignments.groupBy("variant_id").agg(
        F.sum((F.col("role") == "positive").cast("long")).alias("total_positive_instances"),
        F.sum((F.col("role") == "negative").cast("long")).alias("total_negative_instances"),
    )
    # an event row of a kept target (use_available) is a note, not a drop
    included = assignments.where("role = 'positive'").select("variant_id", "target_id")
    dropped = (
        events.join(included, ["variant_id", "target_id"], "left_anti")
        .groupBy("variant_id").agg(F.count_distinct("target_id").alias("targets_dropped"))
    )
    out = roles.join(dropped, "variant_id", "full_outer").na.fill(0)
    pos, neg = F.col("total_positive_instances"), F.col("total_negative_instances")
    ratio = F.when(pos > 0, F.concat_ws(":", pos.cast("string"), F.floor(neg / pos).cast("string"))).otherwise("0:0")
    return out.select(
        "variant_id", pos.alias("targets_included"), "targets_dropped", pos, neg, ratio.alias("ratio_realized")
    )


def organism_distribution(assignments: DataFrame, universe: DataFrame) -> DataFrame:
    """Assignment rows per organism of the target; targets without an organism do not count."""
    per_target = assignments.groupBy("variant_id", "target_id").agg(F.count(F.lit(1)).alias("rows"))
    organisms = pool_sizes(universe).where("organism is not null and organism <> ''").select("target_id", "organism")
    return per_target.join(organisms, "target_id").groupBy("variant_id", "organism").agg(F.sum("rows").alias("n"))


def bundle_summary(assignments: DataFrame, events: DataFrame) -> DataFrame:
    """Instance, role, split and drop counts of split assignments, one row per variant."""
    def in_split(name: str) -> Column:
        return F.sum((F.col("split") == name).cast("long")).alias(f"{name}_count")

    per = assignments.groupBy("variant_id").agg(
        F.count(F.lit(1)).alias("total_instances"), in_split("train"), in_split("val"), in_split("test")
    )
    return variant_manifest(assignments, events).join(per, "variant_id", "left").na.fill(0).select(
        "variant_id", "total_instances", F.col("total_positive_instances").alias("positive_count"),
        F.col("total_negative_instances").alias("negative_count"), "train_count", "val_count", "test_count",
        "targets_included", "targets_dropped", "ratio_realized",
    )


def variant_distinct_ids(assignments: DataFrame, role: str | None = None) -> DataFrame:
    """Distinct targets and proteins per variant, optionally of one role."""
    scoped = assignments if role is None else assignments.where(F.col("role") == role)
    ids = F.explode(F.array(
        F.struct(F.lit("target").alias("kind"), F.col("target_id").alias("id")),
        F.struct(F.lit("protein").alias("kind"), F.col("protein_id").alias("id")),
    ))
    return scoped.select("variant_id", ids.alias("_i")).select("variant_id", "_i.*").distinct()
