"""Sample splits.  Random splits cut the md5 order of the keys at exact positions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.hashing import pri
from pairloom.functions.ranks import label_by_cuts, label_by_many
from pairloom.functions.scalars import normalize_organism
from pairloom.operators.quality import split_csv_duplicates, split_leakage_check
from pairloom.session import cut_lineage

# Spellings that stand for one organism.
ORGANISM_ALIASES = {
    "human": ["human", "homo sapiens", "h sapiens", "humans"],
    "homo sapiens": ["human", "homo sapiens", "h sapiens", "humans"],
    "mouse": ["mouse", "mus musculus", "m musculus", "mice"],
    "mus musculus": ["mouse", "mus musculus", "m musculus", "mice"],
    "ecoli": ["ecoli", "e coli", "escherichia coli", "eacoli"],
    "eacoli": ["ecoli", "e coli", "escherichia coli", "eacoli"],
    "escherichia coli": ["ecoli", "e coli", "escherichia coli", "eacoli"],
    "yeast": ["yeast", "saccharomyces cerevisiae", "baker s yeast"],
    "saccharomyces cerevisiae": ["yeast", "saccharomyces cerevisiae", "baker s yeast"],
}


def _hash_order(seed, key: str) -> list[Column]:
    return [pri(seed, F.col(key)), F.col(key)]


def _size(n: Column, share: float) -> Column:
    """``int(n * share)`` in double arithmetic."""
    return F.floor(n.cast("double") * F.lit(float(share)))


def _named(part: Column, names: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), part + 1)


def split_random(ids: DataFrame, key: str = "accession", test_size: float = 0.2, val_size: float = 0.1,
                 seed: int = 42) -> DataFrame:
    """First ``int(n*test)`` of the shuffle to test, next ``int(n*val)`` to val, the rest to train."""
    cut = label_by_cuts(ids, _hash_order(seed, key), lambda n: [
        _size(n, test_size), _size(n, test_size) + _size(n, val_size)
    ], "_part", hashed=True)
    return cut.withColumn("split", _named(F.col("_part"), ["test", "val", "train"])).drop("_part")


def split_train_val(ids: DataFrame, key: str = "accession", test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Hold-out before fitting: train and validation only."""
    out = split_random(ids, key, test_size, 0.0, seed)
    return out.withColumn("split", F.when(F.col("split") == "test", "validation").otherwise("train"))


def split_multi_seed(ids: DataFrame, key: str = "accession", main_seed: int = 42, n_seeds: int = 3,
                     test_size: float = 0.2, val_size: float = 0.1) -> DataFrame:
    """The same split for seeds ``main, main+1, ...`` in one plan."""
    spread = ids.withColumn("seed", F.explode(F.sequence(F.lit(main_seed), F.lit(main_seed + n_seeds - 1))))
    cut = label_by_cuts(spread, _hash_order(F.col("seed"), key), lambda n: [
        _size(n, test_size), _size(n, test_size) + _size(n, val_size)
    ], "_part", by=["seed"], hashed=True)
    return cut.withColumn("split", _named(F.col("_part"), ["test", "val", "train"])).drop("_part")


def _fold_ends(n: Column, n_splits: int) -> list[Column]:
    """Ends of all folds but the last; the first ``n mod k`` folds hold one row more."""
    base, extra = F.floor(n / n_splits), n % n_splits
    return [base * i + F.least(extra, F.lit(i)) for i in range(1, n_splits)]


def _written_folds(ids: DataFrame, key: str, n_splits: int, seed: int) -> DataFrame:
    """The folds as a table: finding the validation head passes over them several times."""
    return cut_lineage(fold_of(ids, key, n_splits, seed), "folds")


def fold_of(ids: DataFrame, key: str, n_splits: int, seed: int) -> DataFrame:
    """Add ``_fold``, the shuffled fold of each row."""
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    return label_by_cuts(ids, _hash_order(seed, key), lambda n: _fold_ends(n, n_splits), "_fold", hashed=True)


def _validation_head(parts: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Turn the first ``max(1, int(0.1 n))`` train rows in key order into val (none of a single row)."""
    train = parts.where("split = 'train'").drop("split")
    head = label_by_cuts(train, [F.col(key)], lambda n: [
        F.when(n > 1, F.greatest(F.lit(1).cast("long"), _size(n, 0.1))).otherwise(F.lit(0).cast("long"))
    ], "_part", by=by)
    relabelled = head.withColumn("split", _named(F.col("_part"), ["val", "train"])).drop("_part")
    return parts.where("split <> 'train'").unionByName(relabelled)


def split_kfold(ids: DataFrame, key: str = "accession", n_splits: int = 5, fold_index: int = 0,
                seed: int = 42) -> DataFrame:
    """Chosen fold to test, head of the remaining rows in key order to val."""
    chosen = fold_index % n_splits
    parts = _written_folds(ids, key, n_splits, seed).withColumn(
        "split", F.when(F.col("_fold") == chosen, "test").otherwise("train")
    ).drop("_fold")
    return _validation_head(parts, key)


def kfold_all(ids: DataFrame, key: str = "accession", n_splits: int = 5, seed: int = 42) -> DataFrame:
    """Every fold as test once, with a ``fold`` column."""
    folds = _written_folds(ids, key, n_splits, seed).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    parts = folds.withColumn("split", F.when(F.col("_fold") == F.col("fold"), "test").otherwise("train")).drop("_fold")
    return _validation_head(parts, key, ["fold"])


def split_csv(ids: DataFrame, table: DataFrame, accession_col: str = "accession", split_col: str = "split") -> DataFrame:
    """Split given by a table; other values and unknown ids are left out."""
    value = F.col(split_col).cast("string")
    named = table.select(
        F.col(accession_col).alias("accession"),
        F.when(value == "train", "train").when(value.isin("val", "validation"), "val").when(value == "test", "test").alias("split"),
    ).where("split is not null").distinct()
    return named.join(ids.select("accession"), "accession", "left_semi")


def in_groups(organism: Column, groups: Sequence[str], aliases: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Substring match of the normalized organism against any alias of any group; the groups are configuration."""
    aliases = ORGANISM_ALIASES if aliases is None else aliases
    tokens: list[str] = []
    for group in groups:
        plain = " ".join("".join(ch if ch in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for ch in group.lower()).split())
        tokens += [t for t in aliases.get(plain, [plain]) if t]
    match = F.lit(False)
    for token in dict.fromkeys(tokens):
        match = match | normalize_organism(organism).contains(token)
    return match


def organism_match(df: DataFrame, column: str, groups: Sequence[str],
                   aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Add ``matched_group``, the first group that matches, else NULL."""
    first = F.coalesce(*[F.when(in_groups(F.col(column), [g], aliases), F.lit(g)) for g in groups])
    return df.withColumn("matched_group", first)


def _is_rest(group: str) -> bool:
    return group.lower().replace("_", " ").split() == ["all", "others"]


def split_organism(proteins: DataFrame, test: Sequence[str] = (), train_test: Sequence[str] = (),
                   val: Sequence[str] = (), test_size: float = 0.2, seed: int = 42,
                   aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Groups decide in the order test, train/test, val, val rest, test rest, train.

    Rows of the train/test groups are then split at random by ``test_size``.
    """
    organism = F.col("organism")

    def hit(groups: Sequence[str]) -> Column:
        return in_groups(organism, [g for g in groups if not _is_rest(g)], aliases)

    placed = (
        F.when(hit(test), "test")
        .when(hit(train_test), "pool")
        .when(hit(val), "val")
        .when(F.lit(any(map(_is_rest, val))), "val")
        .when(F.lit(any(map(_is_rest, test))), "test")
        .otherwise("train")
    )
    parts = proteins.withColumn("split", placed)
    pool = split_random(parts.where("split = 'pool'").drop("split"), "accession", test_size, 0.0, seed)
    return parts.where("split <> 'pool'").unionByName(pool)


@dataclass(frozen=True)
class IndependentSplit:
    """Validation first, then train/test on the rest, then a zero-shot holdout from the full set."""

    validation: str = "random"
    val_size: float = 0.1
    val_seed: int = 42
    val_organisms: Sequence[str] = ()
    validation_values: Sequence[str] = ("val", "validation")
    train_test: str = "random"
    test_size: float = 0.2
    train_test_seed: int = 42
    n_splits: int = 5
    fold_index: int = 0
    scoped_organisms: Sequence[str] = ()
    zero_shot: str | None = None
    zero_size: float = 0.1
    zero_seed: int = 42
    zero_organisms: Sequence[str] = ()
    zero_values: Sequence[str] = ("zero_shot", "zs")
    aliases: Mapping[str, Sequence[str]] = field(default_factory=lambda: ORGANISM_ALIASES)


def _from_table(table: DataFrame | None, values: Sequence[str], ids: DataFrame) -> DataFrame:
    if table is None:
        raise ValueError("this strategy needs a split table")
    repeated = split_csv_duplicates(table, values).collect()
    if repeated:
        raise ValueError(f"Duplicate accession assignments: {[r['accession'] for r in repeated]}")
    listed = table.where(F.col("split").cast("string").isin(list(values))).select("accession").distinct()
    return listed.join(ids.select("accession"), "accession", "left_semi")


def _head(out: str, share: float, seed: int) -> tuple:
    """The first ``int(n * share)`` rows of a shuffle, as a cut for ``label_by_many``."""
    return out, _hash_order(seed, "accession"), lambda n: [_size(n, share)], F.lit(True)


def _listed_flag(ids: DataFrame, listed: DataFrame, out: str) -> DataFrame:
    return ids.join(listed.withColumn(out, F.lit(True)), "accession", "left").withColumn(out, F.coalesce(out, F.lit(False)))


def split_independent(proteins: DataFrame, conf: IndependentSplit = IndependentSplit(),
                      validation_table: DataFrame | None = None, zero_table: DataFrame | None = None,
                      check: bool = True) -> DataFrame:
    """(accession, organism, split) with split in train, val, test, zero_shot."""
    organism = F.col("organism")
    flagged = base = proteins.select("accession", "organism")
    cuts, val, zero = [], F.col("_val"), F.lit(False)
    if conf.validation == "random":
        cuts.append(_head("_val", conf.val_size, conf.val_seed))
        val = F.col("_val") == 0
    elif conf.validation == "organism":
        named = [g for g in conf.val_organisms if not _is_rest(g)]
        rest = F.lit(any(map(_is_rest, conf.val_organisms)))
        val = in_groups(organism, named, conf.aliases) | (rest & ~in_groups(organism, conf.scoped_organisms, conf.aliases))
    elif conf.validation == "csv":
        listed = _from_table(validation_table, conf.validation_values, base)
        if listed.isEmpty():
            raise ValueError("validation table selects no sample")
        flagged = _listed_flag(flagged, listed, "_val")
    else:
        raise ValueError(f"unknown validation strategy: {conf.validation}")

    if conf.zero_shot == "random":
        cuts.append(_head("_zero", conf.zero_size, conf.zero_seed))
        zero = F.col("_zero") == 0
    elif conf.zero_shot == "organism":
        zero = in_groups(organism, conf.zero_organisms, conf.aliases)
    elif conf.zero_shot == "csv":
        flagged = _listed_flag(flagged, _from_table(zero_table, conf.zero_values, base), "_zero")
        zero = F.col("_zero")
    elif conf.zero_shot is not None:
        raise ValueError(f"unknown zero_shot strategy: {conf.zero_shot}")

    in_scope = in_groups(organism, conf.scoped_organisms, conf.aliases) if conf.scoped_organisms else F.lit(True)
    if conf.train_test == "random":
        _, order, sizes, _ = _head("_test", conf.test_size, conf.train_test_seed)
        chosen = 0
    elif conf.train_test == "cross_validation":
        if conf.n_splits < 2:
            raise ValueError("n_splits must be at least 2")
        order, sizes = _hash_order(conf.train_test_seed, "accession"), lambda n: _fold_ends(n, conf.n_splits)
        chosen = conf.fold_index % conf.n_splits
    else:
        raise ValueError(f"unknown train_test strategy: {conf.train_test}")
    # Cuts that do not depend on another are found in the same passes; the test part is drawn from what validation leaves.
    part = "_test", order, sizes, F.coalesce(~val & in_scope, F.lit(False))
    if conf.validation == "random":
        flagged = label_by_many(label_by_many(flagged, cuts), [part])
    else:
        flagged = label_by_many(flagged, [*cuts, part])
    split = (
        F.when(zero, "zero_shot").when(val, "val").when(F.col("_test") == chosen, "test").otherwise("train")
    )
    out = cut_lineage(flagged.select("accession", "organism", split.alias("split")), "split")
    if check:
        problems = split_leakage_check(out, base).take(10)
        if problems:
            raise ValueError(f"split leakage or coverage mismatch: {problems}")
    return out


def split_group_by_target(assignments: DataFrame, train: float = 0.7, val: float = 0.15, test: float = 0.15,
                          seed: int = 42) -> DataFrame:
    """Every assignment follows its target, so no target spans two splits."""
    if abs(train + val + test - 1.0) > 0.01:
        raise ValueError(f"ratios must sum to 1, got {train + val + test}")
    targets = assignments.select("variant_id", "target_id").distinct()
    cut = label_by_cuts(targets, _hash_order(seed, "target_id"), lambda n: [
        _size(n, train), _size(n, train) + _size(n, val)
    ], "_part", by=["variant_id"], hashed=True)
    named = cut.withColumn("split", _named(F.col("_part"), ["train", "val", "test"])).drop("_part")
    return assignments.join(named, ["variant_id", "target_id"])


def train_plus_val(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("split").isin("train", "val", "validation"))
