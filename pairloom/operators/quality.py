"""Data-quality checks; each one is a single aggregate over its table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPORT = "check string, column string, ok boolean, observed double"

KINDS = {
    "str": (T.StringType,),
    "int": (T.IntegerType, T.LongType, T.ShortType, T.ByteType),
    "float": (T.DoubleType, T.FloatType),
}


@dataclass(frozen=True)
class TableSpec:
    """Expectations about one table."""

    required_columns: Sequence[str] = ()
    types: Mapping[str, str] = field(default_factory=dict)
    ranges: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    unique: Sequence[str] = ()
    null_threshold: float = 0.0


def dq_required_columns(df: DataFrame, required: Sequence[str]) -> bool:
    return set(required) <= set(df.columns)


def dq_types(df: DataFrame, types: Mapping[str, str]) -> bool:
    """Declared kind against the schema; columns that are absent are not judged."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    return all(isinstance(actual[c], KINDS[k]) for c, k in types.items() if c in actual)


def _missing(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def _null_share(df: DataFrame) -> Column:
    cells = F.count(F.lit(1)) * len(df.columns)
    missing = sum((F.sum(_missing(df, c).cast("long")) for c in df.columns), F.lit(0))
    return F.coalesce(missing.cast("double") / F.nullif(cells, F.lit(0)), F.lit(0.0))


def _out_of_range(df: DataFrame, name: str, low: float | None, high: float | None) -> Column:
    column = F.col(f"`{name}`")
    bad = F.lit(False)
    if low is not None:
        bad = bad | (column < low)
    if high is not None:
        bad = bad | (column > high)
    return F.coalesce(F.sum((~_missing(df, name) & bad).cast("long")), F.lit(0)).cast("double")


def _report_row(check: str, column: str, ok: Column, observed: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"), F.lit(column).alias("column"),
        ok.alias("ok"), observed.cast("double").alias("observed"),
    )


def dq_null_proportion(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Share of NULL or NaN cells; an empty table has none."""
    return df.agg(_null_share(df).alias("observed")).select(
        F.lit("null_proportion").alias("check"), (F.col("observed") <= threshold).alias("ok"), "observed"
    )


def dq_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Number of values outside [low, high]; NULL and NaN never fail, an unknown column does."""
    if column not in df.columns:
        return df.sparkSession.range(1).select(
            F.lit("range").alias("check"), F.lit(False).alias("ok"), F.lit(None).cast("double").alias("observed")
        )
    return df.agg(_out_of_range(df, column, low, high).alias("observed")).select(
        F.lit("range").alias("check"), (F.col("observed") == 0).alias("ok"), "observed"
    )


def duplicate_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, NULL being a value."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dq_unique(df: DataFrame, column: str) -> DataFrame:
    """Number of surplus rows, i.e. rows minus distinct values."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("double").alias("observed")).select(
        F.lit("unique").alias("check"), (F.col("observed") == 0).alias("ok"), "observed"
    )


def dq_report(df: DataFrame, spec: TableSpec | None = None) -> DataFrame:
    """Every check of the spec as rows; the null and range checks share one scan.

    Without a spec only the null check is made.
    """
    spec = spec or TableSpec()
    spark = df.sparkSession
    fixed = [("required_columns", "", dq_required_columns(df, spec.required_columns), None)] if spec.required_columns else []
    if spec.types:
        fixed.append(("types", "", dq_types(df, spec.types), None))
    fixed += [("range", c, False, None) for c in spec.ranges if c not in df.columns]
    scanned = {"_nulls": _null_share(df)}
    scanned |= {
        f"_r{i}": _out_of_range(df, c, *bounds)
        for i, (c, bounds) in enumerate(spec.ranges.items()) if c in df.columns
    }
    rows = [_report_row("null_proportion", "", F.col("_nulls") <= spec.null_threshold, F.col("_nulls"))]
    rows += [
        _report_row("range", c, F.col(f"_r{i}") == 0, F.col(f"_r{i}"))
        for i, c in enumerate(spec.ranges) if c in df.columns
    ]
    out = df.agg(*[e.alias(n) for n, e in scanned.items()]).select(F.inline(F.array(*rows)))
    for column in spec.unique:
        out = out.unionByName(dq_unique(df, column).select("check", F.lit(column).alias("column"), "ok", "observed"))
    if fixed:
        out = out.unionByName(spark.createDataFrame(fixed, REPORT))
    return out


def universe_validate(universe: DataFrame) -> DataFrame:
    """One row per problem: empty universe, duplicate or empty target, target without candidates."""
    empty = universe.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit(None).cast("string").alias("target_id"), F.lit("empty universe").alias("error")
    )
    blank = F.trim(F.coalesce("target_id", F.lit(""))) == ""
    row_errors = universe.select(
        "target_id",
        F.explode(F.array_compact(F.array(
            F.when(blank, F.lit("empty target_id")),
            F.when(F.coalesce(F.size("candidate_ids"), F.lit(0)) < 1, F.lit("no candidates")),
        ))).alias("error"),
    )
    repeated = duplicate_keys(universe.where(~blank), ["target_id"]).select(
        "target_id", F.lit("duplicate target_id").alias("error")
    )
    return row_errors.unionByName(repeated).unionByName(empty)


def vectors_validate(vectors: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """Row count, equal vector lengths and unique accessions, as (error, n)."""
    # Collapse per accession first, so one hot accession is combined map-side.
    per_key = vectors.groupBy("accession").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high")
    )
    facts = per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum((F.col("rows") > 1).cast("long")).alias("repeated"),
    )
    checks = [
        F.when(F.col("repeated") > 0, F.struct(F.lit("duplicate accession").alias("error"), F.col("repeated").alias("n"))),
        F.when(F.col("low") != F.col("high"),
               F.struct(F.lit("unequal vector length").alias("error"), (F.col("high") - F.col("low")).cast("long").alias("n"))),
    ]
    if expected_rows is not None:
        checks.append(F.when(F.col("rows") != expected_rows,
                             F.struct(F.lit("row count").alias("error"), F.col("rows").alias("n"))))
    return facts.select(F.inline(F.array_compact(F.array(*checks))))


def split_leakage_check(samples: DataFrame, all_ids: DataFrame) -> DataFrame:
    """Accessions in more than one split, outside every split, or unknown to the dataset."""
    placed = samples.groupBy("accession").agg(F.min("split").alias("a"), F.max("split").alias("z"))
    known = all_ids.select("accession").distinct().withColumn("known", F.lit(True))
    both = placed.join(known, "accession", "full_outer")
    kind = (
        F.when(F.col("a") != F.col("z"), "overlap")
        .when(F.col("a").isNull(), "missing")
        .when(F.col("known").isNull(), "extra")
    )
    return both.select(kind.alias("kind"), "accession").where("kind is not null")


def split_csv_duplicates(split_table: DataFrame, allowed: Sequence[str], accession: str = "accession",
                         split: str = "split", examples: int | None = None) -> DataFrame:
    """Accessions listed under several allowed split values: all of them, or the first ``examples``."""
    scoped = split_table.where(F.col(split).cast("string").isin(list(allowed)) & F.col(accession).isNotNull())
    # distinct (accession, split) first: repeated rows of one accession are combined before the shuffle
    bad = (
        scoped.select(F.col(accession).alias("accession"), F.col(split).cast("string").alias("split")).distinct()
        .groupBy("accession").agg(F.count(F.lit(1)).alias("n_values")).where("n_values > 1")
    )
    return bad if examples is None else bad.orderBy("accession").limit(examples)


def probs_validate(probs: DataFrame, problem_type: str, n_classes: int, atol: float = 1e-3) -> DataFrame:
    """(model_id, error, n) for wrong width, values outside [0, 1] and multiclass rows not summing to 1."""
    row_sum = F.aggregate("probs", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    wrong_width = F.size("probs") != n_classes
    outside = (F.array_min("probs") < -1e-6) | (F.array_max("probs") > 1.0 + 1e-6)
    # The relative part is the comparison default of the numeric library the contract was written for.
    off_one = F.abs(row_sum - 1.0) > atol + 1e-5
    checks = {"class count": wrong_width, "out of range": outside}
    if problem_type == "multiclass":
        checks["row sum"] = off_one
    counted = probs.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(F.coalesce(c, F.lit(True)).cast("long")).alias(f"e{i}") for i, c in enumerate(checks.values())],
    )
    pairs = [
        F.struct(F.lit(name).alias("error"), F.col(f"e{i}").alias("n")) for i, name in enumerate(checks)
    ]
    return counted.select("model_id", F.inline(F.array(*pairs))).where("n > 0")


def model_contract_check(models: DataFrame, min_models: int = 2, same_normalization: bool = False) -> DataFrame:
    """Errors when ensemble members disagree on problem type or class order, or are too few."""
    classes = F.to_json("classes")
    facts = models.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("problem_type").alias("types"),
        F.count_distinct(classes).alias("orders"),
        F.count_distinct(F.size("classes")).alias("widths"),
        F.count_distinct(F.coalesce("normalization", F.lit("none"))).alias("norms")
        if same_normalization else F.lit(1).alias("norms"),
    )
    checks = [
        F.when(F.col("n") < min_models, F.lit(f"fewer than {min_models} models")),
        F.when(F.col("types") > 1, F.lit("problem type differs")),
        F.when(F.col("orders") > 1, F.lit("class order differs")),
        F.when(F.col("widths") > 1, F.lit("class count differs")),
        F.when(F.col("norms") > 1, F.lit("normalization differs")),
    ]
    return facts.select(F.explode(F.array_compact(F.array(*checks))).alias("error"))


def seed_coverage(expected: DataFrame, observed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Expected combinations that were never observed."""
    return expected.select(*on).distinct().join(observed.select(*on).distinct(), list(on), "left_anti")


def run_consistency(pairs: DataFrame, assigned: DataFrame) -> DataFrame:
    """Targets of the final pairs that have no assignment row."""
    return pairs.select("tp_id").distinct().join(
        assigned.select(F.col("target_id").alias("tp_id")).distinct(), "tp_id", "left_anti"
    )
