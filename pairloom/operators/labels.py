"""Label loading, alignment and encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.ranks import attach
from pairloom.functions.scalars import split_list


def labels_from_file(rows: DataFrame, accession_col: str = "accession", label_col: str = "label",
                     order_col: str | None = None) -> DataFrame:
    """(accession, pos, label): an accession cell may hold several ids, separated by ``;`` or ``,``."""
    order = F.col(order_col) if order_col else F.monotonically_increasing_id()
    return rows.where(F.col(accession_col).isNotNull()).select(
        F.explode(split_list(F.col(accession_col).cast("string"), ";,")).alias("accession"),
        order.alias("pos"), F.col(label_col).cast("string").alias("label"),
    )


def labels_collapse(exploded: DataFrame) -> DataFrame:
    """Distinct labels per accession in first-seen order; two or more make it multilabel."""
    # first position per (accession, label) is combined map-side, so repeats never reach the array
    first = exploded.where("label is not null").groupBy("accession", "label").agg(F.min("pos").alias("pos"))
    seen = F.array_sort(F.collect_list(F.struct("pos", "label")))
    return first.groupBy("accession").agg(F.transform(seen, lambda s: s.getField("label")).alias("labels"))


def labels_from_query(rows: DataFrame, accession_col: str, label_col: str, order_col: str) -> DataFrame:
    """Last row wins; there is no multilabel on this path."""
    return rows.groupBy(F.col(accession_col).alias("accession")).agg(
        F.max_by(F.col(label_col), F.col(order_col)).alias("label")
    )


def labels_align(labels: DataFrame, proteins: DataFrame) -> DataFrame:
    return labels.join(proteins.select("accession"), "accession", "left_semi")


def labels_missing_report(labels: DataFrame, proteins: DataFrame) -> DataFrame:
    """Labelled accessions unknown to the protein table, sorted."""
    return (
        labels.select("accession").distinct().join(proteins.select("accession"), "accession", "left_anti").orderBy("accession")
    )


def problem_type(labels: DataFrame) -> DataFrame:
    """One row: problem type, sorted classes, output size and loss name."""
    # distinct classes are found before anything is collected
    classes = labels.select(F.explode("labels").alias("c"), (F.size("labels") > 1).alias("many")).groupBy("c").agg(
        F.max("many").alias("many")
    )
    facts = classes.agg(F.max("many").alias("many"), F.array_sort(F.collect_list("c")).alias("classes"))
    size = F.size("classes")
    kind = F.when(F.col("many"), "multilabel").when(size == 2, "binary").otherwise("multiclass")
    checked = F.when(size == 0, F.raise_error("no labels")).otherwise(kind)
    return facts.select(checked.alias("problem_type"), "classes").select(
        "problem_type", "classes",
        F.size("classes").alias("output_size"),
        F.when(F.col("problem_type") == "multiclass", "CrossEntropyLoss").otherwise("BCEWithLogitsLoss").alias("loss"),
    )


def class_list(df: DataFrame, column: str) -> list:
    """Sorted distinct values on the driver, for the classes of a fit and the views of a grid."""
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def multilabel_binarize(df: DataFrame, column: str, classes: Sequence, out: str = "y") -> DataFrame:
    """0/1 vector over the ordered classes."""
    return df.withColumn(out, F.array(*[F.array_contains(column, F.lit(c)).cast("int") for c in classes]))


def label_encode(df: DataFrame, column: str, classes: Sequence, out: str = "label_index") -> DataFrame:
    """Index in the ordered class list; unknown labels give NULL."""
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(column)) - 1
    return df.withColumn(out, F.when(index >= 0, index.cast("int")))


def labels_decode(df: DataFrame, index_col: str, classes: Sequence, out: str = "predicted_label",
                  by: Sequence[str] = ()) -> DataFrame:
    """Class values, but only for groups whose every index is in range; otherwise the index stays."""
    bad = (F.col(index_col) < 0) | (F.col(index_col) >= len(classes))
    facts = df.groupBy(*by).agg(F.max(bad.cast("int")).alias("_bad"))
    joined = attach(df, facts, by, ["_bad"])
    in_range = F.when(bad, None).otherwise(F.col(index_col))
    value = F.element_at(F.array(*[F.lit(c) for c in classes]), (in_range + 1).cast("int")).cast("string")
    return joined.withColumn(
        out, F.when(F.col("_bad") == 0, value).otherwise(F.col(index_col).cast("string"))
    ).drop("_bad")


def class_distribution(samples: DataFrame, by: str = "label") -> DataFrame:
    """Counts per split and label (or per organism, for the zero-shot report)."""
    return samples.groupBy("split", by).agg(F.count(F.lit(1)).alias("n"))
