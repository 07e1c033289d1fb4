"""Scalar and array expressions; all of them stay on the JVM except raw float bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted spellings of binary labels and of boolean tokens.
POSITIVE_TEXT = ("1", "true", "t", "yes", "y", "positive", "pos", "nmf")
NEGATIVE_TEXT = ("0", "false", "f", "no", "n", "negative", "neg", "mf")
TRUE_TOKENS = ("true", "t", "yes", "y")
FALSE_TOKENS = ("false", "f", "no", "n")


# The characters a text strip removes.
WHITESPACE = " \t\n\x0b\x0c\r"


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(WHITESPACE))


def spread(value: Column, like: Column) -> Column:
    """A per-row value repeated to the length of an array.

    A lambda would compute an outer expression once per element; as an array operand it is computed
    once per row.
    """
    return F.array_repeat(value, F.size(like))


def nan_to_null(column: Column) -> Column:
    """Missing metrics arrive as NaN, which ``avg`` would spread; infinities are not finite either."""
    value = column.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def split_list(column: Column, separators: str = ";") -> Column:
    """Split on any of the separator characters, trim, drop blanks."""
    pattern = "[" + "".join("\\" + c for c in separators) + "]"
    return F.filter(F.transform(F.split(column, pattern), strip), lambda x: x != "")


def vector_from_text(column: Column) -> Column:
    """``"[a, b]"`` to ``array<float>``; empty text gives an empty vector."""
    body = strip(F.regexp_replace(column, r"[\[\]]", ""))
    parts = F.filter(F.split(body, r"[,\s]+"), lambda x: x != "")
    return parts.cast("array<float>")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def vector_from_bytes(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else np.frombuffer(bytes(b), dtype="<f4"))


def coerce_vector(column: Column, data_type: T.DataType) -> Column:
    """List, little-endian float32 bytes or bracketed text to ``array<float>``."""
    if isinstance(data_type, T.ArrayType):
        return column.cast("array<float>")
    if isinstance(data_type, T.BinaryType):
        return vector_from_bytes(column)
    if isinstance(data_type, T.StringType):
        return vector_from_text(column)
    raise TypeError(f"no vector form for {data_type.simpleString()}")


def coerce_binary_label(column: Column) -> Column:
    """0, 1 or NULL from booleans, numbers and label words."""
    text = F.lower(strip(column.cast("string")))
    number = text.try_cast("double")
    return (
        F.when(text.isin(*POSITIVE_TEXT), 1)
        .when(text.isin(*NEGATIVE_TEXT), 0)
        .when(number == 1.0, 1)
        .when(number == 0.0, 0)
    )


def coerce_label_token(column: Column) -> Column:
    """Normalize a label's spelling; the result stays text."""
    text = strip(column.cast("string"))
    low = F.lower(text)
    number = text.try_cast("double")
    whole = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < 9.0e15)
    return (
        F.when(text == "", None)
        .when(low.isin(*TRUE_TOKENS), "1")
        .when(low.isin(*FALSE_TOKENS), "0")
        .when(whole, number.cast("long").cast("string"))
        .otherwise(text)
    )


def serialize_label(labels: Column) -> Column:
    """One label as text, several as a JSON list."""
    return F.when(F.size(labels) > 1, F.to_json(labels)).otherwise(
        F.element_at(labels, 1).cast("string")
    )


def normalize_name(column: Column) -> Column:
    """Case- and punctuation-free form for matching view and classifier names."""
    return F.regexp_replace(F.lower(column), "[^a-z0-9]", "")


def normalize_organism(column: Column) -> Column:
    return strip(F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), "[^a-z0-9]+", " "))


def norm2(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_unit(vec: Column) -> Column:
    """Row divided by its norm; a zero row stays as it is."""
    length = norm2(vec)
    divisor = spread(F.when(length == 0.0, 1.0).otherwise(length), vec)
    return F.zip_with(vec, divisor, lambda x, n: x.cast("double") / n)


def one_hot(index: Column, size: int) -> Column:
    return F.array(*[(index == i).cast("double") for i in range(size)])


def argmax_index(probs: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def zeros(width) -> Column:
    return F.array_repeat(F.lit(0.0), width)
