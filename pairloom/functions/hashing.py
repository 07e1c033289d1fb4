"""Order-free pseudo-randomness: a row's draw depends only on the seed and the row's own key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(value) -> Column:
    column = value if isinstance(value, Column) else F.lit(value)
    return column.cast("string")


def pri(seed, *keys) -> Column:
    """``md5(seed:key[:key...])`` as hex text; sorting by it is a reproducible shuffle."""
    return F.md5(F.concat_ws(":", _text(seed), *[_text(k) for k in keys]))


def unit(hex_text: Column) -> Column:
    """The first 32 bits of an md5 text as a double in [0, 1)."""
    return F.conv(F.substring(hex_text, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(seed, *keys) -> Column:
    return unit(pri(seed, *keys))
