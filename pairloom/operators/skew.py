"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_ROWS = 1 << 16


def join_back(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a one-row-per-key ``lookup`` to ``rows``, any key of which may be hot.

    Adaptive execution cuts a hot key into slices only where both inputs come straight from a
    shuffle. A lookup made by grouping on the same keys would skip its shuffle and bar that, so a
    hash of the keys joins the keys: the lookup is shuffled once more, and it is the small side.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_key", F.xxhash64(*keys))

    return keyed(rows).join(keyed(lookup), [*keys, "_key"], how).drop("_key")


def n_slices(n_rows: Column) -> Column:
    """How many slices a key with ``n_rows`` rows is cut into."""
    return F.greatest(F.lit(1), F.ceil(n_rows / SLICE_ROWS)).cast("int")


def own_slice(row_id: Column, n_rows: Column) -> Column:
    """The slice of one row of a key with ``n_rows`` rows."""
    return F.pmod(F.xxhash64(row_id), n_slices(n_rows)).cast("int")


def every_slice(n_rows: Column) -> Column:
    """To be exploded on the other side: all slices of a key with ``n_rows`` rows."""
    return F.sequence(F.lit(0), n_slices(n_rows) - 1)
