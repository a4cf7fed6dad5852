"""Numeric repair and derived features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions.text import blank_to_null, without_commas

LARGEST_DOUBLE = 1.7976931348623157e308


def nan_to_null(value: Column) -> Column:
    """NaN as SQL null."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def repaired_number(text: Column, missing: float | None = 0.0, decimal_comma: bool = False) -> Column:
    """Numeric text to double: blank is missing, commas go, missing becomes ``missing`` (CAST1).

    Text that is no number raises, as a plain cast does. NaN is null, never ``missing``.
    """
    number = without_commas(blank_to_null(text.cast("string")), decimal_comma).cast("double")
    if missing is not None:
        number = F.coalesce(number, F.lit(missing))
    return nan_to_null(number)


def finite(value: Column) -> Column:
    """Missing or NaN to 0, infinities to the largest finite number (NUM1)."""
    value = F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    return (F.when(value == float("inf"), F.lit(LARGEST_DOUBLE))
            .when(value == float("-inf"), F.lit(-LARGEST_DOUBLE)).otherwise(value))


def weighted_score(lev: Column, jwrink: Column) -> Column:
    """0.7 token-set ratio + 0.3 Jaro-Winkler (FEA1)."""
    return F.lit(fv.LEV_WEIGHT) * lev + F.lit(fv.JWRINK_WEIGHT) * jwrink


def absolute_difference(left: Column, right: Column) -> Column:
    """|left - right|, null where either is null (FEA2, FEA3)."""
    return F.abs(left - right)
