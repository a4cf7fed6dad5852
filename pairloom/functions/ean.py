"""Article-number (EAN) functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import strip


def ean_list(eans: Column, compat: bool = False) -> Column:
    """Supplier text of article numbers as an array (EAN1).

    Commas become blanks, one trailing ``.0`` goes, blanks separate. Null gives an empty array and
    empty entries are dropped; ``compat`` keeps empty entries and turns null into the text ``nan``.
    """
    text = F.coalesce(eans, F.lit("nan")) if compat else eans
    text = F.regexp_replace(strip(F.regexp_replace(text, ",", " ")), r"\.0$", "")
    entries = F.split(text, " ")
    if compat:
        return entries
    return F.coalesce(F.filter(entries, lambda e: e != ""), F.array().cast("array<string>"))


def merged_eans(*columns: Column, compat: bool = False) -> Column:
    """Distinct article numbers of several columns (EAN2).

    ``compat`` gives the distinct digits of the texts run together, in order of appearance.
    """
    if compat:
        joined = F.concat(*[F.coalesce(c, F.lit("nan")) for c in columns])
        return F.array_distinct(F.regexp_extract_all(joined, F.lit(r"(\d)"), F.lit(1)))
    # "4001.0" is one number written as a float, not the numbers 4001 and 0
    cleaned = [F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<=\d)\.0(?!\d)", "") for c in columns]
    found = [F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)) for c in cleaned]
    return F.array_distinct(F.concat(*found))


def common_eans(left: Column, right: Column) -> Column:
    """How many distinct numbers both arrays hold (EAN3)."""
    return F.size(F.array_intersect(left, right))


def ean_match_flag(common: Column) -> Column:
    """1 where at least one number is shared (EAN4)."""
    return (common > 0).cast("int")
