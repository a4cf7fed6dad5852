"""Title mining over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions import mining
from pairloom.functions import text as tx


def mine_titles(df: DataFrame, title: str = "title", tobacco: bool = True) -> DataFrame:
    """Add all mined columns; the given title stays as ``title_original`` (MIN13).

    Any other column that clashes with a mined one also gets the suffix ``_original``.
    """
    if title not in df.columns:
        raise ValueError(f"expected column {title} is missing")
    mined = ["kvp", "kvp_unit", "dpg", "alcohol", "packaging", "format", *mining.CASCADE_FIELDS]
    kept = [F.col(c).alias(f"{c}_original" if c in mined or c == title else c) for c in df.columns]
    return mining.full_extraction(df.select(*kept, F.col(title).alias("title")), "title", tobacco)


def add_title_features(df: DataFrame, title: str = "title", tobacco: bool = False) -> DataFrame:
    """Add ``brand`` and the raw cascade columns that feed the pair features (MIN14)."""
    work = df.withColumn("_term", F.col(title))
    work = mining.extract_cascade(work, "_term", fv.mining_patterns(tobacco))
    return work.withColumn("brand", tx.brand(F.col(title))).drop("_term", "unit_seen")
