"""Id pairs back to full rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom import fixed_values as fv


def drop_supplier_side(master: DataFrame) -> DataFrame:
    """A master table without the already-matched supplier columns it may carry (PRJ1)."""
    return master.drop(*fv.MASTER_SUPPLIER_COLUMNS)


def rebuild_pairs(pairs: DataFrame, supplier: DataFrame, master: DataFrame) -> DataFrame:
    """Join both sides' columns to (sup_id, m_id) pairs (JOIN3).

    Master columns whose name the supplier side or the pair table already has get the prefix ``m_``. Pairs that carry
    their rows (``key_blocking`` with ``rows``) are laid out in place: no pair moves.
    """
    one, several = ("sup_row", "m_row"), ("sup_rows", "m_rows")
    own = [c for c in pairs.columns if c not in one + several]
    taken = (set(supplier.columns) | set(own)) - {"m_id"}
    if own == pairs.columns:
        renamed = master.select([F.col(c).alias(f"m_{c}" if c in taken else c) for c in master.columns])
        supplier = supplier.select([c for c in supplier.columns if c == "sup_id" or c not in pairs.columns])
        return pairs.join(supplier, "sup_id").join(renamed, "m_id")
    if several[0] in pairs.columns:
        pairs = pairs.withColumn(one[0], F.explode(several[0])).withColumn(one[1], F.explode(several[1]))
    # columns of the pairs themselves, such as titles, are not repeated
    return pairs.select(*own, *[F.col(f"sup_row.{c}").alias(c) for c in supplier.columns if c not in own],
                        *[F.col(f"m_row.{c}").alias(f"m_{c}" if c in supplier.columns and c != "m_id" else c)
                          for c in master.columns if c not in own])
