"""Pair features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions import ean, numeric
from pairloom.functions.text import blank_to_null
from pairloom.operators.pairs import rebuild_pairs
from pairloom.operators.titles import add_title_features

TITLES = ("title", "mas_title")
MASTER_NUMBERS = ["mas_dpc", "mas_pieces", "mas_p_c", "mas_size"]


def blanks_to_null(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Blank text to null in every string column (FLT3) but those to ``keep``."""
    text = [c for c, kind in df.dtypes if kind == "string" and c not in keep]
    return df.withColumns({c: blank_to_null(F.col(c)) for c in text})


def repair_types(df: DataFrame, decimal_comma: bool = False, keep_missing: bool = False) -> DataFrame:
    """The numeric columns that are present, as doubles (CAST1).

    A missing supplier-side number is 0, a missing master-side number is null: master text arrives
    with missing values spelled ``nan``. ``keep_missing`` leaves both null, as training data has them.
    Text is repaired, numbers are only cast.
    """
    kinds = dict(df.dtypes)

    def repaired(name: str) -> Column:
        missing = None if keep_missing or name in MASTER_NUMBERS else 0.0
        if kinds[name] == "string":
            return numeric.repaired_number(F.col(name), missing, decimal_comma)
        number = F.col(name).cast("double")
        return numeric.nan_to_null(number if missing is None else F.coalesce(number, F.lit(missing)))

    return df.withColumns({c: repaired(c) for c in fv.NUMERIC_COLUMNS if c in kinds})


def add_supplier_features(supplier: DataFrame, tobacco: bool = False, compat: bool = False,
                          decimal_comma: bool = False, keep_missing: bool = False) -> DataFrame:
    """What depends on a supplier row only: article numbers, mined title columns, brand, repaired numbers.

    Done before pairing, a row is mined and repaired once and not once for each of its candidates.
    Titles stay as they are until the pairs are scored.
    """
    supplier = supplier.withColumn("eans", ean.ean_list(F.col("eans"), compat))
    mined = add_title_features(supplier, "title", tobacco)
    return repair_types(blanks_to_null(mined, TITLES), decimal_comma, keep_missing)


def add_master_features(master: DataFrame, compat: bool = False, decimal_comma: bool = False,
                        keep_missing: bool = False) -> DataFrame:
    """What depends on a master row only: its article numbers merged, its numbers repaired."""
    merged = ean.merged_eans(*[F.col(c) for c in fv.MASTER_EAN_COLUMNS], compat=compat)
    slim = master.withColumn("merge_eans", merged).drop(*fv.MASTER_EAN_COLUMNS)
    return repair_types(blanks_to_null(slim, TITLES), decimal_comma, keep_missing)


def add_pair_features(pairs: DataFrame) -> DataFrame:
    """Score, price, article-number and size features of scored pairs (FEA1-3, EAN3-4)."""
    return (pairs
            .withColumns({
                **{c: blank_to_null(F.col(c)) for c in TITLES if c in pairs.columns},
                "wg_sim_score": numeric.weighted_score(F.col("lev"), F.col("jwrink")),
                "price_diff": numeric.absolute_difference(F.col("mas_dpc"), F.col("default_price_cents")),
                "common_eans": ean.common_eans(F.col("merge_eans"), F.col("eans")),
                "size_diff": numeric.absolute_difference(F.col("mas_size"), F.col("size"))})
            .withColumn("ean_match_flag", ean.ean_match_flag(F.col("common_eans"))))


def feature_pipeline(scored: DataFrame, tobacco: bool = False, compat: bool = False, decimal_comma: bool = False,
                     rows: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """All features over a table of scored pairs with both sides' raw columns (FEAT).

    Pairs of titles that carry their rows (``key_blocking`` with ``titles``) are mined as such, article numbers are read
    inside the arrays, and only then the ``rows`` of both tables are laid out.
    """
    if rows:
        mined = add_title_features(scored, "title", tobacco)
        mined = repair_types(blanks_to_null(mined, TITLES), decimal_comma)
        merged = lambda m: ean.merged_eans(*[m[c] for c in fv.MASTER_EAN_COLUMNS], compat=compat)
        mined = mined.withColumns({
            "sup_rows": F.transform("sup_rows", lambda s: s.withField("eans", ean.ean_list(s["eans"], compat))),
            "m_rows": F.transform("m_rows", lambda m: m.withField("merge_eans", merged(m)))})
        supplier, master = rows
        wide = rebuild_pairs(mined, supplier, master.withColumn("merge_eans", F.lit(None)).drop(*fv.MASTER_EAN_COLUMNS))
        own = [c for c in [*supplier.columns, *master.columns] if c in wide.columns and c not in mined.columns]
        raw = wide.select(*own, *[c for c in wide.columns if c not in own])
        return add_pair_features(repair_types(blanks_to_null(raw, (*TITLES, *mined.columns)), decimal_comma))
    mined = add_title_features(scored.withColumn("eans", ean.ean_list(F.col("eans"), compat)), "title", tobacco)
    return add_pair_features(add_master_features(mined, compat, decimal_comma))
