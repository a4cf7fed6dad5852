"""Title mining with ordered patterns, as chained projections over a text column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions import text as tx

CASCADE_FIELDS = ["pack_title", "size", "unit", "pieces", "pieces_count"]


def _group(term: Column, pattern: str, index: int) -> Column:
    found = F.regexp_extract(term, fv.to_jvm(pattern), index)
    return F.nullif(found, F.lit(""))


def extract_once(df: DataFrame, term: str, pattern: str) -> DataFrame:
    """Add the groups of the first match as columns, delete all matches from ``term`` (MIN1)."""
    fields = {name: _group(F.col(term), pattern, i) for i, name in enumerate(fv.group_names(pattern), start=1)}
    return df.withColumns({**fields, term: F.regexp_replace(F.col(term), fv.to_jvm(pattern), "")})


def extract_cascade(df: DataFrame, term: str, patterns: list[str]) -> DataFrame:
    """Run all patterns in order over what the earlier ones left of ``term`` (MIN2, MIN6).

    Each matching pattern overwrites its fields, with null for an optional group that took no part,
    and its matches are deleted. ``unit_seen`` tells whether any matching pattern could have named a
    unit, which the unit rules need besides the unit itself.
    """
    empty = {name: F.lit(None).cast("string") for name in CASCADE_FIELDS}
    df = df.withColumns({**empty, "unit_seen": F.lit(False)})

    def step(frame: DataFrame, pattern: str) -> DataFrame:
        text = F.col(term)
        hit = text.rlike(fv.to_jvm(pattern))
        names = fv.group_names(pattern)
        changed = {n: F.when(hit, _group(text, pattern, i)).otherwise(F.col(n)) for i, n in enumerate(names, start=1)}
        if "unit" in names:
            changed["unit_seen"] = F.col("unit_seen") | hit
        changed[term] = F.when(hit, F.regexp_replace(text, fv.to_jvm(pattern), "")).otherwise(text)
        return frame.withColumns(changed)

    done = reduce(step, patterns, df)
    # A filter on a mined column must stay above the chain: moved below, it would repeat every pattern
    # in every later one. Filters on the output of a generator are not moved.
    mined = [term, *CASCADE_FIELDS, "unit_seen"]
    return done.select(*[c for c in done.columns if c not in mined], F.inline(F.array(F.struct(*mined))))


def pack_pieces(pack: Column) -> Column:
    """Product of the two numbers of a pack title, 0 where there are none (MIN5)."""
    first, second = (_group(pack, fv.PACK_PIECES_PATTERN, i).try_cast("decimal(19,0)") for i in (1, 2))
    return F.coalesce(first * second, F.lit(0).cast("decimal(38,0)"))


def standard_unit(size: Column, unit: Column) -> tuple[Column, Column]:
    """Size and unit in litres, grams or centimetres; common bottle sizes get ``l`` (MIN10)."""
    unit = F.lower(F.coalesce(unit, F.lit("")))
    unit = F.regexp_replace(unit, fv.GRAM_SPELLINGS, "g")
    unit = F.regexp_replace(unit, fv.LITRE_SPELLINGS, "l")
    # no factor leads into the unit of a later one, so one choice on the spelled unit is enough
    factor, standard = F.when(F.lit(False), F.lit(1.0)), F.when(F.lit(False), F.lit(""))
    for units, output, value in fv.UNIT_FACTORS:
        factor = factor.when(unit.isin(units), F.lit(value))
        standard = standard.when(unit.isin(units), F.lit(output))
    new_size = F.coalesce(size * factor, size)
    new_unit = F.coalesce(standard, unit)
    bottle = new_size.isin(fv.COMMON_LITRES) & (new_unit == "")
    return new_size, F.when(bottle, F.lit("l")).otherwise(new_unit)


def full_extraction(df: DataFrame, title: str, tobacco: bool = False) -> DataFrame:
    """All mined columns of a title and the cleaned title itself (MIN11).

    Works on the column ``title`` in place and adds ``kvp kvp_unit dpg alcohol packaging format
    pack_title size unit pieces pieces_count``.
    """
    if tobacco:
        df = extract_once(df, title, fv.RETAIL_PRICE_PATTERN)
    else:
        df = df.withColumns({"kvp": F.lit(None).cast("string"), "kvp_unit": F.lit(None).cast("string")})
    for pattern in (fv.DEPOSIT_PATTERN, fv.ALCOHOL_PATTERN, fv.PACKAGING_PATTERN, fv.FORMAT_PATTERN):
        df = extract_once(df, title, pattern)
    df = extract_cascade(df, title, fv.mining_patterns(tobacco))

    number = tx.decimal_size(F.col("size"))
    litres, unit = standard_unit(number, F.col("unit"))
    df = df.withColumns({
        title: tx.title_case(F.col(title)),
        "size": F.when(F.col("unit_seen"), litres).otherwise(number),
        "unit": F.when(F.col("unit_seen") & F.col("size").isNotNull(), unit).otherwise(F.col("unit")),
    })
    # a drink in common sizes with both counts and no pack title is "pieces x pieces_count" (MIN12)
    from_context = (F.col("pack_title").isNull() & F.col("pieces").isNotNull() & F.col("pieces_count").isNotNull()
                    & F.col("unit_seen") & (F.lower("unit") == "l") & F.col("size").isin(fv.COMMON_BEVERAGE_SIZES))
    context = F.coalesce(from_context, F.lit(False))
    df = df.withColumns({
        "pack_title": F.when(context, F.concat("pieces", F.lit("x"), "pieces_count")).otherwise(F.col("pack_title")),
        "pieces_count": F.when(context, None).otherwise(F.col("pieces_count")),
    })
    packed = F.col("pack_title").isNotNull()
    df = df.withColumns({
        "pieces": F.when(packed, pack_pieces(F.col("pack_title")).cast("string")).otherwise(F.col("pieces")),
        "pack_title": tx.normalise_pack_title(F.col("pack_title")),
    })
    return df.drop("unit_seen")
