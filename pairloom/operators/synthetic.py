"""Labelled training pairs from a master table that carries its matched supplier columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions.text import strip

BUCKET_DIGITS = 4


def draw(purpose: str, seed: int, *parts: Column) -> Column:
    """A reproducible random text of 32 hexadecimal digits for a row."""
    return F.md5(F.concat_ws(":", F.lit(purpose), F.lit(str(seed)), *[p.cast("string") for p in parts]))


def spread_rank(df: DataFrame, group: list[str], order: str, tie: str, name: str) -> DataFrame:
    """Number the rows of every group by ``order``, a hexadecimal digest, without gathering a group.

    The first digits cut a group into up to 65,536 slices of like size. Rows are numbered inside
    their slice and moved up by the rows of the slices before it; only slice sizes are summed per
    group.
    """
    sliced = df.withColumn("_slice", F.substring(order, 1, BUCKET_DIGITS))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sliced.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
               .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = Window.partitionBy(*group, "_slice").orderBy(order, tie)
    return (sliced.withColumn("_inside", F.row_number().over(inside)).join(offsets, [*group, "_slice"])
            .withColumn(name, F.col("_inside") + F.col("_offset")).drop("_slice", "_inside", "_offset"))


def permute_within(df: DataFrame, group: Column, values: list[str], row_id: str, iterations: int,
                   seed: int) -> DataFrame:
    """Every row ``iterations`` times, each time with the ``values`` of a random row of its group (WIN4).

    Two independent numberings meet: the row with number r among the places takes the values of the
    row with number r among the givers, so every iteration is a permutation of the group. Values
    travel as one struct, so they stay together (CMP1).
    """
    grouped = df.withColumn("_group", group)
    places = spread_rank(grouped.withColumn("_draw", draw("place", seed, F.col(row_id))),
                         ["_group"], "_draw", row_id, "_rank").drop("_draw")
    givers = (grouped.select("_group", F.col(row_id).alias("_giver"), F.struct(*values).alias("_taken"))
              .withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
              .withColumn("_draw", draw("giver", seed, F.col("iteration"), F.col("_giver"))))
    givers = spread_rank(givers, ["_group", "iteration"], "_draw", "_giver", "_rank").drop("_draw", "_giver")
    return places.join(givers, ["_group", "_rank"]).drop("_group", "_rank")


def synthetic_pairs(master: DataFrame, iterations: int = fv.SHUFFLE_ITERATIONS, seed: int = fv.SPLIT_SEED,
                    category: str = "mas_cat_id", carried: list[str] = ()) -> DataFrame:
    """Originals labelled 1 and in-category shuffles of the supplier side (SYN1, SET2, PRJ6).

    A shuffled row is labelled 1 where it got values equal to its own. ``iteration`` is 0 for the
    originals. Rows without a category form one group, as the text ``nan`` does. Columns ``carried``
    belong to the supplier side and move with it, but have no say in the label.
    """
    values = [c for c in fv.MASTER_SUPPLIER_COLUMNS if c in master.columns]
    originals = master.withColumns({"match": F.lit(1), "iteration": F.lit(0)})
    group = F.coalesce(F.col(category).cast("string"), F.lit("nan"))
    shuffled = permute_within(master, group, [*values, *carried], "m_id", iterations, seed)
    taken = F.struct(*[F.col(f"_taken.{v}") for v in values])
    shuffled = shuffled.withColumn("match", F.when(F.struct(*values).eqNullSafe(taken), 1).otherwise(0))
    shuffled = shuffled.withColumns({v: F.col(f"_taken.{v}") for v in [*values, *carried]}).drop("_taken")
    both = originals.unionByName(shuffled.select(originals.columns))
    return both.withColumn("title", strip(F.col("title")))
