"""Supplier and master tables derived from the driver's ``part`` table.

The texts run unchanged in Spark and in DuckDB; every part is on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import spread

MASTER_ITEMS = """
select p_partkey as m_id, concat(p_name, ' ', p_brand) as mas_title, round(p_retailprice * 100, 0) as mas_dpc,
       cast(p_size as double) as mas_size, p_type as mas_cat_id, p_brand as mas_brand, p_size as mas_class,
       cast(p_partkey as string) as p_id, concat('c', cast(p_partkey as string)) as cp_id,
       cast(4000000000000 + p_partkey as string) as p_eans, cast(5000000000000 + p_partkey as string) as cp_eans,
       cast(6000000000000 + p_partkey % 17 as string) as cp_un_eans
from part"""

SUPPLIER_ITEMS = """
select p_partkey as sup_id,
       case p_partkey % 4 when 0 then concat(p_name, ' ', p_brand, ' 6x0,33 l')
                          when 1 then concat(p_brand, ' ', p_name, ' 500ml')
                          when 2 then concat(upper(p_name), ' 12er')
                          else concat(substr(p_name, 1, length(p_name) - 1), ' ', p_brand, ' 10x',
                                      cast(p_size as string)) end as title,
       round(p_retailprice * 100, 0) + (p_partkey % 7) * 3 as default_price_cents,
       case p_partkey % 3 when 0 then concat(cast(4000000000000 + p_partkey as string), '.0')
                          when 1 then concat('9999999999999,', cast(5000000000000 + p_partkey as string))
                          else '9999999999999' end as eans,
       p_type as sup_cat_id, p_brand as sup_brand, p_size as sup_class
from part"""

BLOCK_KEYS = [("sup_cat_id", "mas_cat_id"), ("sup_brand", "mas_brand")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over_part(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    part = spread(table(spark, sf_dir, "part"))
    return spark.sql(text.replace("from part", "from {part}"), part=part)


def master_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_part(spark, sf_dir, MASTER_ITEMS)


def supplier_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_part(spark, sf_dir, SUPPLIER_ITEMS)


def unique_titles(df: DataFrame, row_id: str, title: str) -> DataFrame:
    """The items with an article code in the title, so that no title repeats."""
    return df.withColumn(title, F.concat(title, F.lit(" "), F.substring(F.md5(F.concat(F.lit(row_id), row_id).cast("binary")), 1, 6)))


# titles in many spellings of pack, size and unit, for the mining queries
MINING_TITLES = """
select p_partkey as item_id,
       case p_partkey % 20 when 0 then concat(p_name, ' Dose 24x0,33 l')
                           when 1 then concat(p_name, ' 4*6*0.5L DPG')
                           when 2 then concat(p_name, ' 6 x 4 x 1,5 Liter  Kiste')
                           when 3 then concat(p_name, ' rot 10x', cast(p_size as string))
                           when 4 then concat(p_name, ' 20 Beutel 1,75 g')
                           when 5 then concat(p_name, ' 24 Stk ', cast(p_size as string), ' g')
                           when 6 then concat(upper(p_name), ' 0,75 Liter 6er KARTON')
                           when 7 then concat(p_name, ' ', cast(p_size as string), 'g x 12')
                           when 8 then concat(p_name, ' 500 Blatt ', p_brand)
                           when 9 then concat(p_name, ' 100 St')
                           when 10 then concat(p_name, ' ', cast(p_size as string), 'er')
                           when 11 then concat(p_name, ' 3/', cast(p_size as string))
                           when 12 then concat(p_name, ' o''neill''s 12 x')
                           when 13 then concat(p_name, ' 0,75 6,50')
                           when 14 then concat(p_name, ' 12x10,5 4,9 % MW')
                           when 15 then concat(p_name, ' 4x6/0,33 l Glas ', p_brand)
                           when 16 then concat(p_name, ' 6x0,5')
                           when 17 then concat(p_name, ' 2,5 kg Pet ', cast(p_size as string), ' Rollen')
                           when 18 then concat(p_brand, ' ', cast(p_size as string), 'x70cl 40 % EW')
                           else concat(p_name, ' 6er 4 x 0,33 I ', p_brand) end as title
from part"""

PAIR_KEYS = [("sup_brand", "mas_brand"), ("sup_class", "mas_class")]


def mining_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_part(spark, sf_dir, MINING_TITLES)
