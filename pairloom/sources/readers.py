"""Reading the linkage tables and saved models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.session import materialize, spread

SUPPLIER_REQUIRED = ["title", "default_price_cents", "eans"]
MASTER_REQUIRED = ["mas_title", *fv.MASTER_EAN_COLUMNS]


def read_table(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV file with a header (all text) or a Parquet table, told apart by the suffix.

    ``multi_line`` allows line breaks inside quoted CSV fields; such files cannot be split.
    """
    name = path.rstrip("/").lower()
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith((".csv", ".csv.gz")):
        return spark.read.options(header=True, escape='"', multiLine=multi_line).csv(path)
    raise ValueError(f"unknown kind of table: {path} (export it to .csv or .parquet)")


def numbered(df: DataFrame, row_id: str) -> DataFrame:
    """``df``, as read from files, with the row's place in the order of files, from 0.

    Spark numbers rows inside a split of a file; the splits before it, in the order of file names and offsets, say where
    it begins. So the ids depend on the files only, not on the number of cores or the size of the splits. The rows are
    written with their numbers, as these must not change when a lost task runs again.
    """
    split = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    rows = materialize(df.select("*", split.alias("_split"), F.monotonically_increasing_id().alias("_place")), row_id)
    splits = rows.groupBy("_split").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    splits = splits.select("_split", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    out = rows.join(splits, "_split").withColumn(row_id, (F.col("_place") + F.col("_shift")).cast("long"))
    return materialize(out.drop("_split", "_place", "_shift"), f"{row_id}_numbered")


def _checked(df: DataFrame, required: list[str], row_id: str) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if row_id in df.columns:
        return spread(df.withColumn(row_id, F.col(row_id).cast("long")))
    return spread(numbered(df, row_id))


def read_supplier(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A supplier inventory (SRC1). Rows without ``sup_id`` get one."""
    return _checked(read_table(spark, path, multi_line), SUPPLIER_REQUIRED, "sup_id")


def read_master(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A product master, every column but the id as text (SRC2). Rows without ``m_id`` get one."""
    df = _checked(read_table(spark, path, multi_line), MASTER_REQUIRED, "m_id")
    return df.select([F.col(c) if c == "m_id" else F.col(c).cast("string").alias(c) for c in df.columns])


def read_latest_training(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the training file(s) written last under ``folder`` (SRC3).

    Only file names and times are looked at to find the newest run, Parquet or CSV; it alone is read then.
    """
    listed = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.{parquet,csv}").load(folder)
    newest = listed.select("path", "modificationTime").orderBy(F.desc("modificationTime"), F.desc("path")).first()
    if newest is None:
        raise ValueError(f"no training data under {folder}")
    run = newest["path"].rsplit("/", 1)[0]
    if newest["path"].endswith(".parquet"):
        return spark.read.parquet(run)
    # a run written by Spark is a directory of part files; other files are a run each
    path = run if newest["path"].rsplit("/", 1)[1].startswith("part-") else newest["path"]
    return spark.read.options(header=True, escape='"', inferSchema=True).csv(path)


def load_model(path: str) -> PipelineModel:
    """A saved model with its scaling (SRC4)."""
    return PipelineModel.load(path)
