"""Session settings and the shared scratch folder for cut lineages."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app_name: str = "pairloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the operators are written for; ``settings`` win over them.

    Setting names are given with ``__`` in place of dots. On a cluster leave ``master`` out and let
    spark-submit name it, together with ``spark.checkpoint.dir`` and the shuffle partition count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that was made elsewhere."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a new local one only where none is named.

    A local folder is only right where driver and executors share one machine, so any other master
    without the setting is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="pairloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the scratch root that nothing else uses."""
    return f"{scratch_root(spark).rstrip('/')}/pairloom/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table that several later stages read, and go on from the written one.

    It cuts the lineage and survives lost executors; unlike a cached table it keeps file statistics
    for the planner and gives up columns that a later stage does not read. ``compression``: the session's unless named.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.mode("error").parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def _table_of(path: str) -> str:
    """The name under which a bucketed table in a new folder is registered."""
    unique, name = path.rstrip("/").split("/")[-2:]
    return f"pairloom_{name}_{unique}"


def materialize_bucketed(df: DataFrame, name: str, column: str, compression: str | None = None) -> DataFrame:
    """``materialize`` into buckets of one column: joins on it, however many, read the table without a shuffle.

    As many buckets as shuffle partitions, so that a table which comes from a shuffle on the column is written as it lies.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    table = _table_of(path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.mode("error").format("parquet").option("path", path).bucketBy(parts, column)
    if compression:
        writer = writer.option("compression", compression)
    writer.saveAsTable(table)
    return spark.table(table)


def release(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote and nothing reads any more; any other table is left as it is.

    Only folders that ``new_folder`` made are touched. A frame that still reads the table fails afterwards.
    """
    spark = df.sparkSession
    jvm, configured = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def bare(path: str) -> str:
        return jvm.org.apache.hadoop.fs.Path(path).toUri().getPath()

    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if bare(folder).startswith(f"{bare(scratch_root(spark))}/pairloom/"):
            spark.sql(f"drop table if exists {_table_of(folder)}")
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(configured).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer splits than there are cores, over all cores; others as they are.

    One small or unsplittable file is one task up to the first shuffle, however heavy the work on it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors, as ``--py-files`` would; the Arrow UDF imports it there."""
    if getattr(spark.sparkContext, "_pairloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="pairloom-package-")) / "pairloom"
    archive = shutil.make_archive(str(base), "zip", root_dir=root.parent, base_dir=root.name)
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._pairloom_shipped = True
