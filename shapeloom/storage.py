"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset a local master gets a temporary one; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shapeloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def home(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_dir(spark)}/shapeloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{home(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder and read again.

    This cuts the lineage: a lost executor costs no recomputation of what stands before. drop() removes one such table,
    clear() all of this application.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, wherever Spark can write."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Removes the files of stored tables that nothing will read any more."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Removes all tables of this application; results that were not yet written can no longer be read."""
    remove(spark, home(spark))


def small(df: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """A stored table, to be broadcast if its measured size allows that; else as it is."""
    strings = [F.octet_length(c) for c, t in df.dtypes if t == "string"]
    size = 64 * len(df.columns) + sum((F.coalesce(x, F.lit(0)) for x in strings), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most_bytes else df
