"""Plain files: separated values, lists of lines, and the sinks of a profiling run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_separated(spark: SparkSession, path: str, sep: str = "|", header: bool = False) -> DataFrame:
    return spark.read.csv(path, sep=sep, header=header)


def read_lines(spark: SparkSession, path: str, name: str = "c") -> DataFrame:
    """Lines that are not empty, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "")


def read_support_list(spark: SparkSession, path: str) -> DataFrame:
    """shape, support, confidence of quoted lists with thousands separators."""
    found = spark.read.csv(path)
    return found.select(
        F.col("_c0").alias("shape"), F.replace("_c1", F.lit(","), F.lit("")).cast("long").alias("support"),
        F.col("_c2").cast("double").alias("confidence"),
    )


def write_separated(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, sep=sep, header=header)


def append_row(spark: SparkSession, path: str, **columns) -> None:
    """One more row of a log of separated values."""
    write_separated(spark.createDataFrame([tuple(columns.values())], list(columns)), path, mode="append")


def write_support(stats: DataFrame, path: str) -> None:
    """class|property|type|support|class count, without a header."""
    write_separated(stats.select("c", "p", "ot", "support", "n"), path, "|", header=False)


def write_class_frequency(counts: DataFrame, path: str) -> None:
    write_separated(counts.select(F.col("c").alias("Class"), F.col("n").alias("Frequency")), path)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select("value").write.mode(mode).text(path)
