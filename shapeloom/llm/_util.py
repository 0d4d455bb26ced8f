"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop, shared_dir, stored

__all__ = ["BLANKS", "UPPER", "ascii_lower", "blank_words", "drop", "lean", "let", "shared_dir", "ship", "small", "spread_join", "stored", "table", "texts_of"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What counts as white space in a text: the blank and the controls from tab to carriage return.
BLANKS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often body uses it.

    A lambda's variable is bound to a computed value, which Catalyst cannot inline again.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, other letters as they are; pure ASCII takes the built-in fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def blank_words(text: Column) -> Column:
    """The words between white space; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def small(df: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """A stored table, to be broadcast if its measured size allows that; else as it is."""
    strings = [F.octet_length(c) for c, t in df.dtypes if t == "string"]
    size = 64 * len(df.columns) + sum((F.coalesce(x, F.lit(0)) for x in strings), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most_bytes else df


#: A key with more than this share of the rows is hot, so there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1024


def spread_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of two stored tables; right has each key once, and narrow rows.

    Hot keys of left are broadcast with their rows of right, fewer than 1 / HOT_SHARE rows; their rows of left stay where they are.
    """
    counts = left.groupBy(*on).agg(F.count("*").alias("_n"))
    hot = stored(counts.where(F.col("_n") > max(1000, HOT_SHARE * left.count())).select(*on), "hot-keys")
    if not hot.limit(1).count():
        return left.join(right, on)
    cool = left.join(F.broadcast(hot), on, "left_anti").join(right, on)
    return left.join(F.broadcast(right.join(F.broadcast(hot), on, "left_semi")), on).unionByName(cool)


def ship(module: str) -> None:
    """Sends a module's functions to the Python workers by value, so that they need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def texts_of(column: pa.Array, rows: int = 500) -> Iterator[list[str]]:
    """The texts of an Arrow column, null as empty, some rows at a time."""
    for at in range(0, len(column), rows):
        yield [x or "" for x in column.slice(at, rows).to_pylist()]


def give_back() -> None:
    """Returns this process's free memory to the machine, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A function of Arrow batches for mapInArrow that returns its memory after each partition."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


ship(__name__)
