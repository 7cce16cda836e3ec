"""Dense surrogate keys without a global window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import cut


#: So few rows are numbered by a single task.
FEW_ROWS = 10_000


def add_surrogate_key(df: DataFrame, name: str, order_cols: list[str], start: int = 0) -> DataFrame:
    """Numbers start + 1 .. start + n in the order of `order_cols` (nulls first), as a global row_number would.

    The rows are written first, for ranges are drawn from a sample and what makes the rows would run twice. They go to
    ranges of the key, are sorted and numbered there, and are written with that; each range then counts on from where
    the ranges before it end. Only the ranges' counts come together. Rows that tie in all of `order_cols` are
    numbered in any order. There are as many ranges as shuffle partitions. Up to FEW_ROWS are numbered by one window.
    """
    order = [F.col(c).asc() for c in order_cols]
    df = cut(df)
    if df.count() <= FEW_ROWS:
        return df.select((F.lit(start) + F.row_number().over(Window.orderBy(*order))).cast("long").alias(name), *df.columns)
    place = F.monotonically_increasing_id()  # the range in the upper bits, the row's place in it in the lower 33
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place)).withColumn("_range", F.shiftrightunsigned("_place", 33))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row per partition
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.join(F.broadcast(offsets), "_range").select((F.lit(start) + F.col("_before") + rank).cast("long").alias(name), *df.columns)


def max_key(df: DataFrame, name: str) -> int:
    return df.agg(F.max(name)).first()[0] or 0


def register_keys(registry: DataFrame, rows: DataFrame, natural: list[str], name: str) -> DataFrame:
    """The registry (name, natural keys) with a new key for every natural key of `rows` that it doesn't have.

    Keys that were given stay for good, also those of natural keys that no row has any more, so facts keep pointing at
    the same rows when a dimension is built anew. New ones count on from the largest, in the order of the natural keys. A null is a
    value like others.
    """
    known = registry.select(*(F.col(c).alias(f"_{c}") for c in natural))
    match = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in natural))
    unseen = rows.select(*natural).distinct().join(known, match, "left_anti")
    return registry.select(name, *natural).unionByName(add_surrogate_key(unseen, name, natural, max_key(registry, name)))


def with_registered_key(rows: DataFrame, registry: DataFrame, natural: list[str], name: str) -> DataFrame:
    """The rows with their natural key's registered one."""
    keys = registry.select(name, *(F.col(c).alias(f"_{c}") for c in natural))
    match = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in natural))
    return rows.join(keys, match, "left").select(name, *rows.columns)
