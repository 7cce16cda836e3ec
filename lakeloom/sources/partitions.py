"""Merging a batch into a partitioned table by rewriting only the partitions that it touches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import file_of_row, path_of, remove
from .scratch import cut, discard

#: Partitions that one merge may touch: their values go to the driver, to be named in the scan's filter.
MAX_TOUCHED = 100_000


def bucket(keys: list[str], n: int) -> Column:
    """A partition number that the key alone decides, so that a batch's partitions are known without a look at the table."""
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def touched(target: DataFrame, batch: DataFrame, keys: list[str], by: list[str], derived: bool = False) -> list[tuple]:
    """Values of `by` whose partitions hold a key of the batch or get a row of it. If the key alone decides the partition
    (`derived`), the batch tells; else the table's keys and partition columns are read, and nothing more."""
    parts = batch.select(*by)
    if not derived:
        parts = parts.union(target.select(*keys, *(c for c in by if c not in keys)).join(batch.select(*keys).distinct(), keys, "left_semi").select(*by))
    found = [tuple(r) for r in parts.distinct().limit(MAX_TOUCHED + 1).collect()]
    if len(found) > MAX_TOUCHED:
        raise ValueError(f"the batch touches more than {MAX_TOUCHED} partitions: rewrite the table instead")
    return found


def _within(by: list[str], values: list[tuple]) -> Column:
    """The partitions with these values, as a filter that the scan prunes by."""
    if not values:
        return F.lit(False)
    if len(by) == 1:
        some = F.col(by[0]).isin([v for (v,) in values if v is not None])
        return some | F.col(by[0]).isNull() if (None,) in values else some
    one = lambda value: reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, value)))
    return reduce(lambda a, b: a | b, map(one, values))


def merge_touched(path: str, batch: DataFrame, keys: list[str], by: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], derived: bool = False) -> list[tuple]:
    """Merges a batch into the Parquet table at `path`, partitioned by `by`; returns the values of the partitions rewritten.

    `merge(rows, batch)` gets the rows of the touched partitions and returns what they become (`incremental.upsert`, an
    scd2 merge, ...); it must leave rows of keys that the batch doesn't have as they are. The others aren't read or
    written. What it returns is written aside first, as it reads what is replaced, and then swapped in partition by
    partition; a partition that ends up empty goes. The batch has the table's columns, or those that `merge` asks for
    besides `by`.
    """
    spark = batch.sparkSession
    target = spark.read.parquet(path)
    values = touched(target, batch, keys, by, derived)
    if not values:
        return []
    fresh = cut(merge(target.filter(_within(by, values)), batch).select(*target.columns))
    left = {tuple(r) for r in fresh.select(*by).distinct().collect()}  # at most as many as were touched
    if left - set(values):
        raise ValueError(f"rows came out in partitions that the batch doesn't touch: {sorted(left - set(values), key=str)[:5]}")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    for gone in set(values) - left:
        for folder in {r[0].rsplit("/", 1)[0] for r in target.filter(_within(by, [gone])).select(file_of_row()).distinct().collect()}:
            remove(spark, path_of(folder))
    discard(fresh)
    return values
