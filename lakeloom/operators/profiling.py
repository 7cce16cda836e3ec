"""Profiles of tables and diagnoses of their keys and histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean_text, count_nulls, row_hash
from .relational import orphans, top_k, version_counts

__all__ = ["row_counts", "duplicate_keys", "orphans", "null_profile", "value_range", "distribution", "heavy_keys", "version_ties", "norm_effect", "null_and_distinct", "hash_collisions", "ids_without_events", "version_counts", "checksum"]


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in frames.items()))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def null_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, nulls, rows), in one pass."""
    one = df.agg(F.count("*").alias("rows"), *(count_nulls(c).alias(f"_{i}") for i, c in enumerate(cols)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("nulls"), F.col("rows")) for i, c in enumerate(cols)))))


def value_range(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.min(c).alias("least"), F.max(c).alias("greatest"))


def distribution(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(c).asc_nulls_last())


def heavy_keys(df: DataFrame, c: str, k: int = 10) -> DataFrame:
    return top_k(df.groupBy(c).agg(F.count("*").alias("n")), [F.desc("n"), F.col(c).asc_nulls_last()], k)


def version_ties(df: DataFrame, id_col: str, ts: str, cols: list[str]) -> DataFrame:
    """Instants at which an entity has several different states."""
    states = df.select(id_col, ts, row_hash(cols).alias("_h")).distinct()
    return states.groupBy(id_col, ts).agg(F.count("*").alias("states")).filter("states > 1")


def norm_effect(df: DataFrame, id_col: str, c: str) -> DataFrame:
    """Entities whose number of distinct values falls when the text is trimmed and lower-cased."""
    raw = version_counts(df, id_col, [c]).withColumnRenamed("versions", "raw_versions")
    norm = version_counts(df.withColumn(c, clean_text(c)), id_col, [c]).withColumnRenamed("versions", "norm_versions")
    return raw.join(norm, id_col).filter("raw_versions > norm_versions")


def null_and_distinct(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: nulls by column, and distinct tuples, those with a null left out."""
    return df.agg(*(F.sum(F.col(c).isNull().cast("int")).cast("long").alias(f"null_{c}") for c in cols), F.count_distinct(*cols).alias("distinct_tuples"))


def hash_collisions(df: DataFrame, cols: list[str], algo: str = "sha256") -> DataFrame:
    """Fingerprints that several different value tuples have."""
    tuples = df.select(*cols).distinct()
    return tuples.groupBy(row_hash(cols, algo).alias("row_hash")).agg(F.count("*").alias("tuples")).filter("tuples > 1")


def ids_without_events(df: DataFrame, events: DataFrame, id_col: str, event_id: str) -> DataFrame:
    """Entities, with their detail, that no event names."""
    return df.join(events.select(F.col(event_id).alias(id_col)), id_col, "left_anti")


def checksum(df: DataFrame, c: str) -> DataFrame:
    """Count and sum of a column: a read that touches the data."""
    return df.agg(F.count("*").alias("n"), F.sum(c).alias("total"))
