"""Changing tables as pure functions of DataFrames: upserts, updates, change feeds and their replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import latest_per_key, require_unique

KINDS = ["insert", "delete", "update_preimage", "update_postimage"]


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows replace the target's with their key or join it; a null key never matches. Several source
    rows for one key are an error, raised before anything is built."""
    require_unique(source, keys)
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source.select(*target.columns))


def update_where(df: DataFrame, condition: Column | str, values: dict[str, Column | str]) -> DataFrame:
    """Sets columns where the condition holds; where it is null the row stays as it is. All new values see the old row."""
    cond = F.expr(condition) if isinstance(condition, str) else condition
    new = {c: F.when(cond, F.expr(v) if isinstance(v, str) else v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()}
    return df.select(*(new.get(c, F.col(c)).alias(c) for c in df.columns))


def delete_where(df: DataFrame, condition: Column | str) -> DataFrame:
    """Drops the rows where the condition holds; where it is null they stay."""
    cond = F.expr(condition) if isinstance(condition, str) else condition
    return df.filter(~F.coalesce(cond, F.lit(False)))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Row changes from old to new with _change_type: one insert or delete, or an update's pre- and postimage.
    Keys are unique and not null; a null equals a null."""
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(*keys, F.struct(*rest).alias("_new"), F.lit(True).alias("_is"))
    both = a.join(b, keys, "full_outer")
    row = lambda kind, side: F.struct(F.lit(kind).alias("_change_type"), side.alias("_row"))
    images = (
        F.when(F.col("_was").isNull(), F.array(row("insert", F.col("_new"))))
        .when(F.col("_is").isNull(), F.array(row("delete", F.col("_old"))))
        .when(~F.col("_old").eqNullSafe(F.col("_new")), F.array(row("update_preimage", F.col("_old")), row("update_postimage", F.col("_new"))))
    )
    changed = both.select(*keys, F.explode(images).alias("_c"))
    return changed.select(*(F.col(c) if c in keys else F.col(f"_c._row.{c}").alias(c) for c in old.columns), F.col("_c._change_type").alias("_change_type"))


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("_change_type").agg(F.count("*").alias("n"))


def downstream(diff: DataFrame) -> DataFrame:
    """What a consumer applies: everything but preimages."""
    return diff.filter("_change_type <> 'update_preimage'")


def merge_metrics(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows inserted, updated and deleted."""
    of = lambda k: F.count_if(F.col("_change_type") == k)
    return snapshot_diff(before, after, keys).agg(of("insert").alias("inserted"), of("update_postimage").alias("updated"), of("delete").alias("deleted"))


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """The target after the last change of each key, by `version` if the feed has one."""
    last = downstream(changes)
    if version:
        last = latest_per_key(last, keys, version, ["_change_type"])
    kept = target.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.filter("_change_type <> 'delete'").select(*target.columns))


def state_as_of(base: DataFrame, changes: DataFrame, keys: list[str], n: int, version: str = "_commit_version") -> DataFrame:
    """The table at version n: the base with the changes up to n. Publishing it restores that version."""
    return apply_changes(base, changes.filter(F.col(version) <= n), keys, version)


def changes_since(feed: DataFrame, n: int, version: str = "_commit_version") -> DataFrame:
    return feed.filter(F.col(version) >= n)
