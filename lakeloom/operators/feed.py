"""A stored change feed: every version's row changes, with whole snapshots now and then.

    path/changes/_commit_version=n    what version n changed
    path/snapshots/_version=n         the whole table at version n, for 0 and every few versions
    path/commits                      (version, at, rows): a row once all of a version's files are there

A version counts when its commit is there; files of one that was ended before are written over by the next try. The
state at a version is the nearest snapshot before it with the changes since, and both are found by partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import append, exists
from ..sources.scratch import cut, discard
from .incremental import apply_changes, snapshot_diff

#: Versions between two snapshots.
EVERY = 10
COMMIT = "version long, at timestamp, rows long"


class Feed:
    """The feed of a table with unique, non-null keys."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], every: int = EVERY):
        self.spark, self.path, self.keys, self.every = spark, path.rstrip("/"), keys, every

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    def history(self) -> DataFrame:
        """(version, at, rows) of all commits."""
        there = exists(self.spark, path := f"{self.path}/commits")
        return self.spark.read.schema(COMMIT).parquet(path) if there else self.spark.createDataFrame([], COMMIT)

    def version(self) -> int:
        """The last committed version; -1 if there is none."""
        last = self.history().agg(F.max("version")).first()[0]
        return -1 if last is None else last

    def _store(self, n: int, changes: DataFrame | None, state: DataFrame | None, at: Column | None) -> int:
        rows = 0
        if changes is not None:
            changes.write.mode("overwrite").parquet(folder := f"{self.path}/changes/_commit_version={n}")
            rows = self.spark.read.parquet(folder).count()
        if state is not None:
            state.write.mode("overwrite").parquet(f"{self.path}/snapshots/_version={n}")
        stamp = F.current_timestamp() if at is None else at
        entry = self.spark.range(1).select(F.lit(n).cast("long").alias("version"), stamp.cast("timestamp").alias("at"), F.lit(rows).cast("long").alias("rows"))
        append(entry.coalesce(1), f"{self.path}/commits")
        return n

    def commit(self, state: DataFrame, at: Column | None = None) -> int:
        """Stores the table's new state as the next version: what changed against the last one, and all of it where a snapshot is due."""
        n = self.version() + 1
        state = cut(state)
        changes = snapshot_diff(self.state(n - 1), state, self.keys) if n else None
        n = self._store(n, changes, state if n % self.every == 0 else None, at)
        discard(state)
        return n

    def commit_changes(self, changes: DataFrame, at: Column | None = None) -> int:
        """Stores row changes (as of `snapshot_diff`) that are known already; the state is made only where a snapshot is due."""
        n = self.version() + 1
        if n == 0:
            raise ValueError("the first commit must be a state")
        changes = cut(changes)
        n = self._store(n, changes, apply_changes(self.state(n - 1), changes, self.keys) if n % self.every == 0 else None, at)
        discard(changes)
        return n

    def _known(self, n: int) -> None:
        if not 0 <= n <= (last := self.version()):
            raise ValueError(f"there is no version {n}; the last is {last}")

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Changes of the versions from `since` to `until`, both included, with _commit_version."""
        last = self.version()
        until = last if until is None else min(until, last)
        return self._read("changes").filter(F.col("_commit_version").between(max(since, 1), until))

    def state(self, n: int | None = None) -> DataFrame:
        """The table at a version, by default the last. Publishing it elsewhere or committing it again restores it."""
        n = self.version() if n is None else n
        self._known(n)
        base = n - n % self.every
        table = self._read(f"snapshots/_version={base}")
        if base == n:
            return table
        return apply_changes(table, self.changes(base + 1, n), self.keys, "_commit_version")

    def rows_of(self, key: dict[str, object]) -> DataFrame:
        """All changes of one key, in order."""
        one = self.changes(1)
        for c, v in key.items():
            one = one.filter(F.col(c) == F.lit(v))
        return one.orderBy("_commit_version", "_change_type")
