"""Valid-time dimensions: building, merging, late changes, rebuilding and health.

A version holds over the half-open [valid_from, valid_to); valid_to is null while it is open, and then
is_current. row_hash is the fingerprint of the tracked attributes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import row_hash
from .keys import add_surrogate_key, max_key
from .relational import latest_per_key

VERSION = ["valid_from", "valid_to", "is_current", "row_hash"]


def scd2_build(events: DataFrame, id_col: str, ts: str, tracked: list[str], tie: list[str], algo: str = "sha256") -> DataFrame:
    """Versions of every entity from its timeline: a version starts where the tracked values change.

    Events are ordered by (ts, tie), so the result is the same on every run; a value that returns makes
    a version of its own, and two changes at one instant make one of zero length. version_num counts from 1.
    """
    w = Window.partitionBy(id_col).orderBy(ts, *tie)
    hashed = events.withColumn("row_hash", row_hash(tracked, algo))
    starts = hashed.withColumn("_before", F.lag("row_hash").over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col("row_hash")))
    end = F.lead(ts).over(w)
    return starts.select(id_col, *tracked, F.row_number().over(w).cast("long").alias("version_num"), F.col(ts).alias("valid_from"), end.alias("valid_to"), end.isNull().alias("is_current"), "row_hash")


def scd2_stats(dim: DataFrame, id_col: str) -> DataFrame:
    """One row: versions, current and historical ones, entities, and entities with several versions."""
    per = dim.groupBy(id_col).agg(F.count("*").alias("n"), F.count_if("is_current").alias("c"))
    return per.agg(F.sum("n").alias("total"), F.sum("c").alias("current"), (F.sum("n") - F.sum("c")).alias("historical"), F.count("*").alias("entities"), F.count_if(F.col("n") > 1).alias("changed"))


def classify_batch(dim: DataFrame, batch: DataFrame, id_col: str, tracked: list[str], algo: str = "sha256") -> DataFrame:
    """The batch with `action`: new, moved or unchanged against the current versions."""
    now = dim.filter("is_current").select(F.col(id_col).alias("_id"), F.col("row_hash").alias("_hash"))
    b = batch.withColumn("row_hash", row_hash(tracked, algo))
    action = F.when(F.col("_hash").isNull(), "new").when(F.col("_hash") != F.col("row_hash"), "moved").otherwise("unchanged")
    return b.join(now, b[id_col].eqNullSafe(F.col("_id")), "left").withColumn("action", action).drop("_id", "_hash")


def _numbered(rows: DataFrame, dim: DataFrame, key: str | None, order: list[str]) -> DataFrame:
    return add_surrogate_key(rows, key, order, max_key(dim, key)).select(*dim.columns) if key else rows.select(*dim.columns)


def scd2_merge(dim: DataFrame, batch: DataFrame, id_col: str, tracked: list[str], ts: str, key: str | None = None, algo: str = "sha256") -> DataFrame:
    """Merges the latest change per entity: moved ones close the current version and open a new one, new ones
    open one, unchanged ones do nothing; so the same batch again changes nothing. A null id is an entity like others. ts is a column of the batch."""
    last = latest_per_key(batch, [id_col], ts, tracked)
    act = classify_batch(dim, last, id_col, tracked, algo).filter("action <> 'unchanged'")
    ends = act.filter("action = 'moved'").select(F.col(id_col).alias("_id"), F.col(ts).alias("_end"))
    joined = dim.join(ends, dim[id_col].eqNullSafe(F.col("_id")) & dim["is_current"], "left")
    closed = joined.withColumns({"valid_to": F.coalesce("_end", "valid_to"), "is_current": F.col("is_current") & F.col("_end").isNull()}).select(*dim.columns)
    opened = act.select(id_col, *tracked, F.col(ts).alias("valid_from"), F.lit(None).cast(dim.schema["valid_to"].dataType).alias("valid_to"), F.lit(True).alias("is_current"), "row_hash")
    return closed.unionByName(_numbered(opened, dim, key, [id_col]))


def scd2_snapshot_merge(dim: DataFrame, snapshot: DataFrame, id_col: str, tracked: list[str], snapshot_ts: str, effective_ts, key: str | None = None) -> DataFrame:
    """Merges the latest snapshot row per entity as of one effective time (a column expression)."""
    last = latest_per_key(snapshot, [id_col], snapshot_ts, tracked).withColumn("_effective", effective_ts)
    return scd2_merge(dim, last, id_col, tracked, "_effective", key)


def scd2_apply_late(dim: DataFrame, batch: DataFrame, id_col: str, tracked: list[str], ts: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Merges changes that may lie in the past; (dimension, one row of counts).

    The latest change per entity counts. It splits the version that covers it: the piece before ends
    at the change, the piece after inherits valid_to and is_current. A change equal to the version it
    falls into does nothing, one before an entity's first version is skipped and counted, and an
    unknown entity opens a version.
    """
    b = latest_per_key(batch, [id_col], ts, tracked).select(F.col(id_col).alias("_id"), *(F.col(c).alias(f"_{c}") for c in tracked), F.col(ts).alias("_at"), row_hash(tracked).alias("_hash"))
    known = dim.select(F.col(id_col).alias("_id")).distinct().withColumn("_known", F.lit(True))
    cover = dim.select(F.col(id_col).alias("_cid"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), F.col("is_current").alias("_open"), F.col("row_hash").alias("_was"))
    on = (F.col("_id") == F.col("_cid")) & (F.col("_at") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("_at") < F.col("_to")))
    action = F.when(F.col("_known").isNull(), "new").when(F.col("_cid").isNull(), "before_history").when(F.col("_was") == F.col("_hash"), "unchanged").otherwise("split")
    act = b.join(known, "_id", "left").join(cover, on, "left").withColumn("action", action)
    cuts = act.filter("action = 'split'").select(F.col("_id").alias("_sid"), F.col("_from").alias("_sfrom"), F.col("_at").alias("_sat"))
    hit = (dim[id_col] == F.col("_sid")) & (dim["valid_from"] == F.col("_sfrom")) & (dim["valid_to"].isNull() | (dim["valid_to"] > F.col("_sat")))
    before = dim.join(cuts, hit, "left").withColumns({"valid_to": F.coalesce("_sat", "valid_to"), "is_current": F.col("is_current") & F.col("_sat").isNull()}).select(*dim.columns)
    fresh = act.filter("action in ('split', 'new')").select(F.col("_id").alias(id_col), *(F.col(f"_{c}").alias(c) for c in tracked), F.col("_at").alias("valid_from"), F.col("_to").alias("valid_to"), F.coalesce("_open", F.lit(True)).alias("is_current"), F.col("_hash").alias("row_hash"))
    counts = act.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("new", "split", "unchanged", "before_history")))
    return before.unionByName(_numbered(fresh, dim, key, [id_col])), counts


def scd2_rebuild(dim: DataFrame, batch: DataFrame, id_col: str, tracked: list[str], ts: str) -> DataFrame:
    """Builds the history anew from the versions' starts and all changes of a batch, however many and late.
    At one instant a change counts as later than a version's start."""
    starts = dim.select(id_col, *tracked, F.col("valid_from").alias("_at"), F.lit(0).alias("_source"))
    changes = batch.select(id_col, *tracked, F.col(ts).alias("_at"), F.lit(1).alias("_source"))
    return scd2_build(starts.unionByName(changes), id_col, "_at", tracked, ["_source", *tracked])


def scd2_health(dim: DataFrame, id_col: str) -> DataFrame:
    """One row: inverted intervals, versions not linked to the next one's start, entities without exactly one current version."""
    w = Window.partitionBy(id_col).orderBy("valid_from", F.col("valid_to").asc_nulls_last())
    linked = dim.withColumn("_next", F.lead("valid_from").over(w))
    per = linked.groupBy(id_col).agg(
        F.count_if(F.col("valid_to") < F.col("valid_from")).alias("inverted"),
        F.count_if(F.col("_next").isNotNull() & ~F.col("valid_to").eqNullSafe(F.col("_next"))).alias("unlinked"),
        F.count_if("is_current").alias("current"),
    )
    return per.agg(F.sum("inverted").alias("inverted"), F.sum("unlinked").alias("unlinked"), F.count_if(F.col("current") != 1).alias("not_one_current"))


def history_of(dim: DataFrame, id_col: str, value) -> DataFrame:
    return dim.filter(F.col(id_col) == value).orderBy("valid_from", F.col("valid_to").asc_nulls_last())


def hash_mismatches(dim: DataFrame, tracked: list[str]) -> DataFrame:
    """Versions whose stored fingerprint isn't that of their attributes."""
    return dim.filter(~F.col("row_hash").eqNullSafe(row_hash(tracked)))
