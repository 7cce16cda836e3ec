"""Point-in-time joins as a merge: facts and versions in one sort, the last version carried forward.

A range join meets every fact of an entity with all of its versions and then drops all but one. Here both lie in
one sequence, ordered by (entity, time), in which a fact's version is the last one before it; no row is made that isn't
returned. An entity with very many rows is cut into slices of time, each sorted by a task of its own and begun with the
version that holds at its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import cut

#: Rows of an entity that are sorted together, about.
SLICE_ROWS = 1_000_000
#: Sampled rows for each slice, and edges of slices that are sent to all tasks, at most (16 bytes each).
SAMPLES, MAX_EDGES = 16, 1 << 20


def _edges(keys: DataFrame, slice_rows: int) -> DataFrame | None:
    """(_entity, _edges: times that part an entity's rows into slices, with how often a quantile fell on that time), of
    entities with more than about two slices; None if there are none. Drawn from a sample, so only its size is about right."""
    sample = cut(keys.sample(min(1.0, SAMPLES / slice_rows), seed=7))
    step = max(SAMPLES, -(-sample.count() // MAX_EDGES))
    entity = Window.partitionBy("_entity")
    ranked = sample.select("_entity", "_at", F.row_number().over(entity.orderBy("_at")).alias("_place"), F.count("*").over(entity).alias("_n"))
    times = ranked.filter((F.col("_n") >= 2 * step) & (F.col("_place") % step == 0)).groupBy("_entity", "_at").agg(F.count("*").cast("int").alias("times"))
    edges = cut(times.groupBy("_entity").agg(F.sort_array(F.collect_list(F.struct("_at", "times"))).alias("_edges")))
    return None if edges.isEmpty() else edges


def _slice(at: str) -> Column:
    """How many edges aren't after a time, by binary search; 0 for an entity without edges."""
    steps = F.array(*(F.lit(1 << b) for b in range(MAX_EDGES.bit_length(), -1, -1)))
    found = F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.get("_edges", n + s - 1)["_at"] <= F.col(at), n + s).otherwise(n))
    return F.when(F.col("_edges").isNull(), 0).otherwise(found)


def _copies(place: str) -> Column:
    """Over how many tasks a slice is dealt: more than one where very many rows share its first instant."""
    return F.coalesce(F.get("_edges", F.col(place) - 1)["times"], F.lit(1))


def asof_join(fact: DataFrame, dim: DataFrame, id_col: str, ts: str, how: str = "inner", start: str = "valid_from", end: str = "valid_to", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each fact with the version of its entity that held at the fact's time: the last that had started, unless it had ended.

    As `relational.pit_join` over versions that don't overlap, but a fact is never multiplied: of versions that do
    overlap the one that started last counts. Validity is half-open, a null end is open, versions of no length hold
    nothing. Facts with a null id or time, and those without a version, come out with nulls if `how` is "left" and
    drop out if it is "inner". The dimension's other columns must have names that the facts don't have. What makes the two
    sides runs once more, for ids and times alone, to draw the sample that tells entities with very many rows.
    """
    rest = [c for c in dim.columns if c != id_col]
    if clash := sorted(set(rest) & set(fact.columns)):
        raise ValueError(f"both sides have {', '.join(clash)}")
    held = F.col(start).isNotNull() & F.col(id_col).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start)))
    versions = dim.filter(held).select(F.col(id_col).alias("_entity"), F.col(start).alias("_at"), F.struct(*rest).alias("_version"))
    known = F.col(id_col).isNotNull() & F.col(ts).isNotNull()
    facts = fact.filter(known).select(F.col(id_col).alias("_entity"), F.col(ts).alias("_at"), F.struct(*fact.columns).alias("_fact"))
    plain = [c for c, t in fact.dtypes if "map<" not in t]

    edges = _edges(facts.select("_entity", "_at").union(versions.select("_entity", "_at")), slice_rows)
    keys = ["_entity"]
    if edges is not None:
        keys = ["_entity", "_slice", "_copy"]
        small = F.broadcast(edges)  # at most MAX_EDGES times
        versions = versions.join(small, "_entity", "left").withColumn("_slice", _slice("_at"))
        # the version that holds where a slice begins: the last of the slices before it
        last = versions.filter("_edges IS NOT NULL").groupBy("_entity", "_slice").agg(F.max_by(F.struct("_at", "_version"), "_at").alias("_last"))
        grid = edges.select("_entity", "_edges", F.explode(F.sequence(F.lit(0), F.size("_edges"))).alias("_slice")).join(last, ["_entity", "_slice"], "left")
        before = F.last("_last", ignorenulls=True).over(Window.partitionBy("_entity").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
        carried = grid.withColumn("_last", before).filter("_last IS NOT NULL").select("_entity", "_last._at", "_last._version", "_edges", "_slice")
        versions = versions.unionByName(carried).withColumn("_copy", F.explode(F.sequence(F.lit(0), _copies("_slice") - 1))).drop("_edges")
        facts = facts.join(small, "_entity", "left").withColumn("_slice", _slice("_at"))
        facts = facts.withColumn("_copy", F.pmod(F.xxhash64(*(F.col("_fact").getField(c) for c in plain)), _copies("_slice")).cast("int")).drop("_edges")

    both = versions.withColumn("_kind", F.lit(0)).unionByName(facts.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_version", F.last("_version", ignorenulls=True).over(order)).filter("_kind = 1")
    hit = F.col("_version").isNotNull() & (F.col("_version").getField(end).isNull() | (F.col("_at") < F.col("_version").getField(end)))
    if how == "inner":
        return found.filter(hit).select("_fact.*", "_version.*")
    out = found.withColumn("_version", F.when(hit, F.col("_version"))).select("_fact.*", *(F.col("_version").getField(c).alias(c) for c in rest))
    types = dict(dim.dtypes)
    return out.unionByName(fact.filter(~known).select("*", *(F.lit(None).cast(types[c]).alias(c) for c in rest)))
