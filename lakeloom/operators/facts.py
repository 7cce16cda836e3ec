"""Fact tables: allocation, assembly and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import money, round_half_up
from .keys import add_surrogate_key
from .relational import lookup, pit_join


def allocate(items: DataFrame, totals: DataFrame, key: str, weight: str, amount: str, scale: int = 2, name: str = "allocated", residue_order: list[str] | None = None) -> DataFrame:
    """Splits each key's amount over its items by their share of weight, rounded to `scale`.

    Without an amount items get 0; with weights that add up to 0 they get null. With residue_order (which must
    be unique within a key), what rounding leaves over goes to the item with the largest weight, the first of ties.
    """
    per_key = totals.groupBy(key).agg(F.sum(money(amount)).cast("double").alias("_amount"))
    w = Window.partitionBy(key)
    total = F.nullif(F.sum(money(weight)).over(w).cast("double"), F.lit(0.0))
    out = items.withColumn("_share", money(weight).cast("double") / total).join(per_key, key, "left")
    out = out.withColumn(name, round_half_up(F.coalesce("_amount", F.lit(0.0)) * F.col("_share"), scale))
    if residue_order:
        spent = F.sum(F.col(name).cast(f"decimal(18,{scale})")).over(w)
        first = F.row_number().over(w.orderBy(money(weight).desc(), *residue_order)) == 1
        rest = (F.coalesce("_amount", F.lit(0.0)).cast(f"decimal(18,{scale})") - spent).cast("double")
        out = out.withColumns({"_first": first, "_rest": rest}).withColumn(name, F.when(F.col("_first"), round_half_up(F.col(name) + F.col("_rest"), scale)).otherwise(F.col(name))).drop("_first", "_rest")
    return out.drop("_share", "_amount")


def build_fact(items: DataFrame, orders: DataFrame, history: DataFrame, dims: list[tuple[DataFrame, list[str] | Column]], order_key: str, entity: str, ts: str, cols: list[str], key: str | None = None, key_order: list[str] | None = None, pit: str = "inner") -> DataFrame:
    """Items with their order, the version of the entity that held at the order's time, and all
    dimensions' keys (missing ones stay null), stamped with _loaded_at; with `key`, numbered in key_order.

    Versions and dimensions that an order names are joined to orders, those that an item names to items; both meet last, so that
    items are shuffled once by order_key, and by no key but those of dimensions too large to broadcast."""
    of = lambda on, side: isinstance(on, list) and set(on) <= set(side.columns)
    at_orders = {entity, ts} <= set(orders.columns)
    if at_orders:
        orders = pit_join(orders, history, entity, ts, pit)
    late = []
    for dim, on in dims:
        if of(on, items):
            items = lookup(items, dim, on)
        elif of(on, orders):
            orders = lookup(orders, dim, on)
        else:
            late.append((dim, on))
    fact = items.join(orders, order_key)
    if not at_orders:
        fact = pit_join(fact, history, entity, ts, pit)
    for dim, on in late:
        fact = lookup(fact, dim, on)
    fact = fact.select(*cols)
    return (add_surrogate_key(fact, key, key_order) if key else fact).withColumn("_loaded_at", F.current_timestamp())


def fact_completeness(fact: DataFrame, key_cols: list[str], order_key: str, grain: list[str]) -> DataFrame:
    """One row: rows, missing keys by dimension, distinct orders, and grain values that occur more than once."""
    names = ["total", *(f"missing_{c}" for c in key_cols)]
    if order_key in grain:  # one pass: grains lie in orders, and both are grouped where a join by order_key left the rows
        grains = fact.groupBy(*grain).agg(F.count("*").alias("total"), *(F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in key_cols))
        held = grains.groupBy(order_key).agg(*(F.sum(c).alias(c) for c in names), F.count_if(F.col("total") > 1).alias("duplicate_grain"))
        known = F.when(F.col(order_key).isNotNull(), 1).otherwise(0)
        return held.agg(*(F.sum(c).alias(c) for c in names), F.sum(known).alias("orders"), F.sum("duplicate_grain").alias("duplicate_grain"))
    orders = fact.groupBy(order_key).agg(F.count("*").alias("total"), *(F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in key_cols))
    grains = fact.groupBy(*grain).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    a = orders.select(*names, F.when(F.col(order_key).isNotNull(), 1).otherwise(0).alias("orders"), zero.alias("duplicate_grain"))
    b = grains.select(*(zero.alias(c) for c in names), zero.alias("orders"), F.when(F.col("n") > 1, 1).otherwise(0).alias("duplicate_grain"))
    return a.unionByName(b).agg(*(F.sum(c).alias(c) for c in [*names, "orders", "duplicate_grain"]))


def unmatched_keys(fact: DataFrame, source: DataFrame, on: list[str], key_col: str, value: str) -> DataFrame:
    """Distinct source values of the facts that found no dimension row."""
    return fact.filter(F.col(key_col).isNull()).join(source, on).select(value).distinct()


def check_counts(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, actual, expected, status) from two tables (name, n)."""
    a, e = actual.withColumnRenamed("n", "actual"), expected.withColumnRenamed("n", "expected")
    same = F.col("actual").eqNullSafe(F.col("expected"))
    return a.join(e, "name", "full_outer").withColumn("status", F.when(same, "OK").otherwise("MISMATCH"))


def repoint_fact(fact: DataFrame, history: DataFrame, changed: DataFrame, entity: str, ts: str, key_col: str) -> DataFrame:
    """Looks the version keys up again for the facts of changed entities only; others keep theirs."""
    ids = changed.select(entity).distinct()
    stay, go = fact.join(ids, entity, "left_anti"), fact.join(ids, entity, "left_semi")
    again = pit_join(go.drop(key_col), history.select(entity, key_col, "valid_from", "valid_to"), entity, ts, "left")
    return stay.unionByName(again.select(*fact.columns))
