"""Revenue questions on a star schema; columns are named by the caller's frames: `month`, `revenue` and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exact_sum
from .relational import rollup, top_k, top_n

TO_CENTS = "decimal(18,2)"


def monthly_revenue(fact: DataFrame, ts: str, amount: str) -> DataFrame:
    return fact.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(exact_sum(amount).alias("revenue"))


def monthly_revenue_running(fact: DataFrame, ts: str, amount: str) -> DataFrame:
    """Revenue per month and its running total. The window sees one row per month."""
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    monthly = monthly_revenue(fact, ts, amount)
    return monthly.withColumn("running_total", F.sum(F.col("revenue").cast(TO_CENTS)).over(w).cast("double"))


def mom_change(fact: DataFrame, ts: str, amount: str) -> DataFrame:
    """Change to the month before, in amount and percent; null for the first month."""
    monthly = monthly_revenue(fact, ts, amount).withColumn("previous", F.lag("revenue").over(Window.orderBy("month")))
    change = (F.col("revenue").cast(TO_CENTS) - F.col("previous").cast(TO_CENTS)).cast("double")
    return monthly.withColumn("change", change).withColumn("change_pct", 100.0 * F.col("change") / F.nullif("previous", F.lit(0.0)))


def top_products(fact: DataFrame, group: str, product: str, amount: str, n: int = 3) -> DataFrame:
    sums = fact.groupBy(group, product).agg(exact_sum(amount).alias("revenue"))
    return top_n(sums, [group], [F.desc("revenue"), F.asc(product)], n)


def seller_rank(fact: DataFrame, seller: str, amount: str, k: int = 20) -> DataFrame:
    """The first k sellers with rank and dense rank. The ranks of a prefix need only the prefix, so only k rows meet in one task."""
    head = top_k(fact.groupBy(seller).agg(exact_sum(amount).alias("revenue")), [F.desc("revenue"), F.asc(seller)], k)
    w = Window.orderBy(F.desc("revenue"))
    return head.withColumns({"revenue_rank": F.rank().over(w).cast("long"), "revenue_dense_rank": F.dense_rank().over(w).cast("long")})


def revenue_rollup(fact: DataFrame, keys: list[str], amount: str, labels: dict[str, str]) -> DataFrame:
    return rollup(fact, keys, {"items": F.count("*"), "revenue": exact_sum(amount)}, labels)


def revenue_by_state(fact: DataFrame, state: str, amount: str, k: int = 5) -> DataFrame:
    sums = fact.groupBy(state).agg(F.count("*").alias("items"), exact_sum(amount).alias("revenue"))
    return top_k(sums, [F.desc("revenue"), F.asc_nulls_last(state)], k)
