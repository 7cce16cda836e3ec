"""Type-1 dimensions and the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import day_of_week
from ..sources.files import date_spine
from .keys import add_surrogate_key
from .relational import lookup


def build_dim_date(spark: SparkSession, start: str, end: str, key: str = "yyyymmdd", sunday: int = 0) -> DataFrame:
    """Calendar with a key of the form YYYYMMDD, or dense from 1; weekdays from `sunday`."""
    d, first = F.col("full_date"), F.lit(start).cast("date")
    number = F.date_format(d, "yyyyMMdd").cast("long") if key == "yyyymmdd" else (F.datediff(d, first) + 1).cast("long")
    return date_spine(spark, start, end).select(
        number.alias("date_key"),
        "full_date",
        F.dayofmonth(d).cast("long").alias("day_of_month"),
        day_of_week(d, sunday).cast("long").alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.weekofyear(d).cast("long").alias("week_of_year"),
        F.month(d).cast("long").alias("month_num"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.quarter(d).cast("long").alias("quarter"),
        F.year(d).cast("long").alias("year"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"),
        F.lit(False).alias("is_holiday"),
    )


def build_mode_avg_dim(df: DataFrame, key: str, avg_cols: list[str], mode_cols: list[str], name: str = "dim_key") -> DataFrame:
    """Per key the averages and the most frequent values; tied modes give the smallest, nulls don't count. One aggregation."""
    aggs = [F.avg(c).alias(f"avg_{c}") for c in avg_cols] + [F.mode(c, True).alias(f"mode_{c}") for c in mode_cols]
    return add_surrogate_key(df.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs), name, [key])


def build_type1_dim(df: DataFrame, cols: list[str], key: list[str], name: str = "dim_key") -> DataFrame:
    return add_surrogate_key(df.select(*cols), name, key)


def build_lookup_dim(df: DataFrame, translation: DataFrame, on: str, cols: list[str], key: list[str], name: str = "dim_key") -> DataFrame:
    """A dimension with a translated column beside the source's; what has no translation stays null."""
    translated = [c for c in translation.columns if c != on]
    return add_surrogate_key(lookup(df, translation, [on]).select(*cols, *translated), name, key)


def build_distinct_dim(df: DataFrame, c: str, name: str = "dim_key") -> DataFrame:
    return add_surrogate_key(df.select(c).filter(F.col(c).isNotNull()).distinct(), name, [c])
