"""The driver's tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Roles:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        return self.table(name)

    def sales(self) -> DataFrame:
        """Items with their order: the fact that revenue questions are asked on."""
        items = self.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
        return items.join(self.orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))

    def customer_geo(self) -> DataFrame:
        nation, region = F.broadcast(self.nation), F.broadcast(self.region)  # 25 and 5 rows at every scale
        return self.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")

    def priority_events(self) -> DataFrame:
        """A customer attribute that changes with every order: the tracked value of the history."""
        return self.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
