"""Tables that cut a long lineage, connected components, and size-checked broadcasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from ..sources.scratch import cut, discard, keep, scope  # noqa: F401

#: A side of a join is broadcast only up to this many bytes, as size_of() counts them.
BROADCAST_BYTES = 32 << 20
#: Bytes of a row besides what its columns hold, about.
ROW_BYTES = 40


#: Rows of an Arrow batch, at most: Spark's own bound of 10,000 whole texts takes some 100 MB on either side.
BATCH_ROWS = 2_000


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from here on the session hands Python workers at most BATCH_ROWS of them at a time."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def size_of(df: DataFrame) -> int:
    """Bytes that the rows take in a hash table, about, from their number and the lengths of what they hold."""

    def held(field: StructField) -> Column | int:
        if isinstance(field.dataType, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(field.name), F.lit(0))
        if isinstance(field.dataType, ArrayType):
            inner = field.dataType.elementType
            return F.greatest(F.size(field.name), F.lit(0)) * 8 * (len(inner.fields) if isinstance(inner, StructType) else 1)
        return F.lit(8)

    each = reduce(lambda a, b: a + b, map(held, df.schema.fields), F.lit(ROW_BYTES))
    return df.agg(F.sum(each.cast("long"))).first()[0] or 0


def side(df: DataFrame) -> DataFrame:
    """The side of a join, to be broadcast if its counted size allows it. The rows are read once more for that."""
    return F.broadcast(df) if size_of(df) <= BROADCAST_BYTES else df


def semi(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of `df` whose key is among `ids`: by broadcast if these are small, else by a shuffled join."""
    return df.join(side(ids), on, "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every id in `edges` (a, b), the smallest id reachable.

    Labels fall to the smallest neighbouring label and then jump to their label's label, so the
    number of rounds grows with the logarithm of a component's diameter. Sums per id are combined
    before the shuffle, and no task gets a whole component.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = cut(both)
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        near = label.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("component", "m").alias("next"), "component")
        near = cut(near)
        up = near.select(F.col("id").alias("next"), F.col("next").alias("jump"))
        step = cut(near.join(up, "next").select("id", F.least("next", "jump").alias("component"), (F.least("next", "jump") != F.col("component")).alias("moved")))
        label = step.select("id", "component")
        if not step.filter("moved").limit(1).count():
            return label


def without(df: DataFrame, ids: DataFrame, on: str = "doc_id") -> DataFrame:
    """Rows of `df` whose key is not in `ids`; rows with a null key stay."""
    return df.join(side(cut(ids.select(on).distinct())), on, "left_anti")
