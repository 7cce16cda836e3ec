"""Ingesting files once, by a ledger of what was taken in.

A file is known by its path, size and modification time, not by the day it is read on. Rows are written first, under a
batch of their own, and the ledger's entry comes last: it is what commits a batch, so rows of a run that was ended
before it are never seen and the next run takes the file again. A file that changed under its name replaces what it had
brought. Nothing that was written is rewritten; what counts is told by the ledger when a table is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import row_bytes
from .files import append, exists, file_of_row, path_of, read_csv

#: What a file is known by.
FILE = ["_source_file", "_size", "_modified"]
ENTRY = "_source_file string, _size long, _modified timestamp, _batch string, _ingested_at timestamp"
#: Ledger entries are sent to all tasks up to so many bytes, which are counted first.
BROADCAST_BYTES = 64 << 20


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= BROADCAST_BYTES else df


def _ledger(spark: SparkSession, root: str, name: str) -> tuple[str, DataFrame]:
    path = f"{root.rstrip('/')}/_ledger/{name}"
    return path, spark.read.schema(ENTRY).parquet(path) if exists(spark, path) else spark.createDataFrame([], ENTRY)


def listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(_source_file, _size, _modified) of all files there; their content isn't read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(file_of_row().alias("_source_file"), F.col("length").alias("_size"), F.col("modificationTime").alias("_modified"))


def live(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The ledger's last entry of every file: the batch whose rows of it count."""
    entries = _ledger(spark, root, name)[1]
    last = Window.partitionBy("_source_file").orderBy(F.desc("_ingested_at"), F.desc("_modified"), F.desc("_batch"))
    return entries.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")


def pending(spark: SparkSession, path: str | list[str], root: str, name: str) -> DataFrame:
    """Files there that aren't in the table as they are now: new ones, and those whose size or time differs from the last entry's."""
    return listed(spark, path).join(_small(live(spark, root, name).select(*FILE)), FILE, "left_anti")


def ingest(spark: SparkSession, name: str, path: str | list[str], root: str, schema: StructType | str | None = None, at: Column | None = None, read: Callable[..., DataFrame] = read_csv) -> int:
    """Takes the pending files at `path` into root/name and returns their number.

    Rows get _source_file, _ingested_at, _ingestion_date and _batch. `at` is the time of the run, now if not given.
    """
    found = pending(spark, path, root, name).collect()  # a row per new file, as the reader keeps them too
    if not found:
        return 0
    at = F.current_timestamp() if at is None else at
    now = spark.range(1).select(at.cast("timestamp")).first()[0]
    stamp, batch = F.lit(now).cast("timestamp"), uuid.uuid4().hex
    rows = read(spark, [path_of(r["_source_file"]) for r in found], schema).withColumn("_source_file", file_of_row())
    rows = rows.withColumns({"_ingested_at": stamp, "_ingestion_date": F.to_date(stamp), "_batch": F.lit(batch)})
    append(rows, f"{root.rstrip('/')}/{name}", ["_batch"])
    entries = spark.createDataFrame(found, "_source_file string, _size long, _modified timestamp")
    append(entries.withColumns({"_batch": F.lit(batch), "_ingested_at": stamp}).coalesce(1), _ledger(spark, root, name)[0])
    return len(found)


def ingest_each(spark: SparkSession, sources: dict[str, str | list[str]], root: str, schemas: dict[str, StructType] | None = None, at: Column | None = None) -> dict[str, int]:
    """Takes in what is pending of every named source; each table is committed by itself, so a run that was ended goes on where it stopped."""
    return {name: ingest(spark, name, path, root, (schemas or {}).get(name), at) for name, path in sources.items()}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table's rows that count: of every file those of its last committed batch. Batches are partitions, so others aren't read."""
    rows = spark.read.parquet(f"{root.rstrip('/')}/{name}")
    return rows.join(_small(live(spark, root, name).select("_batch", "_source_file")), ["_batch", "_source_file"], "left_semi").select(*rows.columns)
