"""Reading and writing tables as files: scans, appends, publishes and guards."""

from __future__ import annotations

from datetime import date
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import cut


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, as_text: bool = False) -> DataFrame:
    """CSV with a header, quoted multi-line fields and doubled quotes; typed by the schema, as text, or inferred."""
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"')
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", not as_text).csv(path)


def read_table(spark: SparkSession, root: str, layer: str, name: str) -> DataFrame:
    path = f"{root.rstrip('/')}/{layer}/{name}"
    recover(spark, path)
    return spark.read.parquet(path)


def register(df: DataFrame, name: str) -> DataFrame:
    """Makes the rows readable by SQL text under a name."""
    df.createOrReplaceTempView(name)
    return df


def temp_table(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed once, under a name that lasts as long as the session; they lie in the shared scratch folder."""
    return register(cut(df), name)


def inline_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def date_spine(spark: SparkSession, start: date | str, end: date | str) -> DataFrame:
    """One row per day, both ends included."""
    days = F.sequence(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"), F.expr("INTERVAL 1 DAY"))
    return spark.range(1).select(F.explode(days).alias("full_date"))


def file_of_row() -> Column:
    """Path of the file that a scanned row came from, as a URI: `path_of` gives the name that readers and folders know."""
    return F.col("_metadata.file_path")


def path_of(uri: str) -> str:
    return unquote(uri)


def with_lineage(df: DataFrame, source: str | Column, at: Column | None = None) -> DataFrame:
    """Adds _ingested_at, _source_file and _ingestion_date."""
    at = F.current_timestamp() if at is None else at
    return df.withColumns({"_ingested_at": at, "_source_file": F.lit(source) if isinstance(source, str) else source, "_ingestion_date": F.to_date(at)})


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def insert_into(df: DataFrame, path: str) -> None:
    """Appends the rows in the target's column order and types; a missing or surplus column is an error."""
    target = df.sparkSession.read.parquet(path)
    if set(df.columns) != set(target.columns):
        raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(target.columns))}")
    append(df.select(*(F.col(f.name).cast(f.dataType) for f in target.schema)), path)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, P = _filesystem(spark, path)
    return fs.exists(P(path))


def recover(spark: SparkSession, path: str) -> None:
    """Puts back what `publish` had moved aside if it was ended between its two renames."""
    fs, P = _filesystem(spark, path)
    old = P(path.rstrip("/") + ".previous")
    if not fs.exists(P(path)) and fs.exists(old) and not fs.rename(old, P(path)):
        raise OSError(f"can't move {old} back")


def publish(df: DataFrame, path: str, same_schema: bool = False) -> None:
    """Replaces the table at `path`. The rows are written beside it and then swapped in, so `df` may
    read the table that it replaces, and a failed write leaves it untouched. If a publish was ended
    between its two renames, the next one and `read_table` put the older table back first."""
    spark = df.sparkSession
    recover(spark, path)
    fs, P = _filesystem(spark, path)
    if same_schema and fs.exists(P(path)):
        shape = lambda s: [(f.name, f.dataType.simpleString()) for f in s]
        if shape(old := spark.read.parquet(path).schema) != shape(df.schema):
            raise ValueError(f"schema differs from the published {old.simpleString()}")
    fresh, old = path.rstrip("/") + ".next", path.rstrip("/") + ".previous"
    df.write.mode("overwrite").parquet(fresh)
    if fs.exists(P(path)):
        fs.delete(P(old), True)
        if not fs.rename(P(path), P(old)):
            raise OSError(f"can't move {path}")
    if not fs.rename(P(fresh), P(path)):
        raise OSError(f"can't move {fresh}")
    fs.delete(P(old), True)


def create_as(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Drops and creates a catalog table from the rows, in the warehouse or in a folder of its own."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Moves a file or folder over what stands there."""
    fs, P = _filesystem(spark, new)
    fs.delete(P(new), True)
    fs.mkdirs(P(new).getParent())
    if not fs.rename(P(old), P(new)):
        raise OSError(f"can't move {old}")


def remove(spark: SparkSession, path: str) -> None:
    fs, P = _filesystem(spark, path)
    fs.delete(P(path), True)


def append_once(df: DataFrame, path: str, batch_cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Appends only the batches that the table doesn't have yet, and returns the rows appended."""
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.parquet(path).select(*batch_cols).distinct(), batch_cols, "left_anti")
    append(df, path, by)
    return df


def ingest_all(spark: SparkSession, files: dict[str, str], root: str, schemas: dict[str, StructType] | None = None, once: bool = True) -> None:
    """Reads every named CSV file and appends it, with lineage, to root/name by ingestion date; `once`: unless a file of
    that name is there from any day. Where files change under their names, `ledger.ingest_each` tells."""
    for name, path in files.items():
        rows = with_lineage(read_csv(spark, path, (schemas or {}).get(name)), path.rsplit("/", 1)[-1])
        target = f"{root.rstrip('/')}/{name}"
        if once:
            append_once(rows, target, ["_source_file"], ["_ingestion_date"])
        else:
            append(rows, target, ["_ingestion_date"])
