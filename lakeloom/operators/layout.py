"""File layout of Parquet tables: rewriting, compaction, clustering and what a lookup has to open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import exists, file_of_row, move, path_of, remove
from ..sources.scratch import cut, discard


#: Bytes of a table, as it is stored, that tests of layouts leave to one task.
TASK_BYTES = 64 << 20


def parts_of(spark: SparkSession, path: str) -> int:
    """How many parts of about TASK_BYTES a stored table has, by its files' sizes."""
    return max(1, -(-file_report(spark, path).first()["bytes"] // TASK_BYTES))


def with_part(df: DataFrame, n: int, cols: list[str], name: str = "part") -> DataFrame:
    """Adds a part, 0 to n - 1, that the values of `cols` decide."""
    return df.withColumn(name, F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int"))


def rewrite(df: DataFrame, path: str, n: int, by: str | None = None, parts: int = 1) -> None:
    """Writes n files; with `by`, a number from 0 to parts - 1, n files in the partition of each."""
    if by:
        slot = (F.col(by) * n + F.monotonically_increasing_id() % n).cast("int")
        df.withColumn("_slot", slot).repartitionById(n * parts, "_slot").drop("_slot").write.mode("overwrite").partitionBy(by).parquet(path)
        return
    df.repartition(n).write.mode("overwrite").parquet(path)


def file_report(spark: SparkSession, path: str) -> DataFrame:
    """One row: files and their bytes."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def compact(spark: SparkSession, path: str, out: str, target_bytes: int = 128 << 20, by: list[str] | None = None) -> int:
    """Rewrites a table into files of about target_bytes, without a shuffle where there are more files now; the number asked for.
    A table in partitions (`by`) stays in them, and every one gets its own files: a task writes one file of one partition."""
    if by:
        per = spark.read.parquet(path).select(*by, "_metadata.file_path", "_metadata.file_size").distinct().groupBy(*by)
        sizes = cut(per.agg(F.greatest(F.lit(1), F.ceil(F.sum("file_size") / target_bytes)).cast("int").alias("_n")))  # a row per partition
        first = F.coalesce(F.sum("_n").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        told = sizes.select(*(F.col(c).alias(f"_{c}") for c in by), "_n", first.alias("_first"))
        n = sizes.agg(F.sum("_n")).first()[0] or 1
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
        rows = spark.read.parquet(path)
        slot = (F.col("_first") + F.monotonically_increasing_id() % F.col("_n")).cast("int")
        dealt = rows.join(F.broadcast(told), same).withColumn("_slot", slot).repartitionById(n, "_slot").select(*rows.columns)
        dealt.write.mode("overwrite").partitionBy(*by).parquet(out)
        discard(sizes)
        return n
    size = file_report(spark, path).first()
    n = max(1, -(-size["bytes"] // target_bytes))
    df = spark.read.parquet(path)
    (df.coalesce(n) if n <= df.rdd.getNumPartitions() else df.repartition(n)).write.mode("overwrite").parquet(out)
    return n


#: Small files that one round of `compact_small` takes: their paths go to the driver, as those of any scan do.
MAX_FILES = 200_000


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file, folder, bytes) of every data file below `path`, by listing alone; files are named as rows name them."""
    listed = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.parquet").load(path)
    return listed.select(file_of_row().alias("file"), F.regexp_replace(file_of_row(), "/[^/]*$", "").alias("folder"), F.col("length").alias("bytes"))


def alike(c: str) -> Column:
    """The one value that a group's rows have in c, or null if they differ."""
    return F.when(F.min(c) == F.max(c), F.max(c))


def packing_plan(sizes: DataFrame, target_bytes: int) -> DataFrame:
    """(file, folder, bytes, bin): which files are written together. Files of half the target and more stay; the others of a
    folder, largest first, fill bins of about the target (less than one and a half). A bin of one file stays too."""
    small = sizes.filter(F.col("bytes") * 2 < target_bytes)
    own = Window.partitionBy("folder").orderBy(F.desc("bytes"), "file").rowsBetween(Window.unboundedPreceding, -1)
    binned = small.withColumn("bin", F.floor(F.coalesce(F.sum("bytes").over(own), F.lit(0)) / target_bytes))
    return binned.withColumn("_n", F.count("*").over(Window.partitionBy("folder", "bin"))).filter("_n > 1").drop("_n")


def in_rounds(plan: DataFrame, most: int) -> DataFrame:
    """(file, round, slot) of a packing plan: rounds begin after every `most` files and take whole bins, so that one has less than `most`
    files and a bin; slots number the bins of a round."""
    per = plan.groupBy("folder", "bin").agg(F.count("*").alias("_n"))  # a row per bin
    before = F.coalesce(F.sum("_n").over(Window.orderBy("folder", "bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = per.withColumn("round", F.floor(before / most).cast("int")).drop("_n")
    slot = F.row_number().over(Window.partitionBy("round").orderBy("folder", "bin")) - 1
    return plan.join(dealt.withColumn("slot", slot), ["folder", "bin"]).select("file", "round", "slot")


def compact_small(spark: SparkSession, path: str, target_bytes: int = 128 << 20) -> int:
    """Packs the small files of every partition of the table at `path` into files of about the target; the number of files made.

    Large files aren't read. Small ones are packed in rounds of about MAX_FILES, until none is left. In each, the new files
    are written aside, then the old ones are named in a list, and only then are they swapped; `recover_compaction`, which
    runs first, ends a swap that was broken off. Nobody should read the table while files are swapped.
    """
    recover_compaction(spark, path)
    bins = cut(in_rounds(packing_plan(file_sizes(spark, path), target_bytes), MAX_FILES))  # a row per small file
    rounds = sorted(r["round"] for r in bins.select("round").distinct().collect())
    made = sum(_pack(spark, path, bins.filter(F.col("round") == k).select("file", "slot")) for k in rounds)
    discard(bins)
    return made


def _pack(spark: SparkSession, path: str, bins: DataFrame) -> int:
    """One round of `compact_small`: a file for each slot takes the place of the slot's files. Folders keep their names, and columns
    that only some of the files have stay, whatever files the round has."""
    old = [path_of(r["file"]) for r in bins.select("file").collect()]
    n = bins.agg(F.max("slot")).first()[0] + 1
    schema = spark.read.option("mergeSchema", True).parquet(*old).schema
    by = [c for c in spark.read.option("basePath", path).parquet(old[0]).columns if c not in schema.names]  # what the folders tell
    for c in by:
        schema = schema.add(c, "string")
    rows = spark.read.schema(schema).option("basePath", path).parquet(*old)
    there = rows.select("*", file_of_row().alias("_file")).join(F.broadcast(bins.withColumnRenamed("file", "_file")), "_file")
    writer = there.repartitionById(n, "slot").select(*schema.names).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/{FRESH}")
    if (made := spark.read.parquet(f"{path}/{FRESH}").count()) != (had := rows.count()):
        raise OSError(f"{made} rows were written of {had}")
    spark.createDataFrame([(f,) for f in old], "file string").coalesce(1).write.parquet(f"{path}/{FRESH}.list")
    move(spark, f"{path}/{FRESH}.list", f"{path}/{OLD}")
    recover_compaction(spark, path)
    return n


#: Folders beside a table's partitions that readers pass over: files that are to be swapped in, and the list of those that go.
FRESH, OLD = "_fresh", "_old"


def recover_compaction(spark: SparkSession, path: str) -> None:
    """Ends a compaction whose list of old files is there; what one without a list had written is removed."""
    if exists(spark, f"{path}/{OLD}"):
        for r in spark.read.parquet(f"{path}/{OLD}").collect():  # before what replaces them comes in, so that no row is seen twice
            remove(spark, r["file"])
        if exists(spark, f"{path}/{FRESH}"):
            fresh = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.parquet").load(f"{path}/{FRESH}")
            for r in fresh.select("path").collect():
                move(spark, r["path"], r["path"].replace(f"/{FRESH}/", "/"))
        remove(spark, f"{path}/{FRESH}")
        remove(spark, f"{path}/{OLD}")
    else:
        remove(spark, f"{path}/{FRESH}")
        remove(spark, f"{path}/{FRESH}.list")


def _bucket(c: str, edges: list) -> Column:
    """Number of the quantile bucket that a value lies in."""
    return reduce(lambda a, e: a + F.when(F.col(c) >= e, 1).otherwise(0), edges, F.lit(0))


def interleave(buckets: list[Column], bits: int) -> Column:
    """Z-order value: the bits of the bucket numbers, in turn."""
    z = F.lit(0).cast("long")
    for b in range(bits):
        for k, c in enumerate(buckets):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), b * len(buckets) + k))
    return z


def cluster(df: DataFrame, cols: list[str], path: str, files: int, bits: int = 4) -> None:
    """Writes files with narrow value ranges: by range of one column, by Z-order over quantile buckets of several."""
    if len(cols) == 1:
        df.repartitionByRange(files, cols[0]).sortWithinPartitions(cols[0]).write.mode("overwrite").parquet(path)
        return
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    edges = df.approxQuantile(cols, steps, 0.005)
    z = interleave([_bucket(c, sorted(set(e))) for c, e in zip(cols, edges)], bits)
    df.withColumn("_z", z).repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z").write.mode("overwrite").parquet(path)


def rows_scanned(df: DataFrame) -> int:
    """Rows that the scan of a table hands on, by Spark's own count, when `df`, a filtered scan, is run: files and row groups
    whose ranges can't hold what is asked for are passed over."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    return run.executedPlan().collectLeaves().apply(0).metrics().get("numOutputRows").get().value()
