"""Proportional stratified interleaving: shards of equal size that all hold the same mixture of sources.

Every source's rows are shuffled by a seeded hash and ranked; a row's fractional rank (rank + 1/2) / n says how far
into its source it stands. Rows sorted by it are a sequence of which every stretch holds the sources in proportion, and
cutting that sequence into equal stretches gives the shards. Both ranks are global without a global window: the hash and
the fractional rank are spread evenly, so equal intervals of them are buckets of about BUCKET rows each, a window ranks
a bucket, and sums over the buckets' counts say how many rows stand before it. A source's number of buckets grows with
its rows, so a source that holds a third of all rows is dealt like the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: Rows that a window ranks together, about.
BUCKET = 4_000
SEED = "lakeloom"
#: Bits of the shuffle's hash.
BITS = 60
#: What tells a row of a source from another; rows that are alike in all of it are counted and not told apart.
OWN = ["doc_id", "size", "text_crc32"]


def _shuffled(seed: str, by: str) -> Column:
    """A hash of the seed, the row and its source, 0 <= x < 2^60."""
    held = F.concat_ws("|", F.lit(seed), F.col(by), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "size", "text_crc32")
    return F.conv(F.substring(F.md5(held), 1, BITS // 4), 16, 10).cast("long")


def _before(rows: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Rows of the same keys that stand in earlier buckets, for each bucket: one aggregated row per bucket comes together."""
    counts = rows.groupBy(*keys, bucket).agg(F.sum("copies").alias("here"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*keys, bucket, F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"))


def interleave(docs: DataFrame, by: str = "source", seed: str = SEED, bucket: int = BUCKET) -> DataFrame:
    """(stratum, doc_id, size, text_crc32, place, total): every row's place from 0 in the interleaved sequence of all rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(by, "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # a null source is a stratum of its own, whose name no other source has
    rows = rows.select(F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("-")).alias("stratum"), *OWN, _shuffled(seed, by).alias("h"))
    rows = store.cut(rows.groupBy("stratum", "h", *OWN).agg(F.count("*").alias("copies")))

    strata = store.cut(rows.groupBy("stratum").agg(F.sum("copies").alias("n")))
    rows = rows.join(store.side(strata), "stratum").withColumn("b", F.floor(F.col("h") / F.lit(float(1 << BITS)) * F.ceil(F.col("n") / bucket)).cast("long"))
    order = Window.partitionBy("stratum", "b").orderBy("h", *OWN).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("inside", F.coalesce(F.sum("copies").over(order), F.lit(0))).join(_before(rows, ["stratum"], "b"), ["stratum", "b"])
    # copies stand side by side in their source's order; each has a fractional rank of its own
    ranked = ranked.select("stratum", *OWN, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), (F.col("before") + F.col("inside")).alias("first"))
    ranked = ranked.withColumn("far", ((F.col("first") + F.col("copy")) * 2 + 1).cast("double") / (F.col("n") * 2).cast("double"))
    ranked = store.cut(ranked.select("stratum", *OWN, "far", F.lit(1).cast("long").alias("copies")))

    total = ranked.count()
    ranked = ranked.withColumn("b", F.floor(F.col("far") * max(1, -(-total // bucket))).cast("long"))
    inside = F.row_number().over(Window.partitionBy("b").orderBy("far", "stratum"))
    placed = ranked.withColumn("inside", inside).join(_before(ranked, [], "b"), "b")
    return placed.select("stratum", *OWN, (F.col("before") + F.col("inside") - 1).alias("place"), F.lit(total).cast("long").alias("total"))


def assign(docs: DataFrame, shards: int = 8, by: str = "source", seed: str = SEED) -> DataFrame:
    """(doc_id, stratum, size, text_crc32, shard, slot): a place for every row in one of `shards` shards.

    Shard sizes in rows differ by at most one, and a shard holds of every source what is its share, within a row or
    two; so does any run of slots, of its length. size is the text's UTF-8 bytes plus 1.

    Defined results: a null text counts as empty (size 1, checksum 0); a null id or source is a value like others;
    rows alike in id, source and text are each placed, in any order among them; an empty table gives no row; other
    columns, whatever their names, are not looked at; a text's length plays no part in where it goes.
    """
    placed = interleave(docs, by, seed)
    # shard k holds the places from ceil(k * total / shards) on
    placed = placed.withColumn("shard", F.expr(f"place * {shards} div total"))
    placed = placed.withColumn("slot", F.col("place") - F.expr(f"(shard * total + {shards - 1}) div {shards}"))
    return placed.select("doc_id", "stratum", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")


def write(docs: DataFrame, plan: DataFrame, path: str) -> None:
    """Writes the rows with their shard and slot, in a folder for each shard. Ids must be unique and not null."""
    if docs.filter("doc_id IS NULL").limit(1).count() or docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        raise ValueError("rows are found by doc_id, which is null or not unique")
    rows = docs.drop("shard", "slot").join(plan.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


ORACLE_SQL = f"""WITH steps AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS crc),
  bytes AS (SELECT doc_id, source, list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
  sums AS (SELECT doc_id, source, len(b) + 1 AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c // 256, crc[1 + xor(c % 256, x)]))) AS text_crc32 FROM bytes, steps),
  drawn AS (SELECT *, coalesce('=' || source, '-') AS stratum, ('0x' || substr(md5(concat_ws('|', '{SEED}', source, coalesce(doc_id::VARCHAR, '-'), size, text_crc32)), 1, 15))::BIGINT AS h FROM sums),
  ranked AS (SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY stratum))::DOUBLE AS far FROM drawn),
  placed AS (SELECT *, row_number() OVER (ORDER BY far, stratum) - 1 AS place, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 8 // total)::INTEGER AS shard, place - (place * 8 // total * total + 7) // 8 AS slot, NULL::INTEGER AS grown_shard FROM placed"""
