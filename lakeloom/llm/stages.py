"""Stages of a corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import contamination, line_dedup, minhash, packing, quality, store


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7; learned from the labelled ids with crc32 mod 4 other than 2.

    Rows with a null id stay; null and empty texts are scored like others. Rows are known by their id: all rows of a
    repeated id go if one of their texts scores below. Columns pass through, whatever their names are; an empty table stays empty.
    """
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    scored = quality.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn)
    return store.without(docs, scored.filter(F.col("score") < quality.CUT_SCORE))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are similar to an earlier line; documents that only had such lines go.

    Rows with a null id or text stay as they are. Columns pass through, whatever their names are.
    """
    own = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = line_dedup.deduplicate(own, least=line_dedup.EVERY).filter((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    old = lambda c: F.col("row").getField(c)
    return out.select(*(F.when(F.col("n_removed") == 0, old(c)).otherwise(changed[c]).alias(c) if c in changed else old(c).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Rows with a null id and texts without words stay. Rows that repeat an id are taken for one document:
    it stays if one of its texts does, as the row with the least text.
    """
    verdict = store.cut(minhash.near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    again = store.cut(verdict.filter("kept AND n > 1").select("doc_id"))
    once = store.without(docs, verdict.filter("NOT kept OR n > 1"))
    if again.isEmpty():
        return once
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", *sorted(set(docs.columns) - {"doc_id", "text"})))
    rows = store.semi(docs, again, "doc_id").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), order.alias("place"))
    return once.union(rows.filter("place = 1").select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold half a passage of the benchmark or more.

    Rows with a null id stay; all rows of an id go if one of its texts holds a passage. Columns pass through, whatever
    their names are; an empty table stays empty.
    """
    checked = contamination.check(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return store.without(docs, checked.filter("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; every row is packed, null and empty texts as their end mark. Other columns, whatever
    their names, don't matter; an empty table gives no rows."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
