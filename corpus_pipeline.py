"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import stages, store

STAGES = [
    ("quality classifier", stages.keep_quality),
    ("line dedup", stages.drop_lines),
    ("MinHash near-dedup", stages.drop_near_copies),
    ("benchmark decontamination", stages.drop_contaminated),
    ("packing", stages.pack),
]

#: A fitted model, a tokenizer and a first-fit assignment have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`. A stage's scratch tables go when its result is written, and that when the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before = docs
        with store.scope():
            docs = store.keep(store.cut(stage(spark, before, sf_dir)))
        if k:
            store.discard(before)
    return docs
