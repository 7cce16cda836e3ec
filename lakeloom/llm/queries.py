"""The registered queries of this subpackage: one `opN_<name>` per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anomaly, contamination, html_main, language_model, lexical, line_dedup, manifest, minhash, packing, quality, sharding, store, suffixes, unit_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id_mod(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(_table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicate(_table(spark, sf_dir, "documents"), least=line_dedup.EVERY)
    gone = F.array_join(F.transform("removed_lines", lambda x: x.cast("string")), ",")
    return out.select("doc_id", "n_lines", "n_removed", gone.alias("removed_lines"), F.md5("kept_text").alias("kept_md5"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_table(spark, sf_dir, "documents"), _id_mod(10) == 0)


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(_table(spark, sf_dir, "documents")).drop("spans")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.digest(unit_dedup.deduplicate(_table(spark, sf_dir, "documents"), unit_dedup.UNIT, unit_dedup.RUN_WORDS))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _id_mod(4) == 2
    scored = quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.CUT_SCORE).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.check(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in manifest.FIELDS]
    leaves, nodes, trees = manifest.build(_table(spark, sf_dir, "documents"), also={"claim": F.when(_id_mod(7) == 0, manifest.leaf_digest(more))})
    proofs = manifest.prove(leaves, nodes, trees).join(store.side(trees.select("tree", "subroot", "root")), "tree")
    verified = F.col("folded_root") == F.col("root")
    return proofs.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", verified.alias("verified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.ORACLE_SQL,
        "op4_minhash_dedup": minhash.ORACLE_SQL,
        "op5_suffix_dedup": suffixes.ORACLE_SQL,
        "op6_substring_dedup": unit_dedup.ORACLE_SQL,
        "op11_sharding": sharding.ORACLE_SQL,
        "op12_ranked_search": lexical.ORACLE_SQL,
        "op13_merkle_manifest": manifest.ORACLE_SQL,
    }
