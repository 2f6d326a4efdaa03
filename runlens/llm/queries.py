"""The registered queries of this subpackage and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import chat, decontaminate, exact_dedup, jaccard_join, license_scan, line_dedup, minhash_forest, packing, prefix_trie, quality, spelling, token_files, toxicity
from runlens.llm.common import scratch_path, table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.perspectives(table(spark, sf_dir, "conversations"))
    return out.withColumn("masks", F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ","))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), 2)
    return token_files.digests(token_files.read_tokens(spark, path))


def op7_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 0).drop("row")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_chat_rotation": op4_chat_rotation,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_orc": op6_token_orc,
    "op7_toxicity_neighbours": op7_toxicity_neighbours,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_quality_discriminant": op10_quality_discriminant,
    "op11_minhash_forest": op11_minhash_forest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op3_license_scan": license_scan.SQL,
    "op4_chat_rotation": chat.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op9_ngram_jaccard_join": jaccard_join.SQL,
    "op11_minhash_forest": minhash_forest.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_spelling_variants": spelling.SQL,
}
