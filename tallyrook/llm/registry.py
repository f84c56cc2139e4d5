"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyrook.llm import bag_search, bottom_k, bpe, chat_template, decontaminate, jaccard_join, lang_id, licenses, media, periodic_runs, quality, sharding, substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks() -> tuple[str, str]:
    """The default rank file and its split pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    return chat_template.conversation_digests(rows.unionByName(spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_digests(_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_digests(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digests(_table(spark, sf_dir, "documents"), 40)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digests(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), *ranks())


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.near_copies(_table(spark, sf_dir, "documents"))


def op12_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_media_columns, op3_decontamination, op4_chat_format, op5_language_id, op6_jaccard_join, op7_substring_dedup,
        op8_sharding, op9_license_scan, op10_byte_bpe, op11_minhash_dedup, op12_bag_search, op13_periodic_runs,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": decontaminate.CONTAMINATION_SQL,
    "op4_chat_format": chat_template.CONVERSATION_SQL,
    "op6_jaccard_join": jaccard_join.COMPONENTS_SQL,
    "op7_substring_dedup": substring_dedup.REPEATS_SQL,
    "op9_license_scan": licenses.LICENSE_SQL,
    "op11_minhash_dedup": bottom_k.NEAR_COPIES_SQL,
    "op12_bag_search": bag_search.RANKED_SQL,
    "op13_periodic_runs": periodic_runs.RUNS_SQL,
}
