"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.llm import lsh_forest, matrix_bpe, packing, pairwise_quality, perspectives, rule_cascade, slot_sharding, url_models, warc_zip, weighted_sampling
from lexora.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_models.judge(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), pattern())


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.join(table(spark, sf_dir, "documents"))


def op6_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rule_cascade.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprints(table(spark, sf_dir, "documents"))


def op8_matrix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op9_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = slot_sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.digest(perspectives.rotate(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_warc_zip, op2_url_models, op3_packing, op4_pairwise_quality, op5_lsh_forest, op6_rule_cascade, op7_weighted_sampling, op8_matrix_bpe, op9_slot_sharding, op10_perspectives)}


def oracle_sql() -> dict[str, str]:
    return {"op6_rule_cascade": rule_cascade.ORACLE, "op10_perspectives": perspectives.ORACLE}
