"""From raw documents to packed sequences: four stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexora.llm import lsh_forest, packing, pairwise_quality, rule_cascade
from lexora.llm.common import cut, table
from lexora.llm.queries import pattern, vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least the threshold; scores rest on the texts alone, the fit on labels that aren't held out."""
    return pairwise_quality.accepted(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return rule_cascade.accepted(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of copies and near copies the document of the smallest doc_id."""
    return lsh_forest.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), pattern())


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("ngram_jaccard_join", ngram_jaccard_join), ("packing", pack)]

#: No SQL: tokenization and the fitted classifier aren't expressible; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
