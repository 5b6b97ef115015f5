"""Dictionary lookup over either written form, and parsed entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexora.functions.entries import senses, syllables

FIELDS = ("trad", "simp", "pinyin", "senses_raw")


def complete(dictionary: DataFrame) -> DataFrame:
    """Entries without a null in any field."""
    return dictionary.na.drop("any", subset=list(FIELDS))


def forms(dictionary: DataFrame) -> DataFrame:
    """A row (word, entry) for each different written form, so that lookups are equality joins on one key."""
    return complete(dictionary).select(F.explode(F.array_distinct(F.array("trad", "simp"))).alias("word"), "entry_id", *FIELDS)


def headwords(dictionary: DataFrame) -> DataFrame:
    """The different forms of all rows, complete or not: what membership is tested against."""
    return dictionary.select(F.explode(F.array("trad", "simp")).alias("word")).where("word IS NOT NULL").distinct()


def contains(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """words with in_dictionary; each dictionary form once, so that no row multiplies."""
    known = headwords(dictionary).select(F.col("word").alias("_known"))
    return words.join(known, words["word"] == known["_known"], "left").withColumn("in_dictionary", F.col("_known").isNotNull()).drop("_known")


def lookup(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word and its entries, by entry_id; words without an entry have no row."""
    entry = F.struct("entry_id", "trad", "simp", syllables(F.col("pinyin")).alias("pinyin"), senses(F.col("senses_raw")).alias("senses"))
    found = forms(dictionary).select("word", entry.alias("entry"))
    grouped = found.groupBy("word").agg(F.array_sort(F.collect_list("entry")).alias("entries"))  # homographs of a form: a handful
    return words.select("word").distinct().join(grouped, "word")


def sense_rows(dictionary: DataFrame) -> DataFrame:
    """A row for each sense of each complete entry."""
    return complete(dictionary).select("entry_id", "trad", "simp", F.posexplode(senses(F.col("senses_raw"))).alias("sense_no", "sense")).select("entry_id", "trad", "simp", "sense_no", "sense.glosses", "sense.is_classifier")
