"""Texts that are shared: internal links, prompts from templates, targets and URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.functions.text import percent_encoded, trimmed

SCHEME, HOST = "lexora", "entry"
DICTIONARY_URL, CHAT_URL = "dictionary://search?q=", "https://chat.example.com/?q="

#: style, scope, template
TEMPLATES = [
    ("quick", "word", "Explain the word {text} as used here: {context}"),
    ("quick", "sentence", "Translate and explain briefly: {text}"),
    ("quick", "paragraph", "Summarise in plain English: {text}"),
    ("full", "word", "Explain {text} with reading, senses, usage and two examples. It occurs in: {context}"),
    ("full", "sentence", "Go through this sentence word by word, then translate it: {text}"),
    ("full", "paragraph", "Translate this paragraph and comment on grammar and rare words: {text}"),
]


def link_url(trad: Column, simp: Column) -> Column:
    return F.concat(F.lit(f"{SCHEME}://{HOST}?s="), percent_encoded(simp), F.lit("&t="), percent_encoded(trad))


def linked(url: Column) -> Column:
    """(trad, simp) of an internal link; null for other schemes, other hosts and links without s; an empty t is s."""
    part = lambda key: F.try_url_decode(F.replace(F.parse_url(url, F.lit("QUERY"), F.lit(key)), F.lit("+"), F.lit("%2B")))
    s, t = part("s"), part("t")
    ours = (F.parse_url(url, F.lit("PROTOCOL")) == SCHEME) & (F.parse_url(url, F.lit("HOST")) == HOST) & (F.coalesce(s, F.lit("")) != "")
    return F.when(ours, F.struct(F.coalesce(F.when(t != "", t), s).alias("trad"), s.alias("simp")))


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "style string, scope string, template string")


def prompts(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows (style, scope, text, context) with prompt; an empty or null context is the text."""
    context = F.when(F.coalesce(F.col("context"), F.lit("")) == "", F.col("text")).otherwise(F.col("context"))
    filled = F.replace(F.replace(F.col("template"), F.lit("{text}"), F.col("text")), F.lit("{context}"), context)
    return rows.join(of, ["style", "scope"]).withColumn("prompt", filled).drop("template")


def shared(text: Column, prompt: Column) -> dict[str, tuple[Column, Column]]:
    """Payload and URL by target; empty texts have neither in the dictionary and the clipboard, while a chat takes any."""
    t = F.when(trimmed(text) != "", trimmed(text))
    return {"dictionary": (t, F.concat(F.lit(DICTIONARY_URL), percent_encoded(t))), "clipboard": (t, F.lit(None).cast("string")), "chat": (trimmed(prompt), F.concat(F.lit(CHAT_URL), percent_encoded(trimmed(prompt))))}
