"""Column functions that parse dictionary entries: pinyin, senses, glosses, link labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexora.constants import CLASSIFIER, HEAD_SPARK, PINYIN, TONES
from lexora.functions.text import parts, trimmed

_LINK = rf"({HEAD_SPARK}+)(?:\|({HEAD_SPARK}+))?{PINYIN}"
#: A head word with pinyin, or pinyin alone.
REFERENCE = rf"{HEAD_SPARK}+(?:\|{HEAD_SPARK}+)?{PINYIN}|{PINYIN}"


def accented(syllable: Column) -> Column:
    """A syllable with a tone number as one with an accent; any other text unchanged.

    The accent goes to a, else e, else the o of ou, else the last vowel; only
    lower-case vowels can carry it.
    """
    tone = F.try_to_number(F.right(syllable, F.lit(1)), F.lit("9")).cast("int")
    plain = F.replace(F.replace(F.left(syllable, F.length(syllable) - 1), F.lit("u:"), F.lit("ü")), F.lit("v"), F.lit("ü"))
    last = F.length(F.regexp_extract(plain, "^(.*)[aeiouü]", 1)) + 1
    at = F.when(F.instr(plain, "a") > 0, F.instr(plain, "a")).when(F.instr(plain, "e") > 0, F.instr(plain, "e"))
    at = at.when(F.instr(plain, "ou") > 0, F.instr(plain, "ou")).when(plain.rlike("[aeiouü]"), last)
    table = F.lit("".join(TONES.values()))
    row = F.instr(F.lit("".join(TONES)), F.substring(plain, at, F.lit(1)))
    vowel = F.substring(table, (row - 1) * 5 + tone, F.lit(1))
    marked = F.when(at.isNull(), plain).otherwise(F.concat(F.substring(plain, F.lit(1), at - 1), vowel, F.substring(plain, at + 1, F.length(plain))))
    return F.when(syllable.rlike("[1-5]$"), marked).otherwise(syllable)


def syllables(pinyin: Column) -> Column:
    return F.transform(F.filter(F.split(pinyin, " "), lambda x: x != ""), accented)


def senses(raw: Column) -> Column:
    """Array of (glosses, is_classifier); glosses aren't parsed yet."""
    return F.transform(parts(raw, "/"), lambda s: F.struct(
        parts(F.when(s.startswith(CLASSIFIER), F.substring(s, F.lit(len(CLASSIFIER) + 1), F.length(s))).otherwise(s), ";").alias("glosses"),
        s.startswith(CLASSIFIER).alias("is_classifier")))


def fragments(gloss: Column) -> Column:
    """Array of (kind, text, trad, simp): texts, links to head words, pinyin, in order; a gloss without any is one text."""
    kind = lambda k, text, trad=None, simp=None: F.struct(F.lit(k).alias("kind"), text.alias("text"), (trad if trad is not None else F.lit(None).cast("string")).alias("trad"), (simp if simp is not None else F.lit(None).cast("string")).alias("simp"))
    found = F.regexp_extract_all(gloss, F.lit(REFERENCE), F.lit(0))
    gaps = F.split(gloss, REFERENCE, -1)

    def reference(m: Column) -> Column:
        trad, simp = F.regexp_extract(m, _LINK, 1), F.regexp_extract(m, _LINK, 2)
        simp = F.when(simp == "", trad).otherwise(simp)
        read = kind("pinyin", F.array_join(syllables(F.regexp_extract(m, PINYIN, 1)), " "))
        link = kind("link", F.when(trad == simp, trad).otherwise(F.concat(trad, F.lit("/"), simp)), trad, simp)
        return F.when(m.startswith("["), F.array(read)).otherwise(F.array(link, read))

    each = F.transform(gaps, lambda g, i: F.concat(F.array(kind("text", trimmed(g))), F.when(F.get(found, i).isNotNull(), reference(F.get(found, i))).otherwise(F.array())))
    kept = F.filter(F.flatten(each), lambda f: (f["kind"] != "text") | (f["text"] != ""))
    return F.when(F.size(kept) == 0, F.array(kind("text", gloss))).otherwise(kept)


def headword(trad: Column, simp: Column) -> Column:
    return F.when(trad == simp, simp).otherwise(F.concat(simp, F.lit("["), trad, F.lit("]")))
