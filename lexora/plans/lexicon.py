"""Queries on the dictionary: lookup, parsing, numbering, links, sharing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexora import fixtures
from lexora.constants import HEAD_DUCK, QUERY_KEPT, TONES, TRIMMED
from lexora.functions import entries as fn
from lexora.functions.text import percent_encoded, quoted, runs
from lexora.operators import dictionary as dic
from lexora.operators import share
from lexora.plans.registry import longs, query, table
from lexora.plans.texts import han_docs
from lexora.shared import fresh
from lexora.sources import stores

DICT = fixtures.dictionary_sql()
COMPLETE = "trad IS NOT NULL AND simp IS NOT NULL AND pinyin IS NOT NULL AND senses_raw IS NOT NULL"
FORMS = f"f AS (SELECT DISTINCT entry_id, trad, simp, pinyin, senses_raw, unnest([trad, simp]) AS word FROM dict_raw WHERE {COMPLETE})"


def trimmed_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{TRIMMED}]+|[{TRIMMED}]+$', '', 'g')"


def accented_sql(s: str) -> str:
    plain = f"replace(replace(left({s}, greatest(length({s}) - 1, 0)), 'u:', 'ü'), 'v', 'ü')"
    pos = f"CASE WHEN strpos({plain}, 'a') > 0 THEN strpos({plain}, 'a') WHEN strpos({plain}, 'e') > 0 THEN strpos({plain}, 'e') WHEN strpos({plain}, 'ou') > 0 THEN strpos({plain}, 'ou') WHEN regexp_matches({plain}, '[aeiouü]') THEN length(regexp_extract({plain}, '^(.*)[aeiouü]', 1)) + 1 END"
    vowel = f"substr('{''.join(TONES.values())}', (strpos('{''.join(TONES)}', substr({plain}, {pos}, 1)) - 1) * 5 + CAST(right({s}, 1) AS INT), 1)"
    return f"CASE WHEN regexp_matches({s}, '[1-5]$') THEN CASE WHEN ({pos}) IS NULL THEN {plain} ELSE left({plain}, ({pos}) - 1) || {vowel} || substr({plain}, ({pos}) + 1) END ELSE {s} END"


def _senses(spark: SparkSession) -> DataFrame:
    return dic.sense_rows(fixtures.dictionary(spark))


SENSES = f"""
s0 AS (SELECT entry_id, trad, simp, list_filter(list_transform(string_split(senses_raw, '/'), lambda x: {trimmed_sql("x")}), lambda x: x <> '') AS l FROM dict_raw WHERE {COMPLETE}),
s1 AS (SELECT entry_id, trad, simp, unnest(range(0, len(l))) AS sense_no, unnest(l) AS sense FROM s0),
s AS (SELECT entry_id, trad, simp, sense_no, starts_with(sense, 'CL:') AS is_classifier,
             list_filter(list_transform(string_split(CASE WHEN starts_with(sense, 'CL:') THEN substr(sense, 4) ELSE sense END, ';'), lambda x: {trimmed_sql("x")}), lambda x: x <> '') AS glosses FROM s1)"""


# ---- lookup


@query(f"""WITH {DICT}, {fixtures.han_sql()}, r AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\x{{4E00}}-\\x{{9FFF}}]')) AS word FROM han)
SELECT word, EXISTS (SELECT 1 FROM dict_raw d WHERE d.trad = r.word OR d.simp = r.word) AS in_dictionary FROM r""")
def dict_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of every different character of the Han texts."""
    words = han_docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"[\x{4E00}-\x{9FFF}]"), F.lit(0))).alias("word")).distinct()
    return dic.contains(words, fixtures.dictionary(spark))


@query(f"""WITH {DICT}, {FORMS}, {fixtures.han_sql()}, r AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\x{{4E00}}-\\x{{9FFF}}]+')) AS word FROM han)
SELECT r.word, count(*) AS n_entries, string_agg(f.entry_id || ':' || array_to_string(list_transform(string_split(f.pinyin, ' '), lambda x: {accented_sql("x")}), ' '), '; ' ORDER BY f.entry_id) AS readings
FROM r JOIN f ON f.word = r.word GROUP BY r.word""")
def dict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = han_docs(spark, sf_dir).select(F.explode(runs(F.col("text"))).alias("word"))
    found = dic.lookup(words, fixtures.dictionary(spark))
    reading = F.transform("entries", lambda e: F.concat(e["entry_id"].cast("string"), F.lit(":"), F.array_join(e["pinyin"], " ")))
    return longs(found.select("word", F.size("entries").alias("n_entries"), F.array_join(reading, "; ").alias("readings")), "n_entries")


@query(f"""WITH {DICT}, {FORMS}, {fixtures.han_sql()}, r AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\x{{4E00}}-\\x{{9FFF}}]+')) AS word FROM han)
SELECT word FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.word = r.word)""")
def dict_lookup_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words without a complete entry: no result, not an empty one."""
    words = han_docs(spark, sf_dir).select(F.explode(runs(F.col("text"))).alias("word")).distinct()
    return words.join(dic.forms(fixtures.dictionary(spark)).select("word"), "word", "left_anti")


@query(f"WITH {DICT} SELECT trad, simp, pinyin, senses_raw FROM dict_raw WHERE {COMPLETE}")
def dict_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary written as lines, among notes and broken lines, and read back."""
    line = F.concat("trad", F.lit(" "), "simp", F.lit(" ["), "pinyin", F.lit("] "), "senses_raw").alias("value")
    lines = dic.complete(fixtures.dictionary(spark)).select(line).union(spark.createDataFrame([("# a note [x1] /y/",), ("broken",), ("",)], "value string"))
    path = fresh(spark, "dictionary")
    lines.write.text(path)
    return stores.dictionary_text(spark, path).select("trad", "simp", "pinyin", "senses_raw")


@query(f"WITH {DICT} SELECT entry_id, trad, simp FROM dict_raw WHERE trad = '長' OR simp = '长' OR trad = '长' OR simp = '長'")
def dict_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup of one word, bound as a parameter, over either form; the forms are a key, so nothing is compared row by row."""
    dic.forms(fixtures.dictionary(spark)).createOrReplaceTempView("lexora_forms")
    return spark.sql("SELECT entry_id, trad, simp FROM lexora_forms WHERE word = :w", args={"w": "长"})


# ---- parsing


@query(f"""WITH {DICT}, l AS (SELECT entry_id, string_split(pinyin, ' ') AS x FROM dict_raw WHERE {COMPLETE}), s AS (SELECT entry_id, unnest(range(0, len(x))) AS syllable_no, unnest(x) AS syllable FROM l)
SELECT entry_id, syllable_no, syllable, {accented_sql("syllable")} AS accented FROM s""")
def pinyin_accent(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = dic.complete(fixtures.dictionary(spark)).select("entry_id", F.posexplode(F.split("pinyin", " ")).alias("syllable_no", "syllable"))
    return longs(each.withColumn("accented", fn.accented(F.col("syllable"))), "syllable_no")


_ALPHA = "substr('bcdfghjklmnpqrstvwxyzaeiou', 1 + {0} % 26, 1) || substr('aeiouaveiu', 1 + {0} // 26 % 10, 1) || substr(' uinagroe', 1 + {0} // 7 % 9, 1) || CAST(1 + {0} % 6 AS VARCHAR)"


@query(f"WITH s AS (SELECT event_id, {_ALPHA.format('event_id')} AS syllable FROM events) SELECT event_id, syllable, {accented_sql('syllable')} AS accented FROM s")
def pinyin_accent_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on syllables made from ids, most of which no language has."""
    pick = lambda letters, at: F.substring(F.lit(letters), (at + 1).cast("int"), F.lit(1))
    i = F.col("event_id")
    made = F.concat(pick("bcdfghjklmnpqrstvwxyzaeiou", i % 26), pick("aeiouaveiu", F.floor(i / 26) % 10), pick(" uinagroe", F.floor(i / 7) % 9), (i % 6 + 1).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", made.alias("syllable")).withColumn("accented", fn.accented(F.col("syllable")))


@query(f"WITH {DICT}, {SENSES} SELECT entry_id, sense_no, array_to_string(glosses, '; ') AS glosses, len(glosses) AS n_glosses FROM s")
def sense_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_senses(spark).select("entry_id", "sense_no", F.array_join("glosses", "; ").alias("glosses"), F.size("glosses").alias("n_glosses")), "sense_no", "n_glosses")


@query(f"WITH {DICT}, {SENSES} SELECT entry_id, sense_no, is_classifier FROM s")
def classifier_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_senses(spark).select("entry_id", "sense_no", "is_classifier"), "sense_no")


_REF = rf"{HEAD_DUCK}+(?:\|{HEAD_DUCK}+)?\[[A-Za-z0-9 ]+\]|\[[A-Za-z0-9 ]+\]"
_READ = "array_to_string(list_transform(string_split(regexp_extract(m, '\\[([A-Za-z0-9 ]+)\\]', 1), ' '), lambda x: " + accented_sql("x") + "), ' ')"
FRAGMENTS = f"""
g AS (SELECT entry_id, sense_no, unnest(range(0, len(glosses))) AS gloss_no, unnest(glosses) AS gloss FROM s),
p AS (SELECT *, regexp_extract_all(gloss, '{_REF}') AS ms, regexp_split_to_array(gloss, '{_REF}') AS gaps FROM g),
x AS (SELECT entry_id, sense_no, gloss_no, gloss, len(ms) AS n, unnest(range(0, len(gaps))) AS k, unnest(gaps) AS gap, unnest(list_concat(ms, [''])) AS m FROM p),
h AS (SELECT *, regexp_extract(m, '^({HEAD_DUCK}+)', 1) AS trad, regexp_extract(m, '\\|({HEAD_DUCK}+)', 1) AS simp0 FROM x),
parts AS (
  SELECT entry_id, sense_no, gloss_no, 3 * k AS pos, 'text' AS kind, {trimmed_sql("gap")} AS text, NULL AS trad, NULL AS simp FROM h WHERE {trimmed_sql("gap")} <> ''
  UNION ALL SELECT entry_id, sense_no, gloss_no, 3 * k + 1, 'link', trad || CASE WHEN simp0 IN ('', trad) THEN '' ELSE '/' || simp0 END, trad, CASE WHEN simp0 = '' THEN trad ELSE simp0 END FROM h WHERE trad <> ''
  UNION ALL SELECT entry_id, sense_no, gloss_no, 3 * k + 2, 'pinyin', {_READ}, NULL, NULL FROM h WHERE m <> ''),
fr AS (SELECT entry_id, sense_no, gloss_no, row_number() OVER (PARTITION BY entry_id, sense_no, gloss_no ORDER BY pos) - 1 AS frag_no, kind, text, trad, simp FROM parts)"""


def _fragments(spark: SparkSession) -> DataFrame:
    glosses = _senses(spark).select("entry_id", "sense_no", F.posexplode("glosses").alias("gloss_no", "gloss"))
    return glosses.select("entry_id", "sense_no", "gloss_no", F.posexplode(fn.fragments(F.col("gloss"))).alias("frag_no", "f")).select("entry_id", "sense_no", "gloss_no", "frag_no", "f.*")


@query(f"WITH {DICT}, {SENSES}, {FRAGMENTS} SELECT * FROM fr")
def gloss_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_fragments(spark), "sense_no", "gloss_no", "frag_no")


@query(f"""WITH {DICT}, {SENSES}, n AS (SELECT *, sum(CAST(NOT is_classifier AS INT)) OVER (PARTITION BY entry_id ORDER BY sense_no ROWS UNBOUNDED PRECEDING) AS num, count(*) OVER (PARTITION BY entry_id) AS total FROM s)
SELECT entry_id, sense_no, CASE WHEN NOT is_classifier THEN CAST(num AS VARCHAR) || '.' WHEN sense_no = total - 1 THEN 'CL:' ELSE '' END AS marker, is_classifier AND sense_no < total - 1 AS attached FROM n""")
def sense_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senses are numbered without classifiers; the last one's marker is "CL:", others have none and hang on the sense before."""
    w = W.partitionBy("entry_id")
    number = F.sum((~F.col("is_classifier")).cast("int")).over(w.orderBy("sense_no").rowsBetween(W.unboundedPreceding, 0))
    last = F.col("sense_no") == F.count("*").over(w) - 1
    marker = F.when(~F.col("is_classifier"), F.concat(number.cast("string"), F.lit("."))).when(last, F.lit("CL:")).otherwise(F.lit(""))
    return longs(_senses(spark).select("entry_id", "sense_no", marker.alias("marker"), (F.col("is_classifier") & ~last).alias("attached")), "sense_no")


@query(f"WITH {DICT} SELECT entry_id, CASE WHEN trad = simp THEN simp ELSE simp || '[' || trad || ']' END AS label FROM dict_raw WHERE {COMPLETE}")
def headword_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.complete(fixtures.dictionary(spark)).select("entry_id", fn.headword(F.col("trad"), F.col("simp")).alias("label"))


@query(f"""WITH {DICT}, {FORMS}, l AS (SELECT word, list(entry_id ORDER BY entry_id) AS ids FROM f GROUP BY word), i AS (SELECT unnest(range(-1, 3)) AS idx)
SELECT word, idx, CASE WHEN idx >= 0 THEN ids[idx + 1] END AS entry_id, CASE WHEN idx BETWEEN 0 AND len(ids) - 1 THEN (idx + 1) || ' / ' || len(ids) END AS label FROM l, i""")
def entry_pager(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry at an index, null outside the list, and the pager's label."""
    found = dic.lookup(dic.headwords(fixtures.dictionary(spark)), fixtures.dictionary(spark))
    each = found.select("word", "entries", F.explode(F.sequence(F.lit(-1), F.lit(2))).alias("idx"))
    entry = F.when(F.col("idx") >= 0, F.get("entries", F.col("idx")))
    label = F.when(entry.isNotNull(), F.concat((F.col("idx") + 1).cast("string"), F.lit(" / "), F.size("entries").cast("string")))
    return longs(each.select("word", "idx", entry["entry_id"].alias("entry_id"), label.alias("label")), "idx")


@query(f"""WITH {DICT}, {FORMS}, {SENSES}, {FRAGMENTS}
SELECT fr.entry_id, fr.simp AS target, f.entry_id AS target_entry FROM (SELECT DISTINCT entry_id, simp FROM fr WHERE kind = 'link') fr LEFT JOIN f ON f.word = fr.simp""")
def link_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every gloss, followed into the same dictionary; targets it lacks are null."""
    links = _fragments(spark).where("kind = 'link'").select("entry_id", F.col("simp").alias("target")).distinct()
    to = dic.forms(fixtures.dictionary(spark)).select(F.col("word").alias("_word"), F.col("entry_id").alias("target_entry"))
    return links.join(to, F.col("target") == F.col("_word"), "left").select("entry_id", "target", "target_entry")


# ---- sharing


def encoded_sql(x: str) -> str:
    out = f"replace(url_encode({x}), '+', '%20')"
    for c in QUERY_KEPT:
        quote = c.replace("'", "''")
        out = f"replace({out}, '%{ord(c):02X}', '{quote}')"
    return out


@query(f"""WITH {DICT}, u AS (SELECT entry_id, 'lexora://entry?s=' || {encoded_sql("simp")} || '&t=' || {encoded_sql("trad")} AS url, trad, simp FROM dict_raw WHERE {COMPLETE})
SELECT entry_id, url, trad, simp FROM u""")
def link_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of entries, and what is read back from them."""
    urls = dic.complete(fixtures.dictionary(spark)).select("entry_id", share.link_url(F.col("trad"), F.col("simp")).alias("url"))
    return urls.withColumn("_l", share.linked(F.col("url"))).select("entry_id", "url", "_l.trad", "_l.simp")


@query(f"SELECT doc_id, {encoded_sql('text')} AS encoded, replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '`', chr(92) || '`'), '$', chr(92) || '$'), chr(13), '') AS quoted FROM documents")
def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's whole text, percent-encoded and as a template literal."""
    return table(spark, sf_dir, "documents").select("doc_id", percent_encoded(F.col("text")).alias("encoded"), quoted(F.col("text")).alias("quoted"))


_TEMPLATES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in share.TEMPLATES)
PROMPTS = f"""
tpl AS (SELECT * FROM (VALUES {_TEMPLATES}) AS t(style, scope, template)),
src AS (SELECT conv_id, turn, CASE conv_id % 2 WHEN 0 THEN 'quick' ELSE 'full' END AS style, CASE turn % 3 WHEN 0 THEN 'word' WHEN 1 THEN 'sentence' ELSE 'paragraph' END AS scope, text, CASE WHEN turn % 2 = 0 THEN role END AS context FROM conversations),
pr AS (SELECT conv_id, turn, style, scope, text, context, replace(replace(template, '{{text}}', text), '{{context}}', CASE WHEN coalesce(context, '') = '' THEN text ELSE context END) AS prompt FROM src JOIN tpl USING (style, scope))"""


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.when(F.col("turn") % 3 == 0, "word").when(F.col("turn") % 3 == 1, "sentence").otherwise("paragraph")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, "quick").otherwise("full").alias("style"), scope.alias("scope"), "text", F.when(F.col("turn") % 2 == 0, F.col("role")).alias("context"))
    return share.prompts(rows, share.templates(spark))


@query(f"WITH {PROMPTS} SELECT conv_id, turn, style, scope, prompt FROM pr")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("conv_id", "turn", "style", "scope", "prompt")


@query(f"""WITH {PROMPTS}, t AS (SELECT *, nullif({trimmed_sql("text")}, '') AS tt, {trimmed_sql("prompt")} AS tp FROM pr)
SELECT conv_id, turn, 'dictionary' AS target, tt AS payload, '{share.DICTIONARY_URL}' || {encoded_sql("tt")} AS url FROM t
UNION ALL SELECT conv_id, turn, 'clipboard', tt, NULL FROM t
UNION ALL SELECT conv_id, turn, 'chat', tp, '{share.CHAT_URL}' || {encoded_sql("tp")} FROM t""")
def share_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = share.shared(F.col("text"), F.col("prompt"))
    each = F.array(*[F.struct(F.lit(k).alias("target"), p.alias("payload"), u.alias("url")) for k, (p, u) in to.items()])
    return _prompts(spark, sf_dir).select("conv_id", "turn", F.inline(each))
