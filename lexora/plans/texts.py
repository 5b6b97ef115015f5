"""Queries on sentences, runs, segmentation and HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora import fixtures
from lexora.constants import BLANK, BLOCK, ENDS, HAN, MAX_WORD, SENTENCE, UNSEEN
from lexora.functions.text import is_script
from lexora.functions.text import runs as runs_of
from lexora.operators import dictionary as dic
from lexora.operators import extract, segment
from lexora.plans.registry import longs, query, table
from lexora.shared import cut

# ---- SQL parts

LATIN_SQL = """
tok AS (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS run FROM documents),
freq AS (SELECT run, count(*) AS n FROM tok GROUP BY run),
words AS (SELECT run AS word FROM freq WHERE length(run) <= 6 AND n >= 20),
runs AS (SELECT run FROM freq)"""

HAN_RUNS_SQL = f"""
{fixtures.dictionary_sql()}, {fixtures.han_sql()},
words AS (SELECT DISTINCT unnest([trad, simp]) AS word FROM dict_raw),
runs AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[{HAN}]+')) AS run FROM han)"""

EDGES_SQL = f"""
e0 AS (SELECT run, unnest(range(0, length(run))) AS i FROM runs),
e1 AS (SELECT run, i, unnest(range(i + 1, least(length(run), i + {MAX_WORD}) + 1)) AS j FROM e0),
e AS (SELECT run, i, j, substr(run, i + 1, j - i) AS piece,
             CASE WHEN j - i > 1 THEN 3 * (j - i) WHEN w.word IS NULL THEN -4 ELSE -1 END AS score2
      FROM e1 LEFT JOIN words w ON w.word = substr(run, i + 1, j - i) WHERE j - i = 1 OR w.word IS NOT NULL)"""

SEGMENT_SQL = f"""{EDGES_SQL},
es AS (SELECT run, list({{'i': i, 'j': j, 's': score2}}) AS l FROM e GROUP BY run),
dp AS (
  SELECT run, l, 0::BIGINT AS j, [0::BIGINT] AS best, [0::BIGINT] AS back FROM es
  UNION ALL
  SELECT run, l, j + 1, list_append(best, -c.ns), list_append(back, c.i)
  FROM (SELECT *, list_sort(list_transform(list_filter(l, lambda x: x.j = j + 1), lambda x: {{'ns': -(best[x.i + 1] + x.s), 'i': x.i}}))[1] AS c FROM dp WHERE j < length(run))),
bt AS (
  SELECT run, back, best, length(run)::BIGINT AS pos, []::VARCHAR[] AS tokens FROM dp WHERE j = length(run)
  UNION ALL
  SELECT run, back, best, back[pos + 1], list_prepend(substr(run, back[pos + 1] + 1, pos - back[pos + 1]), tokens) FROM bt WHERE pos > 0),
seg AS (SELECT run, tokens, best[length(run) + 1] AS score2 FROM bt WHERE pos = 0)"""


def _latin(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All runs of all documents, and the frequent ones that a dictionary word can be as long as; their numbers are written, as both are read from them."""
    freq = cut(_frequencies(table(spark, sf_dir, "documents")), "runs")
    return freq.select("run"), freq.where("length(run) <= 6 AND n >= 20").select(F.col("run").alias("word"))


def _frequencies(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(runs_of(F.col("text"), "latin")).alias("run")).groupBy("run").agg(F.count("*").alias("n"))


def han_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.han_documents(table(spark, sf_dir, "documents"))


def _han(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    runs = han_docs(spark, sf_dir).select(F.explode(runs_of(F.col("text"))).alias("run"))
    return runs, dic.headwords(fixtures.dictionary(spark))


def _segmented(df: DataFrame) -> DataFrame:
    return longs(df.select("run", F.array_join("tokens", "·").alias("segmented"), "score2"), "score2")


# ---- segmentation


@query(f"WITH RECURSIVE {LATIN_SQL}, {SEGMENT_SQL} SELECT run, array_to_string(tokens, '·') AS segmented, score2 FROM seg")
def segment_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(segment.segment(*_latin(spark, sf_dir)))


@query(f"WITH RECURSIVE {HAN_RUNS_SQL}, {SEGMENT_SQL} SELECT run, array_to_string(tokens, '·') AS segmented, score2 FROM seg")
def segment_han(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(segment.segment(*_han(spark, sf_dir)))


@query(f"WITH {LATIN_SQL}, {EDGES_SQL} SELECT run, i, j, piece, CAST(score2 AS BIGINT) AS score2 FROM e")
def segment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(segment.edges(*_latin(spark, sf_dir)), "i", "j", "score2")


_OFFSETS = """
w AS (SELECT run, unnest(range(0, len(tokens))) AS word_no, unnest(tokens) AS word FROM seg)
SELECT run, word_no, word, CAST(sum(length(word)) OVER p - length(word) AS BIGINT) AS "start", CAST(sum(length(word)) OVER p AS BIGINT) AS "end"
FROM w WINDOW p AS (PARTITION BY run ORDER BY word_no ROWS UNBOUNDED PRECEDING)"""


@query(f"WITH RECURSIVE {LATIN_SQL}, {SEGMENT_SQL},{_OFFSETS}")
def word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(segment.word_spans(segment.segment(*_latin(spark, sf_dir)), ["run"]), "word_no", "start", "end")


@query(f"WITH RECURSIVE {LATIN_SQL}, {SEGMENT_SQL}, w AS (SELECT unnest(tokens) AS word FROM seg) SELECT word, count(*) AS n FROM w GROUP BY word")
def word_frequency_of_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = segment.segment(*_latin(spark, sf_dir)).select(F.explode("tokens").alias("word"))
    return tokens.groupBy("word").agg(F.count("*").alias("n"))


@query(f"""WITH {LATIN_SQL}, n AS (SELECT run, length(run) AS n FROM runs)
SELECT run, CASE WHEN n < 3 THEN '' ELSE left(run, 3) END || CASE WHEN n < 5 THEN '' ELSE '|' || substr(run, 4, 2) END || CASE WHEN n < 104 THEN '' ELSE '|' || substr(run, 6, 99) END || CASE WHEN n < 105 THEN '' ELSE '|' || substr(run, 105, 1) END AS words,
       substr(run, CASE WHEN n < 3 THEN 1 WHEN n < 5 THEN 4 WHEN n < 104 THEN 6 WHEN n < 105 THEN 105 ELSE 106 END) AS rest FROM n""")
def word_wrapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, _ = _latin(spark, sf_dir)
    return _wrapped(runs)


def _wrapped(runs: DataFrame) -> DataFrame:
    wrapped = segment.wrapped(F.col("run"), F.array(*map(F.lit, (3, 0, 2, 99, 1))))
    return runs.select("run", F.inline(F.array(wrapped))).select("run", F.array_join("words", "|").alias("words"), "rest")


# ---- sentences and runs


def _list_sql(cte: str, source: str, key: str, pattern: str, no: str, name: str, text: str = "text") -> str:
    return f"{cte} l AS (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS x FROM {source}) SELECT {key}, unnest(range(0, len(x))) AS {no}, unnest(x) AS {name} FROM l"


@query(_list_sql("WITH", "documents", "doc_id", SENTENCE, "sent_no", "sentence"))
def sentences_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(extract.sentence_rows(table(spark, sf_dir, "documents"), ["doc_id"]), "sent_no")


@query(_list_sql(f"WITH {fixtures.han_sql()},", "han", "doc_id", SENTENCE, "sent_no", "sentence"))
def sentences_han(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(extract.sentence_rows(han_docs(spark, sf_dir), ["doc_id"]), "sent_no")


@query(_list_sql("WITH", "conversations", "conv_id, turn", SENTENCE, "sent_no", "sentence"))
def sentences_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(extract.sentence_rows(table(spark, sf_dir, "conversations"), ["conv_id", "turn"]), "sent_no")


_S = "s AS (SELECT doc_id, unnest(range(0, len(x))) AS sent_no, unnest(x) AS sentence FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS x FROM {t}))"


@query(_list_sql(f"WITH {fixtures.han_sql()}, {_S.format(p=SENTENCE, t='han')},", "s", "doc_id, sent_no", f"[{HAN}]+", "run_no", "run", "sentence"))
def han_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.run_rows(extract.sentence_rows(han_docs(spark, sf_dir), ["doc_id"]), ["doc_id", "sent_no"])
    return longs(rows, "sent_no", "run_no")


@query(_list_sql(f"WITH {_S.format(p=SENTENCE, t='documents')},", "s", "doc_id, sent_no", "[a-z]+", "run_no", "run", "sentence"))
def latin_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.run_rows(extract.sentence_rows(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id", "sent_no"], "latin")
    return longs(rows, "sent_no", "run_no")


@query(f"""WITH {fixtures.han_sql()}, c AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM han)
SELECT c AS ch, CAST(unicode(c) AS BIGINT) AS code, regexp_matches(c, '^[{HAN}]$') AS is_han, regexp_matches(c, '^[{BLANK}]$') AS is_blank, regexp_matches(c, '^[。！？!?]$') AS is_end FROM c WHERE c <> ''""")
def character_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different character of the Han texts: code point, Han, white space, end of a sentence."""
    c = han_docs(spark, sf_dir).select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").distinct()
    return longs(c.select("ch", F.ascii("ch").alias("code"), is_script(F.col("ch")).alias("is_han"), F.col("ch").rlike(f"^[{BLANK}]$").alias("is_blank"), F.col("ch").rlike(f"^[{ENDS}]$").alias("is_end")), "code")


# ---- HTML


def _decoded_sql(x: str) -> str:
    for a, b in extract.REFERENCES:
        x = f"replace({x}, '{a}', '{b}')"
    return x


_B = f"b AS (SELECT page_id, unnest(range(0, len(x))) AS block_no, unnest(x) AS block FROM (SELECT page_id, regexp_split_to_array(regexp_replace(html, '{UNSEEN}', '', 'g'), '{BLOCK}') AS x FROM pages))"


@query(f"""WITH {_B}, n AS (SELECT page_id, block_no, unnest(range(0, len(x))) AS node_no, unnest(x) AS node FROM (SELECT page_id, block_no, regexp_split_to_array(block, '<[^>]*>') AS x FROM b))
SELECT page_id, block_no, node_no, {_decoded_sql("node")} AS text FROM n WHERE regexp_matches({_decoded_sql("node")}, '[^{BLANK}]')""")
def page_text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(extract.text_nodes(table(spark, sf_dir, "pages")), "block_no", "node_no")


_T = f"regexp_replace(regexp_replace({_decoded_sql("regexp_replace(block, '<[^>]*>', '', 'g')")}, '[{BLANK}]+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"WITH {_B} SELECT page_id, block_no, {_T} AS text FROM b WHERE {_T} <> ''")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(extract.blocks(table(spark, sf_dir, "pages")), "block_no")


@query(f"WITH {_B} SELECT page_id, block_no, {_T} AS text FROM b WHERE {_T} <> ''")
def page_blocks_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages that came in twice: each is processed once."""
    pages = table(spark, sf_dir, "pages")
    return longs(extract.once(extract.blocks(pages.unionByName(pages)), ["page_id", "block_no"]), "block_no")


# ---- places

_PLACED = """
{name}p AS (SELECT doc_id, unnest(range(0, len(x))) AS no, unnest(x) AS part FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS x FROM han)),
{name}o AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS stop FROM {name}p),
{name} AS (SELECT doc_id, part, CAST(stop - length(part) AS BIGINT) AS begin, CAST(stop AS BIGINT) AS stop FROM {name}o WHERE regexp_matches(part, '{keep}'))"""
_RUNS_AT = _PLACED.format(name="r", pattern=f"[{HAN}]+|[^{HAN}]+", keep=f"^[{HAN}]")
_SENTENCES_AT = _PLACED.format(name="st", pattern=f"{SENTENCE}|[{BLANK}]+", keep=f"^[^{BLANK}]")
_WORDS_AT = """
t0 AS (SELECT run, unnest(range(0, len(tokens))) AS word_no, unnest(tokens) AS word FROM seg),
t AS (SELECT *, CAST(sum(length(word)) OVER (PARTITION BY run ORDER BY word_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM t0)"""


def _placed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, run, run_start, word_no, word, start, end (places in the text) of all words of the Han texts."""
    runs, words = _han(spark, sf_dir)
    spans = segment.word_spans(segment.segment(runs, words), ["run"])
    at = extract.placed_runs(han_docs(spark, sf_dir), ["doc_id"]).select("doc_id", F.col("run").alias("_run"), F.col("start").alias("run_start"))
    found = at.join(spans, F.col("_run") == F.col("run"))
    return found.select("doc_id", "run", "run_start", "word_no", "word", (F.col("run_start") + F.col("start")).alias("start"), (F.col("run_start") + F.col("end")).alias("end"))


@query(f"""WITH RECURSIVE {HAN_RUNS_SQL}, {SEGMENT_SQL}, {_RUNS_AT}, {_WORDS_AT}
SELECT h.doc_id, h.doc_id % 30 AS off, r.part AS run, t.word, r.begin + t.stop - length(t.word) AS "start", r.begin + t.stop AS "end"
FROM documents h JOIN r ON r.doc_id = h.doc_id AND h.doc_id % 30 >= r.begin AND h.doc_id % 30 < r.stop
JOIN t ON t.run = r.part AND h.doc_id % 30 >= r.begin + t.stop - length(t.word) AND h.doc_id % 30 < r.begin + t.stop""")
def word_at_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word at a place of each text: an equality join on the document, then containment."""
    hits = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_doc"), (F.col("doc_id") % 30).alias("off"))
    words = _placed_words(spark, sf_dir)
    found = hits.join(words, (F.col("_doc") == F.col("doc_id")) & (F.col("off") >= F.col("start")) & (F.col("off") < F.col("end")))
    return longs(found.select("doc_id", "off", "run", "word", "start", "end"), "off", "start", "end")


@query(f"""WITH {fixtures.han_sql()}, {_RUNS_AT}, {_SENTENCES_AT}, hit AS (SELECT doc_id, text, doc_id % 30 AS off FROM han)
SELECT hit.doc_id, off, text AS block, coalesce(st.part, text) AS sentence, r.part AS run
FROM hit LEFT JOIN st ON st.doc_id = hit.doc_id AND off >= st.begin AND off < st.stop
LEFT JOIN r ON r.doc_id = hit.doc_id AND off >= r.begin AND off < r.stop""")
def context_at_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block, sentence (else the block) and run (else null) at a place of each text."""
    hits = han_docs(spark, sf_dir).select("doc_id", F.col("text").alias("block"), (F.col("doc_id") % 30).alias("off"))
    s = extract.placed_sentences(han_docs(spark, sf_dir), ["doc_id"]).toDF("_d1", "_sentence", "_s1", "_e1")
    r = extract.placed_runs(han_docs(spark, sf_dir), ["doc_id"]).toDF("_d2", "run", "_s2", "_e2")
    x = hits.join(s, (F.col("doc_id") == F.col("_d1")) & (F.col("off") >= F.col("_s1")) & (F.col("off") < F.col("_e1")), "left")
    x = x.join(r, (F.col("doc_id") == F.col("_d2")) & (F.col("off") >= F.col("_s2")) & (F.col("off") < F.col("_e2")), "left")
    return longs(x.select("doc_id", "off", "block", F.coalesce("_sentence", "block").alias("sentence"), "run"), "off")


@query(f"""WITH RECURSIVE {HAN_RUNS_SQL}, {SEGMENT_SQL}, {_RUNS_AT}, {_WORDS_AT},
f AS (SELECT DISTINCT entry_id, unnest([trad, simp]) AS word FROM dict_raw WHERE trad IS NOT NULL AND simp IS NOT NULL AND pinyin IS NOT NULL AND senses_raw IS NOT NULL)
SELECT r.doc_id, r.begin + t.stop - length(t.word) AS "start", t.word, count(f.entry_id) AS n_entries, coalesce(string_agg(CAST(f.entry_id AS VARCHAR), ',' ORDER BY f.entry_id), '') AS entries
FROM r JOIN t ON t.run = r.part LEFT JOIN f ON f.word = t.word GROUP BY r.doc_id, r.begin, t.stop, t.word, t.word_no""")
def annotate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus with its dictionary entries; entries are grouped by word before the join."""
    found = dic.lookup(dic.headwords(fixtures.dictionary(spark)), fixtures.dictionary(spark)).withColumnRenamed("word", "_word")
    ids = F.array_join(F.transform("entries", lambda e: e["entry_id"].cast("string")), ",")
    x = _placed_words(spark, sf_dir).join(found, F.col("word") == F.col("_word"), "left")
    return longs(x.select("doc_id", "start", "word", F.coalesce(F.size("entries"), F.lit(0)).alias("n_entries"), F.coalesce(ids, F.lit("")).alias("entries")), "start", "n_entries")
