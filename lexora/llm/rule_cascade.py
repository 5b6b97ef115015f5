"""Quality rules as a short-circuit cascade, in Spark SQL functions only.

Each rule is a rejecting condition.  On a random sample the time each rule takes
and the rows it rejects are measured; rules then run in the order of rejections
per second among the rows that the rules before leave, and a document that one
rejects is not tested by the rest.  The order changes the time taken, never the
verdict.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.llm.common import SPACE, SPACES, cut, words_of

#: Rows on which rules are measured, as expected, how often each is tested when it is timed, and the seed of the sample.
SAMPLE, TIMES, SEED = 1000, 2, 5
#: Words of the windows whose repeats count.
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """rejects: a condition over text and measures; windows: whether it reads n_repeat_words, the costly one."""

    name: str
    rejects: Column
    windows: bool = False


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, however often later expressions (lambdas too) read them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _apart(df: DataFrame, name: str) -> str:
    """A column name like `name` that df lacks, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


@dataclass(frozen=True)
class Parts:
    """Names of the columns that hold a text's lines with words and its words' hashes."""

    lines: str
    hashes: str


def counted(docs: DataFrame) -> tuple[DataFrame, Parts]:
    """docs with the parts of each text and all measures but n_repeat_words; n_symbols and n_dup_lines are computed where they are read."""
    text, words = F.coalesce(F.col("text"), F.lit("")), _apart(docs, "_words")
    parts = Parts(_apart(docs, "_lines"), _apart(docs, "_hashes"))
    x = bind(docs, **{words: words_of(F.col("text")), parts.lines: F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")})
    x = bind(x, **{parts.hashes: F.transform(words, lambda w: F.xxhash64(w)), "n_words": F.size(words).cast("long"), "word_chars": F.length(F.array_join(words, "")).cast("long")}).drop(words)
    return x.withColumns({
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(parts.lines) - F.size(F.array_distinct(parts.lines))).cast("long"),
    }), parts


def repeated(x: DataFrame, parts: Parts) -> DataFrame:
    """x with n_repeat_words, the words inside windows of 8 words that the text has twice or more, the first included.

    Windows are compared by a 64-bit hash.  Only documents with a repeated
    window pay for the sort that finds its places.
    """
    n, w, s = F.size(parts.hashes), _apart(x, "_windows"), _apart(x, "_places")

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get(F.col(parts.hashes), i + k) for k in range(WINDOW)])

    y = bind(x, **{w: F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(F.array().cast("array<bigint>"))})
    pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    y = bind(y, **{s: F.when(F.size(F.array_distinct(w)) < F.size(w), pairs)})
    again = lambda p, j: (p["h"] == F.get(F.col(s), j - 1)["h"]) | (p["h"] == F.get(F.col(s), j + 1)["h"])
    places = F.sort_array(F.transform(F.filter(s, again), lambda p: p["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])
    return y.select(*x.columns, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def measures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the column text; a null, empty or blank text has zeros."""
    x, parts = counted(docs)
    return repeated(x, parts).select(*docs.columns, *MEASURES)


def base_rules() -> list[Rule]:
    return [Rule("few_words", F.col("n_words") < 20), Rule("repeated_words", F.col("n_repeat_words") * 100 > F.col("n_words") * 30, windows=True)]


def base_failed() -> Column:
    few, repeated_words = base_rules()
    return few.rejects | repeated_words.rejects


def rules(parts: Parts) -> list[Rule]:
    """The production rules, over text, its parts and measures; none is null, whatever the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda unlike: F.length(F.regexp_replace(text, unlike, ""))
    lines = F.col(parts.lines)
    share = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern)))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > F.col("n_words")),
        Rule("word_length", (F.col("word_chars") * 2 < F.col("n_words") * 5) | (F.col("word_chars") > F.col("n_words") * 12)),
        Rule("duplicate_lines", F.col("n_dup_lines") * 2 > F.size(lines)),
        Rule("capitals", count(r"[^A-Z]+") > count(r"[^a-z]+")),
        Rule("exclamations", count(r"[^!]+") * 5 > F.col("n_words")),
        Rule("digits", count(r"[^0-9]+") * 2 > F.col("word_chars")),
        Rule("bullets", share(r"^[\x20\t]*[-*•]") * 10 > F.size(lines) * 9),
        Rule("ellipses", share(r"(\.\.\.|…)[\x20\t\r]*$") * 10 > F.size(lines) * 3),
    ]


def sampled(docs: DataFrame, rows: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """About `rows` random rows of docs, from all partitions and of any length, as text alone; they set the order of rules and nothing else."""
    total = docs.count()
    return docs.select("text").sample(min(1.0, rows / max(1, total)), seed)


def costs(x: DataFrame, parts: Parts, of: Sequence[Rule], times: int = TIMES) -> tuple[list[float], list[tuple[bool, ...]]]:
    """The seconds that each rule takes on the counted sample x, and for each of its rows which rules reject it.

    A rule is timed on the sample repeated `times` times; what a condition takes
    that only reads text and words is deducted.  A rule over windows is charged
    with making them.  The shortest of three runs counts; the first compiles the
    plan.
    """
    verdicts = repeated(x, parts).select(*[r.rejects.alias(f"r{i}") for i, r in enumerate(of)]).collect()  # of about SAMPLE rows
    many = cut(x.withColumn(_apart(x, "_time"), F.explode(F.sequence(F.lit(1), F.lit(times)))), "rule-times")  # written, so that rules aren't tested before the rows repeat
    read = (F.octet_length(F.coalesce("text", F.lit(""))) >= 0) & (F.size(parts.hashes) >= 0) & (F.size(parts.lines) >= 0)  # true; each job reads the same columns

    def seconds(r: Rule) -> float:
        tested = (repeated(many, parts) if r.windows else many).where(read & r.rejects)
        took = []
        for _ in range(3):
            began = time.perf_counter()
            tested.agg(F.count("*")).collect()  # another plan each time: one that has run keeps what its stages gave
            took.append(time.perf_counter() - began)
        return min(took)

    nothing = seconds(Rule("", F.lit(True)))
    return [max(seconds(r) - nothing, 1e-4) for r in of], [tuple(v) for v in verdicts]


def ordered(sample: DataFrame, base: Sequence[Rule] = ()) -> list[str]:
    """The names of base and production rules, each the one that rejects most per second of the sample's rows that those before leave; ties by cost, then name."""
    x, parts = counted(sample)
    of = [*base, *rules(parts)]
    seconds, rows = costs(cut(x, "rule-sample"), parts, of)
    return greedy([r.name for r in of], seconds, rows)


def greedy(names: Sequence[str], seconds: Sequence[float], rows: list[tuple[bool, ...]]) -> list[str]:
    out, left = [], list(range(len(names)))
    while left:
        rejected = {i: sum(v[i] for v in rows) for i in left}
        best = min(left, key=lambda i: (-rejected[i] / seconds[i], seconds[i], names[i]))
        out.append(names[best])
        left.remove(best)
        rows = [v for v in rows if not v[best]]
    return out


def cascade(of: Sequence[Rule]) -> Column:
    """True where no rule rejects; tests stop at the first that does."""
    out = F.lit(True)
    for r in reversed(of):
        out = F.when(r.rejects, F.lit(False)).otherwise(out)
    return out


def judge(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with measures, base_failed and kept (false if base_failed, else the cascade's verdict).

    One row for each row of docs, repeated or not; an empty table gives an
    empty result.  docs needs the column text; its other columns stay, and
    those named like a result are replaced.
    """
    plain = docs.drop(*MEASURES, "base_failed", "kept")
    order = ordered(sampled(plain, sample))
    x, parts = counted(plain)
    by = {r.name: r for r in rules(parts)}
    x = repeated(x, parts).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & cascade([by[n] for n in order]))
    return x.select(*plain.columns, *MEASURES, "base_failed", "kept")


def accepted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns, whatever their names.

    The base rules run in the cascade like any others: windows are made only of
    documents that no rule before has rejected.
    """
    own = [f"_own_{i}" for i in range(len(docs.columns))]
    x = docs.toDF(*own).withColumn("text", F.col(own[docs.columns.index("text")]))
    order = ordered(sampled(x, sample), base_rules())
    x, parts = counted(x)
    by = {r.name: r for r in [*base_rules(), *rules(parts)]}
    for r in map(by.__getitem__, order):
        x = (repeated(x, parts) if r.windows else x).where(~r.rejects)
    return x.select(*own).toDF(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
p AS (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
g AS (SELECT rid, i, array_to_string(w[i:i+7], ' ') AS win FROM p),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g),
k AS (SELECT rid, i, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS gap FROM c WHERE n > 1),
r AS (SELECT rid, sum(least(8, coalesce(gap, 8))) AS rep FROM k GROUP BY rid),
m AS (
  SELECT d.*, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r USING (rid)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND NOT (n_symbols * 10 > n_words)
       AND NOT (word_chars * 2 < n_words * 5 OR word_chars > n_words * 12)
       AND NOT (n_dup_lines * 2 > len(lines))
       AND NOT (length(regexp_replace(t, '[^A-Z]+', '', 'g')) > length(regexp_replace(t, '[^a-z]+', '', 'g')))
       AND NOT (length(regexp_replace(t, '[^!]+', '', 'g')) * 5 > n_words)
       AND NOT (length(regexp_replace(t, '[^0-9]+', '', 'g')) * 2 > word_chars)
       AND NOT (len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\t]*[-*•]'))) * 10 > len(lines) * 9)
       AND NOT (len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\t\r]*$'))) * 10 > len(lines) * 3) AS kept
FROM b"""
