"""Word segmentation of script runs by dynamic programming over dictionary words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.constants import KNOWN_SINGLE, MAX_WORD, PER_CHARACTER, UNKNOWN_SINGLE
from lexora.functions.arrays import CHUNK, once, starts
from lexora.shared import cut

#: A segmenter: from runs (column run) and words (column word) to run, tokens and twice the total score of each different run.
Segmenter = Callable[[DataFrame, DataFrame], DataFrame]


def numbered(runs: DataFrame) -> DataFrame:
    """id and run of each different run that isn't empty; written, so that ids stay."""
    return cut(runs.select("run").where("run <> ''").distinct().withColumn("id", F.monotonically_increasing_id()), "runs")


def stretches(runs: DataFrame, longest: int) -> DataFrame:
    """id, no, lead and text of the stretches of runs (id, run).

    A stretch is CHUNK characters of a run, preceded by as many (lead) as a word
    can reach back less one, so that its pieces are found in it alone.
    """
    own = runs.select("id", F.inline(F.array(F.struct(F.regexp_extract_all("run", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("_s")))))
    before = lambda no: F.when(no > 0, F.right(F.get(F.col("_s"), no - 1), F.lit(longest - 1))).otherwise("")
    led = F.transform("_s", lambda x, no: F.struct(F.length(before(no)).alias("lead"), F.concat(before(no), x).alias("text")))
    return own.select("id", F.posexplode(led).alias("no", "_x")).select("id", "no", "_x.lead", "_x.text")


def pieces(each: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """id, no, j (the place in the stretch after the piece), size and known of every usable piece of stretches.

    Single characters always are usable, longer pieces if words (column word)
    has them.  The different words are written first, so that Spark knows their
    size and broadcasts them below its own threshold, else joins by shuffle.
    """
    known = cut(words.select(F.col("word").alias("_word")).where(F.length("word") <= longest).distinct(), "words")
    ends = each.select("id", "no", "lead", "text", F.explode(F.sequence(F.col("lead") + 1, F.length("text"))).alias("_end"))
    sized = ends.select("id", "no", "lead", "text", "_end", F.explode(F.sequence(F.lit(1), F.least("_end", F.lit(longest)))).alias("size"))
    found = sized.select("id", "no", (F.col("_end") - F.col("lead")).alias("j"), "size", F.expr("substring(text, _end - size + 1, size)").alias("piece")).join(known, F.col("piece") == F.col("_word"), "left")
    return found.where("size = 1 OR _word IS NOT NULL").select("id", "no", "j", "size", "piece", F.col("_word").isNotNull().alias("known"))


def _score2(size: Column, known: Column) -> Column:
    return F.when(size > 1, size * PER_CHARACTER).when(known, KNOWN_SINGLE).otherwise(UNKNOWN_SINGLE)


def edges(runs: DataFrame, words: DataFrame, longest: int = MAX_WORD) -> DataFrame:
    """run, i, j, piece and twice the score of every usable piece of each different run."""
    each = numbered(runs)
    found = pieces(stretches(each, longest), words, longest)
    j = F.col("no") * CHUNK + F.col("j")
    found = found.select("id", (j - F.col("size")).alias("i"), j.alias("j"), "piece", _score2(F.col("size"), F.col("known")).alias("score2"))
    return found.join(each.select(F.col("id").alias("_id"), "run"), F.col("id") == F.col("_id")).select("run", "i", "j", "piece", "score2")


def _folded(parts: Column, longest: int) -> Column:
    """score2 and, for each stretch, the sizes of the best last words before its places.

    parts: the stretches' codes in order.  The state has the best scores of the
    last places only; of equally good last words the longest counts.  First each
    stretch is passed for the scores that the next begins with, then each by
    itself for its words.
    """

    def step(a: Column, code: Column, seen: Column, grown: Callable[[Column, Column], Column]) -> Column:
        """a with the piece of a code: best, and what grown(size, whether at a new place) makes."""
        known, rest = code % 2 == 1, F.floor(code / 2).cast("int")
        j, size = F.floor(rest / (longest + 1)).cast("int"), longest - rest % (longest + 1)
        new = j > seen
        score = F.get(a["best"], F.when(new, size - 1).otherwise(size)) + _score2(size, known)
        put = lambda best: F.slice(F.array_prepend(best, score), F.lit(1), F.lit(longest + 1)).alias("best")
        better = F.struct(put(F.slice(a["best"], F.lit(2), F.lit(longest))), grown(size, F.lit(False)))
        return F.when(new, F.struct(put(a["best"]), grown(size, F.lit(True)))).when(score > F.get(a["best"], F.lit(0)), better).otherwise(a)

    def passed(best: Column, codes: Column) -> Column:
        count = lambda a: lambda _, new: (a["at"] + new.cast("int")).alias("at")
        return F.aggregate(codes, F.struct(best.alias("best"), F.lit(0).alias("at")), lambda a, c: step(a, c, a["at"], count(a)), lambda a: a["best"])

    def backs(best: Column, codes: Column) -> Column:
        kept = lambda a: lambda size, new: F.array_append(F.when(new, a["back"]).otherwise(F.slice(a["back"], F.lit(1), F.size(a["back"]) - 1)), size).alias("back")
        start = F.struct(best.alias("best"), F.array().cast("array<int>").alias("back"))
        return F.aggregate(codes, start, lambda a, c: step(a, c, F.size(a["back"]), kept(a)), lambda a: a["back"])

    start = F.struct(F.array(F.lit(0)).alias("best"), F.array().cast("array<array<int>>").alias("begins"))
    walked = F.aggregate(parts, start, lambda a, part: F.struct(passed(a["best"], part["codes"]).alias("best"), F.array_append(a["begins"], a["best"]).alias("begins")))
    like = F.struct(F.lit(0).alias("score2"), F.array().cast("array<array<int>>").alias("backs"))
    return once(walked, like, lambda w: F.struct(F.get(w["best"], F.lit(0)).alias("score2"), F.zip_with(parts, w["begins"], lambda part, best: backs(best, part["codes"])).alias("backs")))


def _tokens(parts: Column, backs: Column) -> Column:
    """The words, from the last place back.

    A word that begins before its stretch leaves the place to go on from in the
    one before: first these places are found, then each stretch's words.
    """

    def passed(back: Column, at: Column) -> Column:
        return F.aggregate(back, F.size(back) + at, lambda p, _: F.when(p > 0, p - F.get(back, p - 1)).otherwise(p))

    def words(x: Column, at: Column) -> Column:
        back, part = x["back"], x["part"]

        def step(a: Column, _: Column) -> Column:
            size = F.get(back, a["at"] - 1)
            token = F.substring(part["text"], part["lead"] + a["at"] - size + 1, size)
            return F.when(a["at"] > 0, F.struct((a["at"] - size).alias("at"), F.array_prepend(a["tokens"], token).alias("tokens"))).otherwise(a)

        return F.aggregate(back, F.struct((F.size(back) + at).alias("at"), F.array().cast("array<string>").alias("tokens")), step, lambda a: a["tokens"])

    both = F.reverse(F.zip_with(parts, backs, lambda part, back: F.struct(part.alias("part"), back.alias("back"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("over"))
    over = F.aggregate(F.reverse(backs), start, lambda a, back: F.struct(passed(back, a["at"]).alias("at"), F.array_append(a["over"], a["at"]).alias("over")), lambda a: a["over"])
    return F.flatten(F.reverse(F.zip_with(both, over, words)))


def segment(runs: DataFrame, words: DataFrame, longest: int = MAX_WORD) -> DataFrame:
    """run, tokens and twice the total score of each different run that isn't empty.

    Usable pieces come back to their stretch as one number each; a run's
    stretches are folded in one row, in steps that grow with its length alone.
    """
    led = stretches(numbered(runs), longest)
    code = (F.col("j") * (longest + 1) + longest - F.col("size")) * 2 + F.col("known").cast("int")
    codes = pieces(led, words, longest).groupBy("id", "no").agg(F.array_sort(F.collect_list(code)).alias("codes"))
    whole = led.join(codes, ["id", "no"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("no", "lead", "text", "codes"))).alias("_parts"))
    solved = whole.select("_parts", F.inline(F.array(F.struct(_folded(F.col("_parts"), longest).alias("_best")))))
    solved = solved.select("_best.score2", F.inline(F.array(F.struct(_tokens(F.col("_parts"), F.col("_best.backs")).alias("tokens")))))
    return solved.select(F.array_join("tokens", "").alias("run"), "tokens", "score2")


def word_spans(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each token of rows with keys, run and tokens: word_no, word, first and end place in the run."""
    at = starts(F.transform("tokens", lambda t: F.length(t)))
    each = tokens.select(*dict.fromkeys([*keys, "run"]), F.posexplode(F.arrays_zip(F.col("tokens").alias("word"), at.alias("start"))).alias("word_no", "_t"))
    return each.select(*dict.fromkeys([*keys, "run"]), "word_no", "_t.word", (F.col("_t.start") + F.length("_t.word")).alias("end"), "_t.start")


def wrapped(text: Column, lengths: Column) -> Column:
    """text cut by lengths: those not above 0 are skipped, a length beyond the end stops, what is left is one more part (word null)."""
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("words"))

    def step(a: Column, n: Column) -> Column:
        past = a["over"] | (a["at"] + n > F.length(text))
        word = F.substring(text, a["at"] + 1, n)
        return F.when(n <= 0, a).when(past, F.struct(a["at"].alias("at"), F.lit(True).alias("over"), a["words"].alias("words"))).otherwise(F.struct((a["at"] + n).alias("at"), F.lit(False).alias("over"), F.array_append(a["words"], word).alias("words")))

    return F.aggregate(lengths, start, step, lambda a: F.struct(a["words"].alias("words"), F.substring(text, a["at"] + 1, F.length(text)).alias("rest")))
