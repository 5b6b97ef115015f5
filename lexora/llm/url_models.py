"""URL filter: rules by host and path, then a character language-model ratio; Spark SQL functions only.

Two variable-order Markov models over characters are counted on URLs that a
rule decides: one on blocked URLs, one on allowed ones.  The score of a URL is
the mean log-likelihood ratio of its characters; the blocking threshold is
calibrated on a fifth of the decided URLs, which the models don't learn from.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.llm.common import cut

#: Characters of the longest gram: contexts have up to one less.
ORDER = 5
#: Weight of the shorter context's estimate.
PRIOR = 4.0
#: One of so many decided URLs is held out of the models and calibrates the threshold.
HELD_OUT = 5
#: Parts that a gram's places are dealt to, however common it is.
SALTS = 32
#: Ratios are summed in steps of 1/STEP, so that a sum doesn't depend on the order.
STEP = 1 << 32


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Longest rule first where several fit.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if url is null or has no "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    after = F.when(rest.isNull(), F.lit("")).otherwise(F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def scored_text(url: Column) -> Column:
    """The whole URL, its host (that of parts) in lower case; empty if url is null."""
    host, _ = parts(url)
    found, at = F.instr(url, "://"), F.instr(url, "://") + 2  # the last character before the host
    lowered = F.concat(F.substring(url, F.lit(1), at), host, F.substring(url, at + F.length(host) + 1, F.length(url)))
    return F.coalesce(F.when(found > 0, lowered).otherwise(url), F.lit(""))


def ruled(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict, null if none fits (equally long: the first by name)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def grams(urls: DataFrame) -> DataFrame:
    """urls with a row for each character of the URL and its end: gram, the character after the four before it."""
    padded = F.concat(F.lit("\x02" * (ORDER - 1)), F.col("seen"), F.lit("\x03"))
    chars = urls.select("*", F.inline(F.array(F.struct(F.split(padded, "").alias("_c")))))
    each = F.transform(F.sequence(F.lit(0), F.size("_c") - ORDER), lambda i: F.concat(*[F.get(F.col("_c"), i + k) for k in range(ORDER)]))
    return chars.select("*", F.explode(each).alias("gram")).drop("_c")


def train(urls: DataFrame) -> DataFrame:
    """gram and ratio, log p(rejected) - log p(accepted) of its last character, of every gram of ORDER characters of the URLs (seen).

    Only URLs with bad set (true: rejected, false: accepted) add to the counts,
    but every gram of the table is kept, so all that is scored is found; a gram
    that no counted URL has gets what its shorter contexts say.  Estimates of an
    order are smoothed by those of the order below with PRIOR counts.  Tables
    are joined on distinct grams, of which as many share a context or an end as
    there are characters.
    """
    counted = grams(urls.where("seen <> ''").select("seen", "bad")).groupBy("gram").agg(F.count(F.when(F.col("bad"), 1)).alias("r"), F.count(F.when(~F.col("bad"), 1)).alias("a"))
    counted = cut(counted, "url-grams")
    r, a = counted.agg(F.coalesce(F.sum("r"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))).collect()[0]
    lower = None
    for k in range(1, ORDER + 1):
        here = counted.groupBy(F.substring("gram", -k, k).alias("gram")).agg(F.sum("r").alias("r"), F.sum("a").alias("a"))
        if lower is None:
            p = lambda n, total: (F.col(n) + 1.0) / (total + 256.0)
            here = here.select("gram", p("r", r).alias("pr"), p("a", a).alias("pa"))
        else:
            context = counted.groupBy(F.substring(F.substring("gram", -k, k), 1, k - 1).alias("_x")).agg(F.sum("r").alias("xr"), F.sum("a").alias("xa"))
            lower = lower.select(F.col("gram").alias("_end"), F.col("pr").alias("lr"), F.col("pa").alias("la"))
            here = here.withColumn("_x", F.substring("gram", 1, k - 1)).join(context, "_x").withColumn("_end", F.substring("gram", -(k - 1), k - 1)).join(lower, "_end")
            p = lambda n, x, low: (F.col(n) + PRIOR * F.col(low)) / (F.col(x) + PRIOR)
            here = here.select("gram", p("r", "xr", "lr").alias("pr"), p("a", "xa", "la").alias("pa"))
        lower = cut(here, f"url-order-{k}")
    return lower.select("gram", F.log(F.col("pr") / F.col("pa")).alias("ratio"))


def score(urls: DataFrame, model: DataFrame) -> DataFrame:
    """id and score, the mean ratio over the characters and the end of a URL (column seen), for every id of urls.

    A gram's places are dealt to SALTS parts by id; the model's rows go to the
    parts that have them, and the two are joined on gram and part.
    """
    parts_ = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = grams(urls.where("seen <> ''").select("id", "seen")).select("id", "gram", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    dealt = places.groupBy("gram", "salt", "id").agg(F.count("*").alias("times")).repartition(parts_, "gram", "salt")
    held = places.select("gram", "salt").distinct().join(model, "gram").repartition(parts_, "gram", "salt")
    steps = dealt.join(held.hint("shuffle_merge"), ["gram", "salt"]).select("id", "times", F.round(F.col("ratio") * STEP).cast("long").alias("steps"))
    return steps.groupBy("id").agg((F.sum(F.col("steps") * F.col("times")) / F.sum("times") / STEP).alias("score"))


def threshold(scored: DataFrame, step: float = 0.02, most: float = 6.0, slack: float = 0.01) -> float:
    """The score from which URLs are blocked: the middle of the range that parts rejected from accepted URLs (column bad).

    A histogram of at most 2 * most / step bins of both sets decides, by the
    share of rejected URLs above less that of accepted ones; scores within
    `slack` of the best count.  Without rejected or accepted URLs nothing is
    blocked.
    """
    bins = round(most / step)
    at = F.greatest(F.least(F.floor(F.col("score") / step), F.lit(bins)), F.lit(-bins))
    rows = scored.where("score IS NOT NULL AND bad IS NOT NULL").groupBy(at.cast("int").alias("at")).agg(F.count(F.when(F.col("bad"), 1)).alias("r"), F.count(F.when(~F.col("bad"), 1)).alias("a")).collect()
    r, a = sum(x["r"] for x in rows), sum(x["a"] for x in rows)
    if not r or not a:
        return float("inf")
    of, best, above_r, above_a = {x["at"]: x for x in rows}, [], 0, 0
    for b in range(bins, -bins - 1, -1):
        above_r, above_a = above_r + (of[b]["r"] if b in of else 0), above_a + (of[b]["a"] if b in of else 0)
        best.append((round(above_r / r - above_a / a, 9), b * step))
    top = max(x for x, _ in best)
    fits = [t for x, t in best if x >= top - slack]
    return (min(fits) + max(fits)) / 2


def held_out(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(HELD_OUT)) == 0


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score and held_out of every row of pages.

    A rule decides where one fits; else the models, on the whole URL: a score
    at or above the threshold blocks.  The models learn from URLs that a rule
    decides, but for those with held_out set, which calibrate the threshold (all
    decided URLs, where one side has none held out).  Without decided URLs of
    both kinds nothing else is blocked.  A null or empty url is allowed and has
    no score; a url without "://" has an empty host and path, fits no rule and
    is scored like any other.  Repeated rows give repeated results; a null
    page_id stays null; an empty table gives an empty result.  Only page_id and
    url are read.
    """
    spark = pages.sparkSession
    host, path = parts(F.col("url"))
    name, verdict = ruled(rules)
    urls = pages.select(F.col("page_id"), F.col("url")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumns({"host": host, "path": path})
    urls = urls.withColumns({"rule": name, "ruled": verdict, "seen": scored_text(F.col("url"))})
    urls = urls.withColumn("held_out", F.col("ruled").isNotNull() & held_out(F.col("seen")))
    urls = cut(urls.withColumn("id", F.monotonically_increasing_id()), "urls")  # written, so that ids stay
    bad = F.when(F.col("ruled").isNotNull(), F.col("ruled") == "block")
    model = train(urls.select("seen", F.when(~F.col("held_out"), bad).alias("bad")))
    scored = cut(urls.join(score(urls, model), "id", "left"), "url-scores")
    limit = threshold(scored.select("score", F.when(F.col("held_out"), bad).alias("bad")))
    if limit == float("inf"):
        limit = threshold(scored.select("score", bad.alias("bad")))
    modelled = F.when(F.col("score") >= F.lit(limit), F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", modelled).alias("verdict"), "score", "held_out")
