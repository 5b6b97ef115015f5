"""Document fingerprints by consistent weighted sampling, in Spark SQL functions only.

A document is a bag of words weighted by their counts.  For each sample k a
word draws r and c from Gamma(2, 1) and b from the uniform distribution, all
from hashes of the word and k alone.  A word of weight S then has
t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1); the sample is the word
and t with the least a.  Two documents have equal samples with the generalised
Jaccard similarity of their weights as probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexora.llm.common import cut, lowest, words_of

#: Samples of a fingerprint; a likeness has a standard error of at most 0.5 / sqrt(SAMPLES).
SAMPLES = 32
#: Rows of a bucket of neighbouring documents, as expected, while the bounds of all buckets fit in a plan; a bucket
#: streams through its sort, so that its size is no matter of memory.
BUCKET, BOUNDS = 500, 1 << 16
#: The sample of a text without words.
NONE = 0xFFFFFFFF


def _packed(k: int) -> Column:
    """ln a of a word's draw for sample k in the upper bits, the name of the word and t below: its least value is the sample.

    Reads word (a 64-bit hash) and lns.  Five uniform numbers come from 21-bit
    fields of two hashes; ln a counts in steps of 2^-24, a finer tie is broken by name.
    """
    unit = "((shiftright(xxhash64(word, {s}), {at}) & 2097151) + 0.5D) / 2097152"
    u = [unit.format(s=2 * k + i // 3, at=21 * (i % 3)) for i in range(5)]
    r = f"(-ln({u[0]} * {u[1]}))"
    ln_c = f"ln(-ln({u[2]} * {u[3]}))"
    t = f"floor(lns / {r} + {u[4]})"
    ln_a = f"({ln_c} - {r} * ({t} - {u[4]} + 1))"
    name = f"((word ^ ({t} * 2654435761)) & 4294967295)"
    return F.expr(f"shiftleft(floor(({ln_a} + 64) * 16777216), 32) | {name}")


def _likeness(a: Column, b: Column, samples: int) -> Column:
    """The share of equal samples of two fingerprints."""
    same = F.lit(0)
    for k in range(samples):
        same = same + (F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8)).cast("int")
    return same / F.lit(float(samples))


def _bucket(bounds: list[Column], most: int) -> Column:
    """How many of the bounds (sorted, as literal arrays by part of the key) lie below the row's key: a binary search."""
    steps = [1 << b for b in reversed(range(most.bit_length()))]

    def step(at: Column, by: Column) -> Column:
        below, tied = F.lit(False), F.lit(True)
        for bound, own in zip(bounds, KEY, strict=True):
            x = F.get(bound, at + by - 1)
            below, tied = below | (tied & (x < F.col(own))), tied & (x == F.col(own))
        return F.when(F.coalesce(below, F.lit(False)), at + by).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


#: Where a document lies: its id (null: the least), a hash of its text, its number in the table.
KEY = ("_id", "_h", "_row")


def neighbours(docs: DataFrame, per_bucket: int = BUCKET) -> DataFrame:
    """bucket, n, own, doc_id, text and next, the text of the next document by falling doc_id (the last one's is the first's).

    Documents lie in buckets of neighbouring keys, each bucket in one task.  No
    two rows have the same key, so buckets are even, however many rows share an
    id, a text or both.  The bounds are keys of a sample of rows; a bound's row
    is its bucket's last, and a copy of it (own is false) opens the next bucket
    as the neighbour of its first.  docs is read more than once and must give
    its rows in the same order each time, as stored tables do.
    """
    key = {"_id": F.coalesce(F.col("doc_id"), F.lit(-(2**63))), "_h": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumns(key)
    keys = cut(rows.select(*KEY), "keys")
    n, last = keys.agg(F.count("*"), F.max(F.struct(*KEY))).collect()[0]
    buckets = max(1, min(BOUNDS, -(-n // per_bucket)))
    some = sorted(tuple(r) for r in lowest(keys, list(KEY), 16 * buckets).collect()) if buckets > 1 else []
    bounds = sorted({some[(i + 1) * len(some) // buckets] for i in range(buckets - 1)} | ({tuple(last)} if last else set())) or [(0, 0, 0)]
    held = [F.split(F.lit(",".join(str(x[i]) for x in bounds)), ",").cast("array<bigint>") for i in range(len(KEY))]  # folded to one constant each
    placed = rows.withColumn("bucket", F.least(_bucket(held, len(bounds)), F.lit(len(bounds) - 1)))
    at_bound = F.lit(True)
    for bound, own in zip(held, KEY, strict=True):
        at_bound = at_bound & (F.get(bound, F.col("bucket")) == F.col(own))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(True).alias("own"))
    lent = F.struct(F.pmod(F.col("bucket") + 1, F.lit(len(bounds))).alias("bucket"), F.lit(False).alias("own"))
    dealt = placed.select("doc_id", "text", *KEY, F.inline(F.when(at_bound, F.array(own, lent)).otherwise(F.array(own))))
    w = W.partitionBy("bucket").orderBy("own", *KEY, "doc_id")  # all columns, whatever is read of the result: so the texts are shuffled once
    return dealt.select("bucket", F.row_number().over(w).alias("n"), "own", "doc_id", "text", F.coalesce(F.lag("text").over(w), F.lit("")).alias("next"))


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by the first as many of the next document."""
    n = F.length(text)
    cut_ = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut_), F.substring(following, F.lit(1), cut_))


def _fingerprint(columns: list[Column]) -> Column:
    """Eight hexadecimal digits for each sample."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.coalesce(c.bitwiseAND(F.lit(NONE)), F.lit(NONE))), 8, "0") for c in columns]))


def signatures(rows: DataFrame, samples: int) -> DataFrame:
    """bucket, n, fingerprint, edited_fingerprint of rows with bucket, n, words and edited_words (arrays of hashes).

    Words with the same count in both texts draw once for both.
    """
    tagged = F.concat(F.transform("words", lambda w: w.bitwiseOR(F.lit(1))), F.transform("edited_words", lambda w: F.shiftleft(F.shiftright(w, 1), 1)))
    each = rows.select("bucket", "n", F.explode_outer(tagged).alias("_w"))
    odd = F.col("_w").bitwiseAND(F.lit(1))
    counts = each.groupBy("bucket", "n", F.shiftright("_w", 1).alias("word")).agg(F.sum(odd).alias("o"), (F.count("_w") - F.coalesce(F.sum(odd), F.lit(0))).alias("e"))
    same = F.array(F.struct(F.lit(0).alias("of"), F.col("o").alias("s")))
    both = F.filter(F.array(F.struct(F.lit(1).alias("of"), F.col("o").alias("s")), F.struct(F.lit(2).alias("of"), F.col("e").alias("s"))), lambda x: x["s"] > 0)
    drawn = counts.select("bucket", "n", "word", F.inline(F.when(F.coalesce(F.col("o") == F.col("e"), F.lit(True)), same).otherwise(both)))
    drawn = drawn.withColumn("lns", F.when(F.col("s") > 0, F.log(F.col("s").cast("double"))))
    least = drawn.groupBy("bucket", "n", "of").agg(*[F.min(_packed(k)).alias(f"m{k}") for k in range(samples)])
    for_text = [F.min(F.when(F.col("of") != 2, F.col(f"m{k}"))).alias(f"o{k}") for k in range(samples)]
    for_edit = [F.min(F.when(F.col("of") != 1, F.col(f"m{k}"))).alias(f"e{k}") for k in range(samples)]
    whole = least.groupBy("bucket", "n").agg(*for_text, *for_edit)
    return whole.select("bucket", "n", _fingerprint([F.col(f"o{k}") for k in range(samples)]).alias("fingerprint"), _fingerprint([F.col(f"e{k}") for k in range(samples)]).alias("edited_fingerprint"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of docs.

    A null text is empty; texts without words have a fingerprint of their own,
    which is like itself alone.  Of rows with equal doc_ids, the next one
    follows by a hash of its text; equal rows follow each other.  A table of one
    row is its own next document; an empty table gives an empty result.  Columns
    other than doc_id and text aren't read.  docs is read more than once and
    must give its rows in the same order each time, as stored tables do.
    """
    near = neighbours(docs)
    edit = near.withColumn("edited", edited(F.col("text"), F.col("next")))
    hashed = lambda text: F.transform(words_of(text), lambda w: F.xxhash64(w))
    signed = signatures(edit.select("bucket", "n", hashed(F.col("text")).alias("words"), hashed(F.col("edited")).alias("edited_words")), samples)
    facts = edit.select("bucket", "n", "own", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    both = facts.join(signed.hint("shuffle_merge"), ["bucket", "n"])
    following = F.lag("fingerprint").over(W.partitionBy("bucket").orderBy("n"))
    return both.withColumn("_next", following).where("own").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        _likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"), _likeness(F.col("fingerprint"), F.col("_next"), samples).alias("near_next"),
    )
