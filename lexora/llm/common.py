"""What the operators share: tables, written cuts of lineage, bounded samples, repeated rows, salted aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.shared import cut

__all__ = ["SPACE", "SPACES", "attach", "cut", "each_copy", "lowest", "table", "words_of"]

#: ASCII white space between words, as a character class and as a list for btrim.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowest(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most `most` rows of df, those of the smallest hashes of keys; as many as there are, where keys repeat too.

    Of a large table all but about one and a half times as many are filtered
    out first, so that tasks don't each put forward `most` rows.  Where too few
    pass, as few keys hold most rows, all rows are put forward.
    """
    total = df.count()
    if total > 2 * most:
        few = df.where(F.xxhash64(*keys) <= -(2**63) + int(1.5 * most / total * 2**64))
        if few.limit(most).count() == most:
            df = few
    return df.orderBy(F.xxhash64(*keys), *keys).limit(most)


def each_copy(df: DataFrame, to: str, chunk: int = 1 << 16) -> DataFrame:
    """The rows of df, each with its number among the rows equal to it, from 0.

    Equal rows are counted before the shuffle and grown again in chunks that
    lie in different tasks, so that a row which a table repeats without end
    makes no large group.  All columns take part and must be comparable.
    """
    names = df.columns
    counted = cut(df.groupBy(*names).agg(F.count("*").alias("_copies")), "counted")
    most = counted.agg(F.max("_copies")).collect()[0][0] or 0
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / chunk))))
    if most > chunk:
        chunks = chunks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names, "_chunk")
    upto = F.least(F.col("_copies"), (F.col("_chunk") + 1) * chunk) - 1
    return chunks.select(*names, F.explode(F.sequence(F.col("_chunk") * chunk, upto)).alias(to))


def attach(df: DataFrame, keys: list[str], spread: Column, partial: list[Column], final: list[Column], salts: int = 32) -> DataFrame:
    """df with aggregates of its rows' key groups, without gathering a group in a task.

    A group is dealt to `salts` parts by `spread`; the parts are aggregated by
    `partial`, their results by `final` over the partial columns, and each part
    gets the result by a join on key and part.  Null keys form a group.
    """
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    parts = dealt.groupBy(*keys, "_salt").agg(*partial)
    whole = parts.groupBy(*keys).agg(*final, F.collect_list("_salt").alias("_salts"))
    back = whole.withColumn("_salt", F.explode("_salts")).drop("_salts")
    back = back.select(*[F.col(c).alias(f"_of_{c}") if c in (*keys, "_salt") else F.col(c) for c in back.columns])
    on = F.col("_salt") == F.col("_of__salt")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return dealt.join(back, on).drop("_salt", "_of__salt", *[f"_of_{k}" for k in keys])


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none where it is null or blank."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE + "+"))
