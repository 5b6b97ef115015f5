"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with
that speaker as the assistant and all others as named users; the character
spans to train on are the assistant's contents with their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexora.llm.common import cut

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns of a rendered piece; a conversation of more turns has several pieces, so that none needs unbounded memory.
PIECE = 64
#: Messages of a part of a piece: more than that lie in a piece only where rows repeat a turn number.
PART = 1024
#: Rows of a piece that one task numbers; a larger piece is numbered by all tasks.
NUMBERED = 1 << 16


def _name(speaker: Column) -> Column:
    """The speaker percent-encoded, so that different speakers have different names and none can forge a mark."""
    return F.replace(F.replace(F.url_encode(speaker), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def parted(rows: DataFrame, most: int, numbered: int = NUMBERED) -> DataFrame:
    """rows (conv_id, piece, turn, who, said) with part, their place in the order of their piece by `most`.

    Pieces of more than `numbered` rows, as where rows without end share a turn,
    are sorted by ranges over all tasks; a row's place is its place in its range
    plus the rows of the piece's ranges before.  Equal rows are told apart by
    where they were read, so that they make no large range.
    """
    piece, order = ["conv_id", "piece"], ["turn", "who", "said"]
    nth = lambda *of: F.row_number().over(W.partitionBy(*piece, *of).orderBy(*order))
    part = lambda place: F.floor((place - 1) / most).cast("long")
    named = lambda df, names: df.withColumnsRenamed({n: f"_{n}" for n in names})
    same = lambda *names: [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    large = named(cut(rows.groupBy(*piece).count().where(F.col("count") > numbered).select(*piece), "large"), piece)
    if not large.limit(1).count():
        return rows.withColumn("part", part(nth()))
    small = rows.join(large, same(*piece), "left_anti").withColumn("part", part(nth()))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = rows.withColumn("_at", F.monotonically_increasing_id()).join(large, same(*piece), "left_semi")
    ranged = cut(read.repartitionByRange(parts, *piece, *order, "_at").withColumn("range", F.spark_partition_id()).drop("_at"), "ranged")
    sizes = ranged.groupBy(*piece, "range").count()
    before = sizes.select(*piece, "range", F.coalesce(F.sum("count").over(W.partitionBy(*piece).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = ranged.join(named(before, [*piece, "range"]), same(*piece, "range")).withColumn("part", part(nth("range") + F.col("before")))
    return small.unionByName(placed.select(*small.columns))


def rotate(conversations: DataFrame, piece: int = PIECE, speaker: str = "role", system: str = "system", salts: int = 32, most: int = PART, numbered: int = NUMBERED) -> DataFrame:
    """One row for each conversation, participant, piece of `piece` turns and part of at most `most` messages.

    Reads conv_id, turn, text and the speaker's column.  Returns conv_id,
    perspective, piece, part, n_messages, text, and spans: an array of start and
    end (code points of text, end excluded) of what is trained on.  A
    conversation's dialogue is the texts of its pieces and parts in order.

    * Speakers equal to `system` keep that role in all perspectives and have none of their own.
    * A null speaker is a user without a name and has no perspective; a conversation without participants gives no row.
    * A null text is empty, a null turn comes before all others, a null conv_id is a conversation like any other.
    * Equal turns are ordered by speaker, then text; repeated rows stay.  However many rows share a turn, a part is all that is held in memory, and they are numbered by many tasks.
    * "<|" in a text becomes "< |", so that no text can forge a mark; names are percent-encoded but for letters, digits, "_", "." and "-".
    """
    rows = conversations.select("conv_id", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / piece).cast("long").alias("piece"), F.col("turn").cast("long").alias("turn"), F.col(speaker).alias("who"), F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("said"))
    salt = F.pmod(F.xxhash64("piece"), F.lit(salts)).cast("int")
    pieces = parted(rows, most, numbered).groupBy("conv_id", "piece", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "who", "said"))).alias("m")).withColumn("_salt", salt)
    speaks = F.when(F.col("who") != system, F.col("who"))
    parts = rows.withColumn("_salt", salt).groupBy("conv_id", "_salt").agg(F.collect_set(speaks).alias("who"))
    cast = parts.groupBy(F.col("conv_id").alias("_conv")).agg(F.array_distinct(F.flatten(F.collect_list("who"))).alias("cast"), F.collect_list("_salt").alias("_salts"))
    cast = cast.select("_conv", "cast", F.explode("_salts").alias("_of"))
    each = pieces.join(cast, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_salt") == F.col("_of"))).select("conv_id", "piece", "part", "m", F.explode("cast").alias("perspective"))

    def head(x: Column) -> Column:
        user = F.concat(F.lit(OPEN + "user"), F.coalesce(F.concat(F.lit(" name="), _name(x["who"])), F.lit("")))
        role = F.when(x["who"] == system, F.lit(OPEN + "system")).when(x["who"] == F.col("perspective"), F.lit(OPEN + "assistant")).otherwise(user)
        return F.concat(role, F.lit("\n"))

    shown = F.transform("m", lambda x: F.struct(head(x).alias("head"), F.concat(x["said"], F.lit(CLOSE)).alias("body"), F.coalesce(x["who"] == F.col("perspective"), F.lit(False)).alias("own")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct((end + 1).cast("long").alias("at"), F.when(x["own"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return each.withColumn("s", shown).select(
        "conv_id", "perspective", "piece", "part", F.size("m").cast("long").alias("n_messages"),
        F.array_join(F.transform("s", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"),
        F.aggregate("s", start, step, lambda acc: acc["spans"]).alias("spans"),
    )


def _oracle() -> str:
    return f"""
WITH r AS (
  SELECT conv_id, CAST(floor(coalesce(turn, -1) / {PIECE}) AS BIGINT) AS piece, turn, role AS who,
         replace(coalesce(text, ''), '<|', '< |') AS said
  FROM conversations),
p AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY conv_id, piece ORDER BY turn NULLS FIRST, who NULLS FIRST, said) - 1) // {PART} AS BIGINT) AS part FROM r),
casts AS (SELECT DISTINCT conv_id, who AS perspective FROM r WHERE who <> 'system'),
m AS (
  SELECT p.*, c.perspective,
         CASE WHEN who = 'system' THEN '{OPEN}system' WHEN who = c.perspective THEN '{OPEN}assistant'
              ELSE '{OPEN}user' || coalesce(' name=' || replace(url_encode(who), '~', '%7E'), '') END || chr(10) AS head,
         said || '{CLOSE}' || chr(10) AS body,
         coalesce(who = c.perspective, false) AS own
  FROM p JOIN casts c ON p.conv_id IS NOT DISTINCT FROM c.conv_id),
o AS (
  SELECT *, row_number() OVER w AS rn, coalesce(sum(length(head) + length(body)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM m WINDOW w AS (PARTITION BY conv_id, perspective, piece, part ORDER BY turn NULLS FIRST, who NULLS FIRST, said))
SELECT conv_id, perspective, piece, part, CAST(count(*) AS BIGINT) AS n_messages, string_agg(head || body, '' ORDER BY rn) AS text,
       coalesce(string_agg(CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + length(head) + length(body) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE own), '') AS spans,
       CAST(coalesce(sum(length(body) - 1) FILTER (WHERE own), 0) AS BIGINT) AS trained_chars
FROM o GROUP BY conv_id, perspective, piece, part"""


ORACLE = _oracle()


def digest(rotated: DataFrame) -> DataFrame:
    """spans as text, and the number of trained code points."""
    as_text = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    trained = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return rotated.select("conv_id", "perspective", "piece", "part", "n_messages", "text", as_text.alias("spans"), trained.alias("trained_chars"))
