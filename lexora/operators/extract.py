"""From HTML and text to blocks, text nodes, sentences and script runs with places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.constants import BLANK, BLOCK, SCRIPTS, UNSEEN
from lexora.functions.arrays import starts
from lexora.functions.text import is_blank, runs, sentences

# Character references that SQL twins replace; "&" comes last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
_REFERENCE = r"&#[xX]?[0-9a-fA-F]+;|&[A-Za-z][A-Za-z0-9]*;"


def _named() -> Column:
    """All named references of HTML that end in ";", as one constant, by way of the standard library's table."""
    from html.entities import html5

    both = [(k[:-1], v) for k, v in sorted(html5.items()) if k.endswith(";")]
    return F.map_from_arrays(F.split(F.lit(" ".join(k for k, _ in both)), " "), F.split(F.lit("\x02".join(v for _, v in both)), "\x02"))


def _character(code: Column) -> Column:
    """The character of a code point; U+FFFD for none, as browsers have it."""
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")


def decoded(s: Column) -> Column:
    """s with character references, numeric and named, as the characters they stand for; unknown names stay as they are."""
    names = _named()

    def one(r: Column) -> Column:
        inner = F.substring(r, F.lit(2), F.length(r) - 2)
        number = F.when(F.lower(F.substring(inner, 2, 1)) == "x", F.conv(F.substring(inner, F.lit(3), F.length(inner)), 16, 10)).otherwise(F.substring(inner, F.lit(2), F.length(inner)))
        return F.when(F.startswith(inner, F.lit("#")), _character(F.expr("0").cast("bigint") + number.try_cast("bigint"))).otherwise(F.coalesce(F.try_element_at(names, inner), r))

    texts, found = F.split(s, _REFERENCE, -1), F.regexp_extract_all(s, F.lit(_REFERENCE), F.lit(0))
    whole = F.concat_ws("", F.flatten(F.zip_with(texts, F.transform(found, one), lambda t, r: F.array(t, r))))
    return F.when(F.instr(s, "&") > 0, whole).otherwise(s)


def text_nodes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, block_no, node_no and text of the text nodes that aren't blank, in document order.

    A block reaches from one tag of a block element to the next; a node from
    one tag to the next.  Two splits in the row: no shuffle.
    """
    blocks = F.split(F.regexp_replace("html", UNSEEN, ""), BLOCK, -1)
    each = pages.select(key, F.posexplode(blocks).alias("block_no", "_block"))
    nodes = each.select(key, "block_no", F.posexplode(F.split("_block", "<[^>]*>", -1)).alias("node_no", "_node"))
    return nodes.select(key, "block_no", "node_no", decoded(F.col("_node")).alias("text")).where(~is_blank(F.col("text")))


def blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, block_no and the block's text, white space collapsed, of blocks that aren't blank."""
    whole = F.split(F.regexp_replace("html", UNSEEN, ""), BLOCK, -1)
    each = pages.select(key, F.posexplode(whole).alias("block_no", "_block"))
    text = F.regexp_replace(F.regexp_replace(decoded(F.regexp_replace("_block", "<[^>]*>", "")), f"[{BLANK}]+", " "), "^ | $", "")
    return each.select(key, "block_no", text.alias("text")).where("text <> ''")


def sentence_rows(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return texts.select(*keys, F.posexplode(sentences(F.col(text))).alias("sent_no", "sentence"))


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each block, however often it was taken in: which one of repeated ones is no matter, as they are equal."""
    return rows.dropDuplicates(keys)


def run_rows(rows: DataFrame, keys: list[str], script: str = "han", text: str = "sentence") -> DataFrame:
    return rows.select(*keys, F.posexplode(runs(F.col(text), script)).alias("run_no", "run"))


def placed(texts: DataFrame, pattern: str, keys: list[str], text: str = "text") -> DataFrame:
    """keys, part_no, part, start and end of the consecutive parts of text that match pattern, which must cover it."""
    parts = texts.select(*keys, F.inline(F.array(F.struct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("_parts")))))
    at = starts(F.transform("_parts", lambda x: F.length(x)))
    each = parts.select(*keys, F.posexplode(F.arrays_zip(F.col("_parts").alias("part"), at.alias("start"))).alias("part_no", "_p"))
    return each.select(*keys, "part_no", "_p.part", (F.col("_p.start") + F.length("_p.part")).alias("end"), "_p.start")


def placed_runs(texts: DataFrame, keys: list[str], script: str = "han", text: str = "text") -> DataFrame:
    """keys, run, start and end of script runs in the text."""
    c = SCRIPTS[script]
    return placed(texts, f"[{c}]+|[^{c}]+", keys, text).where(F.col("part").rlike(f"^[{c}]")).select(*keys, F.col("part").alias("run"), "start", "end")


def placed_sentences(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    from lexora.constants import SENTENCE

    return placed(texts, f"{SENTENCE}|[{BLANK}]+", keys, text).where(F.col("part").rlike(f"^[^{BLANK}]")).select(*keys, F.col("part").alias("sentence"), "start", "end")
