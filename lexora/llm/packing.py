"""Packing of token sequences by first-fit decreasing over a tournament tree.

Documents are tokenized and dealt to groups of bounded expected size by a hash
of their ids and tokens.  A document is cut into pieces of one sequence's length
and a rest; within a group, pieces go by falling length into the first sequence
with room; a tournament tree over the sequences' room finds it in logarithmic
time.  Only lengths are moved: a piece is named by its document, its start and
a checksum of its ids.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexora.llm.chunk_pool import slices
from lexora.llm.common import cut, each_copy

LENGTH = 2048
#: The id that ends a document.
END = 1
#: Documents of a group, as expected.
GROUP = 16384
SEED = 20240607

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
NAMES = [x.split()[0] for x in PIECES.split(", ")]


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str):
    """A function from a text to its ids, one for each worker: those of the vocabulary file's own library without special tokens added.

    That library reads a special token's string in a text as that token.  The
    file's merges number its tokens in their order, so that merging by rank
    gives the same ids; a file for which this doesn't hold, or whose added
    tokens are not plain strings that stand for themselves, is read by its own
    library.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, added = file["model"], file["added_tokens"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    special = {t["content"]: t["id"] for t in added}
    ranks = {t: i for t, i in vocab.items() if special.get(t) != i}
    by_rank = [ranks.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges))) and sorted(ranks.values()) == list(range(256 + len(merges)))
    as_they_are = len(special) <= 1 and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if by_rank and as_they_are and file["normalizer"] is None:
        own = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks={bytes(chars[c] for c in t): i for t, i in ranks.items()}, special_tokens=special)
        return lambda text: own.encode(text, allowed_special="all", disallowed_special=()) if any(x in text for x in special) else own.encode_ordinary(text)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Whole texts as ids, ended by `end`, cut into pieces of `length` and a rest; doc_crc32 is a checksum of all ids of the document.

    A null text is empty and so has one id, `end`; null and repeated doc_ids
    stay.  Columns other than doc_id and text aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        for b in batches:
            docs_, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in slices(texts):
                out: list[tuple] = []
                for k in range(i, j):
                    ids = np.array([*encode(texts[k] or ""), end], "<u4")
                    whole = zlib.crc32(ids)
                    out += [(docs_[k], s, len(x := ids[s : s + length]), zlib.crc32(x), len(ids), whole) for s in range(0, len(ids), length)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[*NAMES, "doc_crc32"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + ", doc_crc32 long")


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For each size the bin and the place in it: by falling size (ties as they come), into the first bin with room.

    The tree's leaves are the bins' room, its inner nodes the larger of their
    children; the first bin with enough room is found from the root.
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [room] * (2 * leaves)
    at, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-sizes, kind="stable").tolist()
    size = sizes.tolist()
    for i in order:
        x, k = size[i], 1
        while k < leaves:
            k *= 2
            if tree[k] < x:
                k += 1
        at[i], offset[i] = k - leaves, room - tree[k]
        tree[k] -= x
        while k > 1:
            k //= 2
            most = tree[2 * k] if tree[2 * k] >= tree[2 * k + 1] else tree[2 * k + 1]
            if tree[k] == most:
                break
            tree[k] = most
    return at, offset


def pack(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """One row for each piece of each row of docs: PIECES, sequence_id and offset.

    A sequence holds at most `length` ids; its pieces lie without gaps from
    offset 0.  Sequence ids are unique over all groups.  Documents are dealt to
    ceil(documents / group) groups by a seeded hash of their id, their tokens
    and, where rows repeat, the row's number among its equals, so that no key
    makes a group large.  Within a group, equally long pieces go by document and
    start, so the same rows are packed alike whatever their order.  An empty
    table gives an empty result.
    """
    cuts = each_copy(pieces(docs, path, pattern, length), "_copy")
    cuts = cut(cuts, "pieces")
    groups = max(1, -(-cuts.where("start = 0").count() // group))
    dealt = cuts.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_tokens", "doc_crc32", "_copy"), F.lit(groups)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "doc_crc32", "doc_tokens", "_copy", "start")])
        at, offset = first_fit_decreasing(rows["length"].to_numpy(), length)
        sequence = rows["_group"].to_numpy() * (1 << 32) + at
        return rows.select(NAMES).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("_group").applyInArrow(run, PIECES + ", sequence_id long, offset long")
