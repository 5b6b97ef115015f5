"""Similarity join of documents on word n-grams by a MinHash LSH forest, then exact verification.

Each text has a label of DEPTH minima in each of TREES trees.  The labels of a
tree, sorted, are a prefix trie.  From full labels on, texts below one node are
compared by their whole n-gram sets; then prefixes are shortened by a level,
until the share of links found, as estimated from the similarities of those
found so far, reaches the target recall.  Nodes whose texts are connected by
verified links already, or that hold the same texts as another, aren't compared
again.  Classes are the components of verified links alone; links are counted by
comparing the texts of a class.

Equal texts (equal word sequences) stand for each other throughout: one of
them is signed, sorted and compared, with the number of its copies as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexora.llm.common import attach, cut
from lexora.llm.components import components
from lexora.shared import spent

TREES, DEPTH = 16, 6
#: Words of an n-gram, the least similarity of a link, and the share of links that must be found.
WORDS, LEAST, RECALL = 5, 0.8, 0.999
#: Links at the least similarity that the estimate of recall takes for granted, so that few links don't stop the search.
PRIOR = 20
#: Documents and words of a block, as expected; a larger set of candidates is compared block by block.
BLOCK, BLOCK_WORDS = 512, 1 << 21
#: Bytes of text that are hashed at once, and n-grams that are signed at once.
SLICE, SIGNED = 1 << 20, 1 << 15

_U = np.uint64


def _numbers(seed: int, n: int) -> np.ndarray:
    """n random odd 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = _numbers(1, 256)
_PLACE = _numbers(2, WORDS * 4)
_MULTIPLY, _ADD = _numbers(3, TREES * DEPTH), _numbers(4, TREES * DEPTH)
_IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: list[np.ndarray] = []


def _powered(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + (1 << 12))
        _powers[:] = [np.concatenate([[_U(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1]


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, and the number of its text."""
    out, of, k = [], [], 0
    while k < len(texts):
        run, n = k, 0
        while run < len(texts) and (n == 0 or n + len(texts[run]) <= SLICE):
            n += len(texts[run])
            run += 1
        for data, sizes, first in _parts(texts, k, run):
            h, doc = _hashed(data, sizes)
            out.append(h)
            of.append(doc + first)
        k = run
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def _parts(texts: list[bytes], k: int, run: int) -> Iterator[tuple[bytes, list[int], int]]:
    """The texts k to run as one part; a single long text in parts that end at white space."""
    if run - k > 1 or len(texts[k]) <= SLICE:
        yield b"".join(texts[k:run]), [len(t) for t in texts[k:run]], k
        return
    raw, at = texts[k], 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):
            tail = np.flatnonzero(_IS_SPACE[np.frombuffer(raw, np.uint8, min(len(raw) - end, SLICE), end)])
            while not len(tail) and end + SLICE < len(raw):
                end += SLICE
                tail = np.flatnonzero(_IS_SPACE[np.frombuffer(raw, np.uint8, min(len(raw) - end, SLICE), end)])
            end = end + int(tail[0]) if len(tail) else len(raw)
        part = raw[at : min(end, len(raw))]
        yield part, [len(part)], k
        at = end


def _hashed(data: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    starts = np.cumsum([0, *sizes])[:-1]
    word = ~_IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts] = edge[-1] = True
    begins = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    power, inverse = _powered(len(raw))
    sums = np.concatenate([[_U(0)], np.cumsum(_BYTE[raw] * power)])
    h = _mix((sums[ends] - sums[begins]) * inverse[begins])
    return h, np.searchsorted(starts, begins, side="right") - 1


@dataclass
class Shingled:
    key: np.ndarray  # of each text: a hash of its word sequence
    words: np.ndarray  # number of words
    grams: np.ndarray  # n-gram hashes of all texts
    start: np.ndarray  # of each text's n-grams, and the end


def shingled(texts: list[bytes], n: int = WORDS) -> Shingled:
    """n-grams of words of each text; a text of fewer words has one n-gram, one without words has none."""
    h, of = hashed_words(texts)
    words = np.bincount(of, minlength=len(texts)) if len(texts) else np.empty(0, np.int64)
    first = np.cumsum(words) - words
    inside = np.arange(len(h), dtype=np.int64) - first[of]
    ordered = _mix(h + inside.astype(np.uint64) * _U(_BASE))
    sums = np.concatenate([[_U(0)], np.cumsum(ordered)])
    key = _mix(sums[first + words] - sums[first] + words.astype(np.uint64) * _PLACE[-1])
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        grams += h[k : k + len(grams)] * _PLACE[k]
    whole = inside[: len(grams)] + n <= words[of[: len(grams)]]
    grams, owner = _mix(grams[whole]), of[: len(grams)][whole]
    count = np.bincount(owner, minlength=len(texts))
    short = (words > 0) & (words < n)
    if short.any():
        grams = np.concatenate([grams, key[short]])
        owner = np.concatenate([owner, np.flatnonzero(short)])
        order = np.argsort(owner, kind="stable")
        grams, count = grams[order], count + short
    return Shingled(key, words, grams, np.concatenate([[0], np.cumsum(count)]))


def labels(s: Shingled) -> list[bytes | None]:
    """For each text with n-grams the labels of all trees: 4 bytes big-endian for each level."""
    count = np.diff(s.start)
    has = np.flatnonzero(count)
    out: list[bytes | None] = [None] * len(count)
    k = 0
    while k < len(has):
        upto = min(max(k + 1, int(np.searchsorted(s.start[has], s.start[has[k]] + SIGNED))), len(has))
        part = has[k:upto]
        x = s.grams[s.start[part[0]] : s.start[part[-1] + 1]]
        at = s.start[part] - s.start[part[0]]
        least, buffer = np.empty((len(part), TREES * DEPTH), ">u4"), np.empty_like(x)
        for j in range(TREES * DEPTH):
            np.multiply(x, _MULTIPLY[j], out=buffer)
            np.add(buffer, _ADD[j], out=buffer)
            least[:, j] = np.minimum.reduceat(buffer, at) >> _U(32)
        for i, row in zip(part, least, strict=True):
            out[i] = row.tobytes()
        k = upto
    return out


def met(similarity: float, levels: int, trees: int = TREES) -> float:
    """The probability that two texts share a prefix of so many levels in some tree."""
    return 1 - (1 - similarity**levels) ** trees


def depth(least: float = LEAST, recall: float = RECALL, trees: int = TREES, longest: int = DEPTH) -> int:
    """The longest prefix by which any pair of similarity `least` meets with the target recall: shortening never goes further."""
    d = longest
    while d > 1 and met(least, d, trees) < recall:
        d -= 1
    return d


def estimated(links: dict[float, int], levels: int, least: float, prior: int = PRIOR) -> float:
    """The share of links found at `levels`, from the numbers of links found by similarity: each stands for 1 / met() links."""
    found = prior * met(least, levels) + sum(links.values())
    return found / (prior + sum(n / met(s, levels) for s, n in links.items()))


def _texts(b: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in b.column(b.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def _batches(texts: list[bytes], most: int = 4 * SLICE) -> Iterator[tuple[int, int]]:
    begin, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= most:
            yield begin, i + 1
            begin, n = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text as it is), key, words and labels of every row (null: fewer words than an n-gram, so only equal texts are like it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b, "text")
            for i, j in _batches(texts):
                s = shingled(texts[i:j])
                signs = [x if n >= WORDS else None for x, n in zip(labels(s), s.words, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(s.key.view(np.int64)), pa.array(s.words, pa.int64()), pa.array(signs, pa.binary())], names=["doc_id", "hash", "key", "words", "labels"])

    return _hashed_rows(docs).mapInArrow(run, "doc_id long, hash long, key long, words long, labels binary")


def _hashed_rows(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("hash"), docs["text"].alias("text"))


def trie(texts: DataFrame, least_levels: int) -> DataFrame:
    """tree, label and key of the texts (key, labels) that share a prefix of `least_levels` with a neighbour in a tree's sorted labels.

    Labels are sorted over the whole cluster; texts under one prefix may span
    tasks, however common it is.  The first and the last of a task are kept
    whatever they share, as their neighbours lie elsewhere.
    """
    size = 4 * DEPTH
    each = texts.where("labels IS NOT NULL").select("key", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "labels")
    each = each.select(F.col("tree").cast("byte").alias("tree"), F.expr(f"substring(labels, tree * {size} + 1, {size})").alias("label"), "key")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = each.repartitionByRange(parts, "tree", "label", "key").sortWithinPartitions("tree", "label", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, which may share a prefix with the next batch's first
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            edge = held is None
            t = t if edge else pa.concat_tables([held, t])
            label = np.frombuffer(b"".join(t.column("label").to_pylist()), np.uint8).reshape(t.num_rows, size)[:, : 4 * least_levels]
            head = np.concatenate([t.column("tree").to_numpy().astype(np.uint8)[:, None], label], axis=1)
            like = (head[1:] == head[:-1]).all(axis=1)
            keep = np.concatenate([[edge], like]) | np.concatenate([like, [False]])
            keep[0] |= not edge and before
            before, held = bool(like[-1]) if len(like) else edge, t.slice(t.num_rows - 1)
            yield from t.slice(0, t.num_rows - 1).filter(pa.array(keep[:-1])).combine_chunks().to_batches()
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return ordered.mapInArrow(run, "tree byte, label binary, key long")


def nodes(tries: DataFrame, roots: DataFrame, levels: int, trees: int = TREES) -> DataFrame:
    """set and key of the texts below nodes of `levels`, for nodes that hold texts of several classes (key, root); equal sets once."""
    at = tries.where(F.col("tree") < trees).select("tree", F.substring("label", 1, 4 * levels).alias("prefix"), "key").join(roots, "key", "left")
    at = at.select("tree", "prefix", "key", F.coalesce("root", "key").alias("root"), F.xxhash64("key").alias("_x"))
    least = [F.count("*").alias("n"), F.bit_xor("_x").alias("x"), F.min("root").alias("a"), F.max("root").alias("b")]
    whole = [F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.min("a").alias("a"), F.max("b").alias("b")]
    sized = attach(at, ["tree", "prefix"], F.col("key"), least, whole).where("a <> b")
    return sized.select(F.xxhash64("n", "x").alias("set"), "key").distinct()


@dataclass
class Compared:
    """Of each set: the weight of the sets like it, the first of those connected to it, the first one like it and that similarity (0: none)."""

    weight: np.ndarray
    first: np.ndarray
    partner: np.ndarray
    similarity: np.ndarray


def _compared(sets: list[np.ndarray], block: np.ndarray, weight: np.ndarray, least: float, across: bool) -> Compared:
    """Compare all sets, or only those of different blocks (across).

    Sizes of intersections come from products of the incidence matrix of sets
    and n-grams, a range of n-grams at a time.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    gram, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    shared = count[inverse] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[inverse[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    columns = int(column[-1]) + 1 if len(column) else 0
    both, width = np.zeros((n, n), np.float32), min(columns, max(64, (1 << 22) // n))
    for k in range(0, columns, width or 1):
        i, j = np.searchsorted(column, (k, k + width))
        part = np.zeros((n, width), np.float32)
        part[owner[i:j], column[i:j] - k] = 1
        both += part @ part.T
    union = size[:, None] + size[None, :] - both
    like = both >= least * union - 1e-6
    np.fill_diagonal(like, False)
    if across:
        like &= block[:, None] != block[None, :]
    root, partner, rows = np.arange(n), like.argmax(axis=1), np.arange(n)
    similarity = np.where(like[rows, partner], both[rows, partner] / np.maximum(union[rows, partner], 1), 0.0)
    while True:
        lower = np.minimum(root, np.where(like, root[None, :], n).min(axis=1))
        if (lower == root).all():
            return Compared(like @ weight, root, partner, similarity)
        root = lower


def held(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """key, copies, words and grams (the set of n-gram hashes) of texts (key, rep, hash, copies, words), read from their rows in docs.

    A text's row is found by id and by a hash of the text, so that rows which
    share an id, null or not, don't meet.
    """
    rows = _hashed_rows(docs)
    chosen = texts.select(F.col("rep").alias("_rep"), F.col("hash").alias("_hash"), "key", "copies", "words")
    found = rows.join(chosen, (F.col("hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_rep"))).select("key", "copies", "words", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows of this task
        for b in batches:
            raw = _texts(b, "text")
            for i, j in _batches(raw):
                part, s = b.slice(i, j - i), None
                keys = part.column(0).to_numpy()
                new = np.flatnonzero([k not in seen and not seen.add(k) for k in keys.tolist()])
                if len(new):
                    s = shingled([raw[i + x] for x in new])
                    mine = s.key.view(np.int64) == keys[new]  # not another text of the same hash
                    grams = [np.unique(s.grams[x:y]).tobytes() for x, y in zip(s.start[:-1], s.start[1:], strict=True)]
                    out = part.take(pa.array(new))
                    yield pa.RecordBatch.from_arrays([*out.columns[:-1], pa.array(grams, pa.binary())], names=[*out.schema.names[:-1], "grams"]).filter(pa.array(mine))
                if len(seen) > 1 << 16:
                    seen.clear()

    return found.mapInArrow(sets, "key long, copies long, words long, grams binary")


def verified(sets: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """key, links, first, partner, similarity and blocks for the members (set, key) of sets of texts, by comparing whole sets of n-grams (of held()).

    A set of one block is compared in one task; one of more blocks in a task
    for each two of them, which gets only these blocks' texts.
    """
    spark = sets.sparkSession
    full = members.join(sets.select(F.col("key").alias("_key"), "copies", "words"), F.col("key") == F.col("_key")).drop("_key")
    sized = attach(full, ["set"], F.col("key"), [F.count("*").alias("_n"), F.sum("words").alias("_w")], [F.sum("_n").alias("_n"), F.sum("_w").alias("_w")])
    blocks = F.greatest(F.ceil(F.col("_n") / BLOCK), F.ceil(F.col("_w") / BLOCK_WORDS)).cast("int")
    sized = sized.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sized.select("set", "key", "copies", "block", "blocks").join(sets.select(F.col("key").alias("_key"), "grams"), F.col("key") == F.col("_key"))
    dealt = dealt.select("set", "key", "copies", "block", "blocks", "grams", F.explode(other).alias("x"))
    dealt = dealt.select("set", F.least("block", "x").alias("p"), F.greatest("block", "x").alias("q"), "key", "copies", "block", "blocks", "grams")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "set", "p", "q").sortWithinPartitions("set", "p", "q", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(rows: list[tuple]) -> Iterator[tuple]:
            rows = [r for r, before in zip(rows, [None, *rows], strict=False) if before is None or before[3] != r[3]]  # repeated rows
            if len(rows) > 1 or rows[0][6] > 1:
                c = _compared([np.frombuffer(r[7], np.uint64) for r in rows], np.array([r[5] for r in rows]), np.array([r[4] for r in rows], np.int64), least, rows[0][1] != rows[0][2])
                for r, n, f, p, s in zip(rows, c.weight.tolist(), c.first.tolist(), c.partner.tolist(), c.similarity.tolist(), strict=True):
                    yield r[3], int(n), rows[f][3], rows[p][3], s, r[6]

        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["key", "links", "first", "partner", "similarity", "blocks"])

        group: list[tuple] = []
        out: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if group and row[:3] != group[0][:3]:
                    out += compared(group)
                    group = []
                group.append(row)
            if len(out) >= 4096:
                yield batch(out)
                out = []
        if group:
            out += compared(group)
        if out:
            yield batch(out)

    return dealt.mapInArrow(run, "key long, links long, first long, partner long, similarity double, blocks int")


@dataclass
class Classes:
    """texts: key, rep, hash (of the row that stands for equal texts), copies and words of every different text; roots: key and root of those with links; sets: held() of those with candidates."""

    rows: DataFrame
    texts: DataFrame
    roots: DataFrame
    sets: DataFrame


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (key, root) after links (a, b) between keys; only the roots that links touch are joined anew."""
    of = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c)
    at = links.select("a", "b").join(roots.toDF("a", "_a"), "a", "left").join(roots.toDF("b", "_b"), "b", "left").select(of("a"), of("b"))
    new = components(at).toDF("_node", "_new")
    known = roots.select("key", "root").union(new.select("_node", "_node")).distinct()
    return known.join(new, F.col("root") == F.col("_node"), "left").groupBy("key").agg(F.min(F.coalesce("_new", "root")).alias("root"))


def classes(docs: DataFrame, least: float = LEAST, recall: float = RECALL) -> Classes:
    """The search: comparing below full labels of one tree, then of all, then of shorter and shorter prefixes."""
    rows = cut(signed(docs), "signed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("rep"), "hash")
    texts = rows.groupBy("key").agg(F.min(order).alias("_r"), F.count("*").alias("copies"), F.max("words").alias("words"), F.max("labels").alias("labels"))
    texts = cut(texts.select("key", "_r.rep", "_r.hash", "copies", "words", "labels"), "texts")
    shortest = depth(least, recall)
    tries = cut(trie(texts, shortest), "trie")
    # a text alone at the edge of a task isn't a candidate
    shared = attach(tries.withColumn("_p", F.substring("label", 1, 4 * shortest)), ["tree", "_p"], F.col("key"), [F.count("*").alias("_n")], [F.sum("_n").alias("_n")])
    sorted_, tries = tries, cut(shared.where("_n > 1").select("tree", "label", "key"), "candidates")
    spent(sorted_)
    texts = texts.drop("labels")
    sets = cut(held(docs, texts.join(tries.select("key").distinct(), "key", "left_semi")), "sets")
    roots = docs.sparkSession.createDataFrame([], "key long, root long")
    links = docs.sparkSession.createDataFrame([], "a long, b long, s double")
    for levels, trees in [(DEPTH, 1), *((d, TREES) for d in range(DEPTH, shortest - 1, -1))]:
        members = cut(nodes(tries, roots, levels, trees), "members")
        found = cut(verified(sets, members, least).where("similarity > 0").select("key", "first", "partner", "similarity"), "found")
        spent(members)
        if found.limit(1).count():
            roots = cut(_merged(roots, found.where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))), "roots")
        links = links.union(found.select(F.least("key", "partner"), F.greatest("key", "partner"), F.round("similarity", 3))).distinct()
        if trees == TREES and estimated({r["s"]: r["count"] for r in links.groupBy("s").count().collect()}, levels, least) >= recall:  # at most a thousand similarities
            break
    return Classes(rows, texts, roots, sets)


def _named(c: Classes) -> DataFrame:
    """key and class_row (rep and hash of the class's first row) of the texts with links."""
    linked = c.roots.join(c.texts, "key").select("key", "root", F.struct(F.col("rep").isNull().alias("none"), "rep", "hash").alias("_o"))
    return attach(linked, ["root"], F.col("key"), [F.min("_o").alias("_m")], [F.min("_m").alias("_m")]).select("key", F.col("_m.rep").alias("class_rep"), F.col("_m.hash").alias("class_hash"), F.lit(True).alias("in_class"))


def join(docs: DataFrame, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, copy_id and n_links of every row of docs.

    Two documents are linked if the Jaccard similarity of their sets of word
    n-grams is at least `least`; class_id is the smallest doc_id of those
    connected by links, copy_id that of the equal texts (equal sequences of
    words), n_links the number of other rows linked to the row.

    * A null text is empty; texts without words are copies of each other; texts of fewer words than an n-gram are like equal texts alone.
    * Rows of equal doc_ids are rows like any others; null ids stay and are never the smallest but where all are null.
    * An empty table gives an empty result; columns other than doc_id and text aren't read.
    """
    c = classes(docs, least, recall)
    counts = verified(c.sets, c.roots.select(F.col("root").alias("set"), "key"), least).groupBy("key").agg(F.sum("links").alias("links"))
    known = c.texts.join(cut(_named(c), "named"), "key", "left").join(cut(counts, "links"), "key", "left")
    class_id = F.when(F.col("in_class"), F.col("class_rep")).otherwise(F.col("rep"))
    known = known.select("key", F.col("rep").alias("copy_id"), class_id.alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return c.rows.select("doc_id", "key").join(cut(known, "known"), "key").select("doc_id", "class_id", "copy_id", "n_links")


def one_of_each(docs: DataFrame, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """The rows of docs that stand for their class: of each class the row of the smallest doc_id; all columns stay.

    Nulls, short texts and repeated rows are as in join(); of rows equal in
    doc_id and text one stays, and so of rows with one doc_id and equal words.
    """
    c = classes(docs, least, recall)
    known = c.texts.join(cut(_named(c), "named"), "key", "left")
    best = known.where(F.col("in_class").isNull() | (F.col("rep").eqNullSafe(F.col("class_rep")) & (F.col("hash") == F.col("class_hash")))).select(F.col("rep").alias("_rep"), F.col("hash").alias("_hash"))
    best = cut(best, "best")
    own = [f"_own_{i}" for i in range(len(docs.columns))]
    text, doc_id = F.col(own[docs.columns.index("text")]), F.col(own[docs.columns.index("doc_id")])
    rows = docs.toDF(*own).withColumns({"_i": doc_id.cast("long"), "_h": F.xxhash64(F.coalesce(text, F.lit("")))})
    kept = rows.join(best, (F.col("_h") == F.col("_hash")) & F.col("_i").eqNullSafe(F.col("_rep")), "left_semi")
    if c.rows.groupBy("doc_id", "hash").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["_i", "_h"])
    return kept.select(*own).toDF(*docs.columns)
