"""Byte-level BPE encoding and decoding over padded numpy matrices.

Distinct pre-tokens of a batch, of any length, are bucketed by byte length and
laid out as rows of a padded matrix.  In each round every row merges its pair of
minimum rank, leftmost first, wherever the row has it (only the leftmost, where
a merge makes a pair of no higher rank); pairs are looked up in an
open-addressing hash table, rows close up, and rows without a pair left are
taken out.  Where two adjacent bytes are in no token together, no merge can
cross, and a pre-token is laid out as several rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexora.llm.chunk_pool import ChunkPool, slices

#: Rows and cells of a matrix; a longer row is a matrix of its own.
ROWS, CELLS = 1 << 14, 1 << 21
NONE = np.int32(2**31 - 1)

#: The pattern that _FAST and the pool of chunks stand for; texts are split as a whole by any other.
OWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where a text has only these characters, the classes of the pattern below agree with Unicode's \p{L}, \p{N} and white space.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ɏ]*")
_FAST = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")


class PairTable:
    """(left, right) -> rank, by linear probing in arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(len(rank) * 3).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        rest = np.arange(len(key))
        at = self._hash(key)
        while len(rest):
            free = self.key[at] == -1
            first = np.zeros(len(rest), bool)
            first[np.unique(at[free], return_index=True)[1]] = True  # places among the free ones, one claimant each
            take = np.flatnonzero(free)[first[: free.sum()]]
            self.key[at[take]], self.value[at[take]] = key[rest[take]], rank[rest[take]]
            keep = np.ones(len(rest), bool)
            keep[take] = False
            rest, at = rest[keep], (at[keep] + 1) & ((1 << self.bits) - 1)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(key.shape, NONE, np.int32)
        flat, res = key.ravel(), out.ravel()
        rest, at = np.arange(flat.size), self._hash(flat)
        while len(rest):
            found = self.key[at]
            hit = found == flat[rest]
            res[rest[hit]] = self.value[at[hit]]
            go = ~hit & (found != -1)
            rest, at = rest[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return res.reshape(key.shape)


class Codec:
    """ranks: token bytes to ids; pattern: what splits a text, each match encoded apart."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        # the pattern's \s as Unicode's White_Space, which leaves out U+001C to U+001F
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.fast = pattern == OWN_PATTERN
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.pairs = PairTable(*(np.array(x, np.int64) for x in (left, right, rank)))
        self.joined = np.zeros(1 << 16, bool)
        for token in ranks:
            x = np.frombuffer(token, np.uint8).astype(np.int64)
            self.joined[x[:-1] << 8 | x[1:]] = True
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        by_id: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            by_id[r] = token
        self.token_size = np.array([len(x) for x in by_id], np.int64)
        self.token_start = np.concatenate([[0], np.cumsum(self.token_size)[:-1]])
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)
        self.pool = ChunkPool(self.encode_parts)

    def pre_tokens(self, text: str) -> list[str]:
        return _FAST.findall(text) if self.fast and _PLAIN.fullmatch(text) else self.split(text)

    def encode_parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has; their distinct pre-tokens are encoded together."""
        pre, counts, k = [], [], 0
        while k < len(texts):
            run = k
            while self.fast and run < min(len(texts), k + 512) and (t := texts[run])[:1] == " " and t[1:2] and not t[1].isspace() and not t[-1].isspace():
                run += 1
            if run > k:  # chunks that split alike when joined, as each but the first follows a character that isn't white space
                found = self.pre_tokens("".join(texts[k:run]))
                ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
                upto = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, texts[k:run]), np.int64, run - k))) + 1
                counts.append(np.diff(upto, prepend=0))
            else:
                found, run = self.pre_tokens(texts[k]), k + 1
                counts.append(np.array([len(found)]))
            pre += found
            k = run
        place = {t: i for i, t in enumerate(dict.fromkeys(pre))}
        flat, start, size = self.encode_tokens([t.encode("utf-8", "replace") for t in place])
        which = np.fromiter(map(place.__getitem__, pre), np.int64, len(pre))
        n = size[which]
        ends = np.cumsum(n)
        ids = flat[np.repeat(start[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(np.concatenate(counts))])] if counts else np.zeros(1, np.int64)
        return ids, np.diff(before)

    def encode_tokens(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pre-tokens in some order; the place of each one's first, and how many it has."""
        whole = np.fromiter((self.ranks.get(t, -1) for t in tokens), np.int64, len(tokens))
        start, size = np.arange(len(tokens)), np.ones(len(tokens), np.int64)
        rest = np.flatnonzero(whole < 0)
        if not len(rest):
            return whole.astype(np.int32), start, size
        ids, first, n = self._merged([tokens[i] for i in rest])
        start[rest], size[rest] = len(tokens) + first, n
        return np.concatenate([whole.astype(np.int32), ids]), start, size

    def _merged(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As encode_tokens, by merging alone, token after token."""
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        upto = np.cumsum([len(t) for t in tokens])
        cut = np.ones(len(raw) + 1, bool)  # before which bytes a row begins
        cut[1:-1] = ~self.joined[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        cut[upto] = True
        at = np.flatnonzero(cut)
        begin, length = at[:-1], np.diff(at)
        bucket = np.ceil(np.log2(length) * 2).astype(np.int64)
        start, size = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        flat, used = [], 0
        for b in np.unique(bucket):
            rows = np.flatnonzero(bucket == b)
            step = max(1, min(ROWS, CELLS // int(length[rows].max())))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                ids, n = self._merge(raw, begin[part], length[part])
                flat.append(ids)
                start[part], size[part] = used + np.cumsum(n) - n, n
                used += len(ids)
        ends = np.cumsum(size)
        ids = np.concatenate(flat)[np.repeat(start - ends + size, size) + np.arange(ends[-1])]
        done = np.concatenate([[0], ends])[np.searchsorted(begin, np.concatenate([[0], upto]))]
        return ids, done[:-1], np.diff(done)

    def _merge(self, raw: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows of n bytes from begin on, one row after the other, and how many each has."""
        width = int(n.max())
        cols = np.arange(width)[None, :]
        ids = self.byte[raw[np.minimum(begin[:, None] + cols, len(raw) - 1)]]
        rank = np.full(ids.shape, NONE)
        has = cols[:, 1:] < n[:, None]
        rank[:, :-1][has] = self.pairs.get(ids[:, :-1][has], ids[:, 1:][has])
        live, n = np.arange(len(n)), n.astype(np.int64)
        done_ids, done_row, done_n = [], [], n.copy()
        while len(live):
            best = rank.min(axis=1)
            over = best == NONE
            if over.any():
                inside = cols[:, : ids.shape[1]] < n[over][:, None]
                done_ids.append(ids[over][inside])
                done_row.append(np.repeat(live[over], n[over]))
                done_n[live[over]] = n[over]
                live, ids, rank, n, best = live[~over], ids[~over], rank[~over], n[~over], best[~over]
                if not len(live):
                    break
            here = cols[:, : ids.shape[1]]
            hit = rank == best[:, None]
            before = np.maximum.accumulate(np.where(hit, -1, here), axis=1)
            hit &= (here - before) % 2 == 1  # of overlapping pairs every other one, from the left
            once = self._between(ids, hit, best)
            out = self._closed(ids, rank, n, best, hit)
            once |= out[3]
            if once.any():  # a merge makes a pair that comes before the row's others: only the leftmost merges
                hit[once] &= hit[once].cumsum(axis=1) == 1
                out = self._closed(ids, rank, n, best, hit)
            ids, rank, n, _ = out
        row = np.concatenate(done_row)
        return np.concatenate(done_ids)[np.argsort(row, kind="stable")], done_n

    def _between(self, ids: np.ndarray, hit: np.ndarray, best: np.ndarray) -> np.ndarray:
        """The rows in which a merge is followed by the next one's first id at once, and the two make a pair of no higher rank."""
        out = np.zeros(len(ids), bool)
        row, col = np.nonzero(hit[:, :-2] & hit[:, 2:])
        out[row[self.pairs.get(best[row], ids[row, col + 2]) <= best[row]]] = True
        return out

    def _closed(self, ids: np.ndarray, rank: np.ndarray, n: np.ndarray, best: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, ranks and lengths after the pairs at hit have merged, and the rows where a new pair's rank is no higher than theirs."""
        cols = np.arange(ids.shape[1])[None, :]
        keep = cols < n[:, None]
        keep[:, 1:] &= ~hit[:, :-1]
        merged = np.where(hit, best[:, None], ids)
        n = keep.sum(axis=1)
        valid = cols[:, : int(n.max())] < n[:, None]
        new_ids, new_rank, made = np.zeros(valid.shape, np.int32), np.full(valid.shape, NONE), np.zeros(valid.shape, bool)
        new_ids[valid], new_rank[valid], made[valid] = merged[keep], rank[keep], hit[keep]
        again = made.copy()
        again[:, :-1] |= made[:, 1:]
        new_rank[again] = NONE
        again[:, :-1] &= valid[:, 1:]
        again[:, -1] = False
        row, col = np.nonzero(again)
        new_rank[row, col] = found = self.pairs.get(new_ids[row, col], new_ids[row, col + 1])
        lower = np.zeros(len(n), bool)
        lower[row[found <= best[row]]] = True
        return new_ids, new_rank, n, lower

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the places of each text's first (and, at last, the end)."""
        if self.fast:
            return self.pool.ids(texts)
        ids, n = self.encode_parts(texts)
        return ids, np.concatenate([[0], np.cumsum(n)])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        size = self.token_size[ids]
        ends = np.cumsum(size)
        return self.blob[np.repeat(self.token_start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Codec(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with an array of ids; a null text is empty, an empty text has no ids, other columns stay (one named `to`, in any case of letters, is replaced)."""
    schema = docs.drop(to).withColumn(to, _ints()).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            for i, j in slices(texts):
                ids, at = c.encode([t or "" for t in texts[i:j]])
                part = b.slice(i, j - i)
                kept = [(f.name, part.column(k)) for k, f in enumerate(b.schema) if f.name.lower() != to.lower()]
                yield pa.RecordBatch.from_arrays([x for _, x in kept] + [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], names=[n for n, _ in kept] + [to])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """rows with the bytes of an array of ids; a null array has none."""
    from pyspark.sql import functions as F

    schema = rows.drop(to).withColumn(to, F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            values = [c.decode(np.array(x or [], np.int64)).tobytes() for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            kept = [(f.name, b.column(k)) for k, f in enumerate(b.schema) if f.name.lower() != to.lower()]
            yield pa.RecordBatch.from_arrays([x for _, x in kept] + [pa.array(values, pa.binary())], names=[n for n, _ in kept] + [to])

    return rows.mapInArrow(run, schema)


def _ints():
    from pyspark.sql import functions as F

    return F.array().cast("array<int>")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """For each row of docs: doc_id, n_tokens, ids_sha256 (of decimal ids joined by spaces) and decoded_sha256 (of the bytes that the ids decode to).

    Whole texts are encoded, then decoded from their ids alone, batch by batch
    of about a million code points, so that ids needn't leave the worker.  A
    null text is empty; null and repeated doc_ids stay; an empty table gives an
    empty result; columns other than doc_id and text aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        names = np.array([str(i) for i in range(len(c.token_size))], object)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                ids, at = c.encode([t or "" for t in texts[i:j]])
                data = c.decode(ids)
                ends = np.concatenate([[0], np.cumsum(c.token_size[ids])])
                said = names[ids].tolist()
                spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([hashlib.sha256(" ".join(said[x:y]).encode()).hexdigest() for x, y in spans]),
                        pa.array([hashlib.sha256(data[ends[x] : ends[y]]).hexdigest() for x, y in spans]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
