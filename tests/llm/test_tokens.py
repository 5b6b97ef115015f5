from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexora.llm import matrix_bpe, packing, queries
from lexora.llm.chunk_pool import ChunkPool
from tests.llm.conftest import texts

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
LETTERS = "ab cd  \n\n\t'sé中文🎉12²Ⅷ\x1c\x85\u3000 _-!?<|endoftext|>ẞßthTHe\0"


def made(n):
    r = random.Random(4)
    fixed = ["", " ", "  ", "a", " a", "a ", "\0", "\0 \0a \0", "a  b", "a\n b", "a \nb  ", "x" * 300 + "y " + "ab" * 400, " " * 300, "\n" * 50 + " a", "don't I'll  they're", "<|endoftext|> x", "ab" * 3000]
    return fixed + ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_codec_is_tiktoken():
    c = matrix_bpe.Codec(RANKS, P.PATTERN)
    all_ = made(2000)
    ids, at = c.encode(all_)
    for i, t in enumerate(all_):
        got = ids[at[i] : at[i + 1]]
        assert got.tolist() == TIKTOKEN.encode_ordinary(t)
        assert c.decode(got).tobytes() == t.encode()


def test_merges_need_not_rise():
    """Ranks whose merges make pairs of lower rank than their own: still the leftmost pair of minimum rank each round."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"bc": 299, b"abc": 256, b"aa": 270, b"aaaa": 260, b"ca": 290, b"bca": 258}
    own, c = tiktoken.Encoding("x", pat_str=r"[a-z]+|[^a-z]+", mergeable_ranks=ranks, special_tokens={}), matrix_bpe.Codec(ranks, r"[a-z]+|[^a-z]+")
    r = random.Random(1)
    for n in (5, 40, 400):
        t = "".join(r.choice("abc") for _ in range(n))
        assert c.encode([t])[0].tolist() == own.encode_ordinary(t)


def test_pool_survives_being_emptied():
    c = matrix_bpe.Codec(RANKS, P.PATTERN)
    for c.pool in (ChunkPool(c.encode_parts, most=5), ChunkPool(c.encode_parts, most_held=100)):
        for t in made(100):
            assert c.encode([t, t])[0].tolist() == 2 * TIKTOKEN.encode_ordinary(t)


def test_long_pre_tokens_are_merged_in_matrices():
    """Pre-tokens of any length: equal characters, letters without spaces, letters of many alphabets, marks."""
    c, r = matrix_bpe.Codec(RANKS, P.PATTERN), random.Random(8)
    for letters, n in (("a", 100_000), ("ab", 30_000), ("etaoinshrdlu", 20_000), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 20_000), ("中文字é🎉", 5000), ("=-#*", 20_000), (" ", 70_000), ("\n", 4097)):
        t = "".join(r.choice(letters) for _ in range(n))
        ids, at = c.encode([t, "x", t[: n // 2]])
        assert ids[: at[1]].tolist() == TIKTOKEN.encode_ordinary(t) and ids[at[2] :].tolist() == TIKTOKEN.encode_ordinary(t[: n // 2])


def test_any_pattern_is_honoured():
    for pattern in (r"\S+|\s+", r"(?s).+", r"\p{L}+|[^\p{L}]+", P.PATTERN):
        c, own = matrix_bpe.Codec(RANKS, pattern), tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
        for t in made(150):
            ids, at = c.encode([t, t])
            assert ids[: at[1]].tolist() == own.encode_ordinary(t) == ids[at[1] :].tolist()


def test_tables(spark, odd, none):
    path = P.path("byte_bpe_50k.tiktoken")
    got = matrix_bpe.digests(odd, path, P.PATTERN).collect()
    want = []
    for i, t in texts():
        ids = TIKTOKEN.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    both = matrix_bpe.decode(matrix_bpe.encode(odd, path, P.PATTERN), path, P.PATTERN)
    assert both.columns == [*odd.columns, "ids", "decoded"] and all(bytes(r.decoded).decode() == (r.text or "") for r in both.collect())
    upper = odd.select("doc_id", "text", F.lit(1).alias("IDS"), F.lit(2).alias("Decoded"))
    both = matrix_bpe.decode(matrix_bpe.encode(upper, path, P.PATTERN), path, P.PATTERN)
    assert both.columns == ["doc_id", "text", "ids", "decoded"] and all(bytes(r.decoded).decode() == (r.text or "") for r in both.collect())
    assert matrix_bpe.digests(none, path, P.PATTERN).count() == 0 and matrix_bpe.encode(none, path, P.PATTERN).count() == 0


def test_query_op8(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op8_matrix_bpe(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = TIKTOKEN.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


# ---- packing


def test_first_fit_decreasing():
    r = random.Random(2)
    for n in (0, 1, 2, 7, 200):
        sizes = [r.randint(1, 50) for _ in range(n)]
        at, offset = packing.first_fit_decreasing(np.array(sizes, np.int64), 50)
        bins = []
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            k = next((k for k, b in enumerate(bins) if b + sizes[i] <= 50), len(bins))
            if k == len(bins):
                bins.append(0)
            assert (at[i], offset[i]) == (k, bins[k])
            bins[k] += sizes[i]


def test_ids_are_the_vocabularys():
    """The library as it comes, special tokens' strings included."""
    encode, t = packing.encoder(P.path("byte_bpe_50k.json"), P.PATTERN), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for x in [*made(500), "a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|>x", "<|endoftext|", "don<|endoftext|>'t  \n"]:
        assert list(encode(x)) == t.encode(x, add_special_tokens=False).ids
    assert list(encode("a<|endoftext|>b")) == [64, 50256, 65]


def library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda x: t.encode(x, add_special_tokens=False).ids


def packed_right(rows, docs, encode, length):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
    want = defaultdict(list)
    for i, t in docs:
        ids = np.array([*encode(t or ""), 1], "<u4")
        want[i] += [(s, len(x := ids[s : s + length]), zlib.crc32(x.tobytes()), len(ids)) for s in range(0, len(ids), length)]
    assert {k: sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    return sum(r.length for r in rows) / (len(sequences) * length)


def test_pack_tables(spark, odd, none):
    path = P.path("byte_bpe_50k.json")
    rows = packing.pack(odd, path, P.PATTERN, length=64, group=20).collect()
    packed_right(rows, texts(), library(), 64)
    again = packing.pack(odd.orderBy("x").repartition(5, "text"), path, P.PATTERN, length=64, group=20).collect()
    assert sorted(rows, key=str) == sorted(again, key=str)  # whatever the order of rows
    assert packing.pack(none, path, P.PATTERN).count() == 0


def test_query_op3(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op3_packing(spark, sf_dir).collect()
    assert packed_right(rows, docs, library(), 2048) > 0.97


def test_repeated_rows_are_spread_over_groups(spark):
    path = P.path("byte_bpe_50k.json")
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a few words that repeat").alias("text"))
    rows = packing.pack(df, path, P.PATTERN, length=64, group=100).collect()
    sizes = Counter(r.sequence_id >> 32 for r in rows)
    assert len(rows) == 3000 and len(sizes) == 30 and max(sizes.values()) < 200
