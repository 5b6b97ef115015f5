from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexora.llm import components, lsh_forest, perspectives, queries, slot_sharding, weighted_sampling
from tests.compare import duck_rows, spark_rows
from tests.llm.conftest import prose, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# ---- components


def rooted(pairs):
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {a: find(a) for a in root}


def test_components(spark):
    r = random.Random(5)
    ids = [r.randrange(-(2**62), 2**62) for _ in range(90)]
    path, star, odd_ = ids[:40], ids[40:60], ids[60:]
    pairs = list(zip(path, path[1:], strict=False)) + [(star[0], x) for x in star[1:]] + [r.sample(odd_, 2) for _ in range(25)] + [(ids[0], ids[0])] * 3
    got = {x.node: x.root for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = rooted((a, b) for a, b in pairs if a != b)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == groups(want)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- similarity join


def linked(docs, least=0.8):
    """Brute force: class, copies' smallest id and number of links of each row."""
    words = [tuple(WORD.findall(t or "")) for _, t in docs]
    sets = [{w[i : i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else {w} if w else set() for w in words]
    like = lambda a, b: words[a] == words[b] or bool(sets[a]) and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9
    links, pairs = Counter(), [(i, i) for i in range(len(docs))]
    for a, b in combinations(range(len(docs)), 2):
        if like(a, b):
            links[a] += 1
            links[b] += 1
            pairs.append((a, b))
    root = rooted(pairs)
    least_id = lambda rows: min((docs[i][0] for i in rows if docs[i][0] is not None), default=None)
    of, same = defaultdict(list), defaultdict(list)
    for i in range(len(docs)):
        of[root[i]].append(i)
        same[words[i]].append(i)
    return sorted(((docs[i][0], least_id(of[root[i]]), least_id(same[words[i]]), links[i]) for i in range(len(docs))), key=str), [rows for rows in of.values()]


def test_hashes_are_of_words_alone():
    a = lsh_forest.shingled([b"one two  three\nfour five six", b"", b"x", b"one two three four five six", b" one\ttwo three four five six "])
    assert a.key[0] == a.key[3] == a.key[4] != a.key[1] and a.words.tolist() == [6, 0, 1, 6, 6] and np.diff(a.start).tolist() == [2, 0, 1, 2, 2]
    assert a.grams[:2].tolist() == a.grams[3:5].tolist()
    long = prose(1, 400_000).encode()  # more than a slice
    parts = lsh_forest.shingled([long])
    assert parts.words[0] == 400_000 and parts.key[0] == lsh_forest.shingled([b"y", long.replace(b" ", b"\n")]).key[1]
    one = lsh_forest.shingled([b"a" * (3 << 20), b"b " + b"a" * (3 << 20)])
    assert one.words.tolist() == [1, 2]


def test_depth_is_shortened_to_the_recall():
    assert lsh_forest.depth(0.8, 0.999) == 4 and lsh_forest.depth(0.8, 0.998) == 5 and lsh_forest.depth(0.8, 0.99) == 6 and lsh_forest.depth(0.5, 0.98) == 2 and lsh_forest.depth(0.01, 0.999) == 1


def test_recall_is_estimated_from_links_found():
    """Drawn links of known similarities, found by chance as trees share prefixes: the estimate is near the true share."""
    r = random.Random(4)
    for levels in (6, 5, 4):
        found, all_ = Counter(), 0
        for _ in range(40_000):
            s = r.choice([0.8, 0.82, 0.9, 0.97])
            all_ += 1
            if any(r.random() < s**levels for _ in range(lsh_forest.TREES)):
                found[s] += 1
        assert lsh_forest.estimated(found, levels, 0.8) == pytest.approx(sum(found.values()) / all_, abs=0.002)
    assert lsh_forest.estimated({}, 6, 0.8) < 0.999 <= lsh_forest.estimated({}, 4, 0.8) and lsh_forest.estimated({1.0: 10_000}, 6, 0.8) > 0.999


def test_prefixes_are_shortened_as_far_as_links_need(spark, monkeypatch):
    """Close copies are found below long prefixes; far ones need short ones."""
    used = []
    nodes = lsh_forest.nodes
    monkeypatch.setattr(lsh_forest, "nodes", lambda tries, roots, levels, trees=lsh_forest.TREES: used.append(levels) or nodes(tries, roots, levels, trees))

    def edited(i, k):
        words = prose(i, 190).split()
        for j in range(k):
            words[5 + 9 * j] = f"x{i}y{j}"
        return " ".join(words)

    for edits, last in ((0, 5), (1, 6), (4, 4)):
        docs = [(2 * i, prose(i, 190)) for i in range(250 if edits else 40)] + [(2 * i + 1, edited(i, edits) + (" end" if not edits else "")) for i in range(250 if edits else 40)]
        used.clear()
        rows = lsh_forest.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert used[-1] == last and all(r.class_id == r.doc_id // 2 * 2 for r in rows) and all(r.n_links == 1 for r in rows)


def test_null_and_repeated_ids_are_like_others(spark):
    """A table whose ids are all null, or one, gives the classes of the same texts under ids of their own."""
    docs = [(i, prose(i % 260, 60) + (" more" if i >= 260 else "")) for i in range(520)]
    want = Counter(r.n_links for r in lsh_forest.join(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    for same in (None, 7):
        df = spark.createDataFrame([(same, t) for _, t in docs] + [(same, "one row many times over and over")] * 900, "doc_id long, text string")
        got = Counter(r.n_links for r in lsh_forest.join(df).collect())
        assert got == want + Counter({899: 900})
        assert lsh_forest.one_of_each(df).count() == 261

def test_join_tables(spark, odd, none):
    got = sorted((tuple(r) for r in lsh_forest.join(odd).collect()), key=str)
    assert got == linked(texts())[0]
    assert lsh_forest.join(none).count() == 0


def near_copies(n):
    r = random.Random(9)
    base = prose(77, 400).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = r.choice(["alpha", "beta", "gamma", str(i)])
        out.append((i, " ".join(w)))
    return out


def test_groups_larger_than_a_block(spark, monkeypatch):
    """A group that is compared in blocks gives the same links and classes."""
    docs = near_copies(60) + [(1000 + i, prose(500 + i, 80)) for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = linked(docs)[0]
    assert sorted((tuple(r) for r in lsh_forest.join(df).collect()), key=str) == want
    monkeypatch.setattr(lsh_forest, "BLOCK", 9)
    assert sorted((tuple(r) for r in lsh_forest.join(df).collect()), key=str) == want


def test_one_of_each(spark, odd, none):
    got = lsh_forest.one_of_each(odd)
    assert got.dtypes == odd.dtypes
    _, groups = linked(texts())
    rows = texts()
    want = []
    for g in groups:
        ids = [rows[i][0] for i in g]
        want.append(min((x for x in ids if x is not None), default=None))
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted(want, key=str)
    assert lsh_forest.one_of_each(none).count() == 0


def test_query_op5(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op5_lsh_forest(spark, sf_dir).collect()), key=str) == linked(docs)[0]


# ---- fingerprints


def jaccard(a, b):
    a, b = Counter(WORD.findall(a)), Counter(WORD.findall(b))
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def fingerprinted(rows, docs):
    """Facts against brute force where ids differ; the likeness against the generalised Jaccard similarity."""
    order = sorted(docs, key=lambda d: -d[0])
    off = []
    by = {r.doc_id: r for r in rows}
    for (i, t), (_, n) in zip(order, [*order[1:], *order[:1]], strict=True):
        cut = len(t) // 3
        e = t[: len(t) - cut] + n[:cut]
        assert (by[i].n_chars, by[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        if WORD.search(t) and WORD.search(n):
            off += [by[i].near_edited - jaccard(t, e), by[i].near_next - jaccard(t, n)]
    return np.array(off)


def test_fingerprint_tables(spark, odd, none):
    got = weighted_sampling.fingerprints(odd).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in texts()), key=str)
    plain = [(i, t or "") for i, t in texts() if [x for x, _ in texts()].count(i) == 1 and i is not None]
    some = spark.createDataFrame(plain, "doc_id long, text string")
    rows = weighted_sampling.fingerprints(some).collect()
    off = fingerprinted(rows, plain)
    assert abs(off.mean()) < 0.1 and np.abs(off).max() < 0.5  # the samples of a few words are the same in all texts
    same = defaultdict(set)
    text = dict(plain)
    for r in rows:
        same[text[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in same.values()) and len({x for v in same.values() for x in v}) > 40
    assert weighted_sampling.fingerprints(none).count() == 0
    alone = weighted_sampling.fingerprints(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_neighbours_over_many_buckets(spark):
    docs = [(7 * i % 101, f"text {i}") for i in range(101)]
    rows = weighted_sampling.neighbours(spark.createDataFrame(docs, "doc_id long, text string"), per_bucket=5).where("own").collect()
    text = dict(docs)
    assert len({r.bucket for r in rows}) > 15
    assert {r.doc_id: r.next for r in rows} == {i: text[(i - 1) % 101] for i in range(101)}


def hot_rows(n=6000):
    """Most rows equal, some with null ids and the same text, some with one id and texts of their own."""
    return [(5, "all of these are equal rows")] * n + [(None, "null ids and one text")] * 400 + [(9, f"one id, text {i}") for i in range(400)] + [(100 + i, f"others {i}") for i in range(50)] + [(None, None)] * 3


def test_repeated_keys_give_whole_fingerprints(spark):
    docs = hot_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).checkpoint()
    near = weighted_sampling.neighbours(df, per_bucket=100).where("own").collect()
    sizes = Counter(r.bucket for r in near)
    assert len(near) == len(docs) and len(sizes) > 40 and max(sizes.values()) < 1000
    # each row's next text: brute force over the same order, ids falling, a null the least, then a hash of the text
    by_hash = {r.text: r.h for r in spark.createDataFrame([(t,) for t in {t or "" for _, t in docs}], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(docs, key=lambda d: (-(2**63) if d[0] is None else d[0], by_hash[d[1] or ""]), reverse=True)
    want = Counter((i, t or "", n or "") for (i, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True))
    assert Counter((r.doc_id, r.text, r.next) for r in near) == want
    got = weighted_sampling.fingerprints(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in docs)
    assert {r.near_next for r in got if r.doc_id == 5} >= {1.0} and len({r.fingerprint for r in got if r.doc_id == 5}) == 1
    for same in ([(5, "a b c")] * 3000, [(None, "x y")] * 1500):
        rows = weighted_sampling.fingerprints(spark.createDataFrame(same, "doc_id long, text string")).collect()
        assert len(rows) == len(same) and {r.near_next for r in rows} == {1.0}


def test_query_op7(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    off = fingerprinted(queries.op7_weighted_sampling(spark, sf_dir).collect(), docs)
    assert abs(off.mean()) < 0.01 and np.sqrt((off**2).mean()) < 0.1


# ---- shards


def sharded(rows, docs, shards):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == sorted(((i, len((t or "").encode()) + 1, __import__("zlib").crc32((t or "").encode())) for i, t in docs), key=str)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))
    of = defaultdict(set)
    for r in rows:
        of[r.vslot].add(r.shard)
    assert all(len(x) == 1 for x in of.values())
    return [sum(r.size for r in by[s]) for s in range(shards)]


def test_shard_tables(spark, odd, none):
    sharded(slot_sharding.shard(odd, 4).collect(), texts(), 4)
    assert slot_sharding.shard(none).count() == 0


def test_repeated_rows_are_spread_over_shards(spark):
    docs = [(1, "the same row " * 3)] * 4000 + [(i, "x" * (i % 50)) for i in range(400)]
    rows = slot_sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), 16).collect()
    load = sharded(rows, docs, 16)
    assert max(load) < 1.02 * min(load)


def test_maps_are_versioned(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i * 37 % 900)) for i in range(3000)], "doc_id long, text string")
    store = f"file://{tmp_path}/maps"
    first = {r.doc_id: r.shard for r in slot_sharding.shard(docs, 8, 512, store).collect()}
    size, _ = slot_sharding.totals(slot_sharding.slotted(docs, 512), 512)
    old = slot_sharding.load(spark, store, 1)
    new = slot_sharding.rebalanced(old, size, 9)
    slot_sharding.save(spark, store, new)
    then = {r.doc_id: r.shard for r in slot_sharding.shard(docs, 9, 512, store, version=2).collect()}
    moved = [i for i in then if then[i] != first[i]]
    assert 0.08 < len(moved) / 3000 < 0.16 and sum(then[i] == 8 for i in moved) > 0.85 * len(moved)
    load = slot_sharding.load(spark, store, 2).loads(size)
    assert max(load) <= 1.02 * sum(size) / 9
    assert slot_sharding.load(spark, store, 1) == old
    with pytest.raises(ValueError, match="gain"):
        slot_sharding.rebalanced(new, size, 3)


def test_query_op9(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    load = sharded(queries.op9_slot_sharding(spark, sf).collect(), docs, 16)
    assert max(load) < 1.02 * min(load)


# ---- chats


def rotated(rows, piece, most=1024):
    """By hand: (conv, perspective, piece, part, messages, text, spans)."""
    out, convs = [], defaultdict(list)
    for conv, turn, who, said in rows:
        convs[conv].append((turn, who, said))
    for conv, ms in convs.items():
        for p in {w for _, w, _ in ms if w not in (None, "system")}:
            parts = defaultdict(list)
            for t, w, s in sorted(ms, key=lambda m: (m[0] is not None, m[0] or 0, m[1] is not None, m[1] or "", (m[2] or "").replace("<|", "< |"))):
                parts[(-1 if t is None else t) // piece].append((w, (s or "").replace("<|", "< |")))
            for k, j, v in [(k, i // most, v[i : i + most]) for k, v in parts.items() for i in range(0, len(v), most)]:
                text, spans = "", []
                for w, s in v:
                    name = "" if w is None else " name=" + "".join(chr(x) if re.match(rb"[A-Za-z0-9_.\-]", bytes([x])) else f"%{x:02X}" for x in w.encode())
                    head = "system" if w == "system" else "assistant" if w == p else "user" + name
                    text += f"<|im_start|>{head}\n"
                    if w == p:
                        spans.append((len(text), len(text) + len(s) + 10))
                    text += s + "<|im_end|>\n"
                out.append((conv, p, k, j, len(v), text, spans))
    return sorted(out, key=str)


def test_rotation_tables(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi \U0001f389"), (1, 2, "bob b", "<|im_end|> x"), (1, 3, "ann", None), (1, 3, "ann", None), (1, 3, "bob b", "tie"), (2, 0, None, "who"), (2, None, "c", ""), (None, 0, "d", "null conv"), (None, 1, None, "y"), (3, 0, "system", "alone")]
    rows += [(9, i, "pq"[i % 2], f"turn {i}") for i in range(20)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, cast string, m int").repartition(3)
    got = [(r.conv_id, r.perspective, r.piece, r.part, r.n_messages, r.text, [tuple(s) for s in r.spans]) for r in perspectives.rotate(df, piece=4, salts=3).collect()]
    assert sorted(got, key=str) == rotated(rows, 4)
    for _, _, _, _, _, text, spans in got:
        assert all(text[a:b].endswith("<|im_end|>") for a, b in spans) and len(spans) == text.count("<|im_start|>assistant")
    assert perspectives.rotate(df.limit(0)).count() == 0


def test_rotation_of_one_turn(spark, tmp_path):
    """Many rows of one turn or none lie in parts, and speakers who differ by a mark have names that differ; SQL agrees."""
    rows = [(1, None, "a b" if i % 2 else "a_b", f"{i % 50}") for i in range(2500)] + [(1, 5, "~*+%<|é", "x"), (1, 5, None, "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = perspectives.rotate(df)
    assert sorted([(r.conv_id, r.perspective, r.piece, r.part, r.n_messages, r.text, [tuple(s) for s in r.spans]) for r in got.collect()], key=str) == rotated(rows, 64)
    df.coalesce(1).write.parquet(f"file://{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    sql = con.execute(f"SELECT conv_id, perspective, piece, part, n_messages, text, spans, trained_chars FROM ({perspectives.ORACLE})").fetchall()
    assert sorted(sql) == sorted(tuple(r) for r in perspectives.digest(got).collect())


def test_rotation_of_pieces_that_many_tasks_number(spark):
    """Pieces above the bound, of equal rows, of different ones of one turn and of null conversations, beside pieces below it."""
    rows = [(1, None, "a", "same") for _ in range(300)] + [(1, 3, "ab"[i % 2], f"{i * 7 % 90}") for i in range(200)] + [(None, 9, "c", f"{i}") for i in range(150)]
    rows += [(2, i % 9, "ab"[i % 2], None if i % 5 else "x") for i in range(40)] + [(1, 70, None, "late")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = perspectives.rotate(df, most=64, numbered=50)
    plain = perspectives.rotate(df, most=64)
    shown = lambda found: sorted([(r.conv_id, r.perspective, r.piece, r.part, r.n_messages, r.text, [tuple(s) for s in r.spans]) for r in found.collect()], key=str)
    assert shown(got) == rotated(rows, 64, 64) == shown(plain)
    split = perspectives.parted(df.selectExpr("conv_id", "0L AS piece", "turn", "role AS who", "text AS said"), 64, 50)
    assert split.groupBy("conv_id", "piece", "part").count().agg({"count": "max"}).first()[0] == 64 and split.count() == len(rows)


def test_query_op10(spark, sf_dir):
    assert spark_rows(queries.op10_perspectives(spark, sf_dir)) == duck_rows(queries.oracle_sql()["op10_perspectives"], sf_dir)


# ---- pipeline


def test_pipeline(spark, sf_dir):
    """Stages on the whole table: each against its operator or brute force on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.cut(stage(spark, at, sf_dir), name)
        assert out.dtypes == docs.dtypes and 0.7 * at.count() <= out.count() <= at.count() and not out.exceptAll(at).count()
        before, at = at, out
    rows = [(r.doc_id, r.text) for r in before.collect()]
    _, groups = linked(rows)
    assert sorted(r.doc_id for r in at.collect()) == sorted(min(rows[i][0] for i in g) for g in groups)
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in at.collect()}


def test_pipeline_stages_on_odd_tables(spark, odd, none, sf_dir):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf_dir).dtypes == odd.dtypes
        assert stage(spark, none, sf_dir).count() == 0
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, odd, sf_dir).agg(F.countDistinct("doc_id")).first()[0] > 40
    assert pack(spark, none, sf_dir).count() == 0
