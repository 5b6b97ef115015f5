"""Queries that read whole texts and all runs, by brute force on small tables."""

from __future__ import annotations

import random
import re
from collections import Counter
from urllib.parse import quote

from pyspark.sql import functions as F

from lexora import plans
from lexora.constants import QUERY_KEPT
from lexora.functions.arrays import starts
from lexora.operators import segment


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_whole_texts_are_encoded(spark, tmp_path):
    texts = {1: "", 2: "a" * 199 + " $`\\\r&\u00e9" + "tail + \u4e2d" * 99, 3: "short /?*~", 4: None, 5: "\U0001f389" * 201}
    sf_dir = documents(spark, tmp_path, [(i, t, "en") for i, t in texts.items()])
    got = {r.doc_id: (r.encoded, r.quoted) for r in plans.queries()["encoded_texts"](spark, sf_dir).collect()}
    escaped = str.maketrans({"\\": "\\\\", "`": "\\`", "$": "\\$", "\r": ""})
    want = {i: (None, None) if t is None else (quote(t, safe=QUERY_KEPT).replace("~", "~" if "~" in QUERY_KEPT else "%7E"), t.translate(escaped)) for i, t in texts.items()}
    assert got == want


def best(run, words):
    """The tokens of the best path and twice its score; ties go to the longest last word."""
    paths = [(0, [])]
    for j in range(1, len(run) + 1):
        each = []
        for i in range(max(0, j - 6), j):
            piece = run[i:j]
            if j - i == 1 or piece in words:
                each.append((paths[i][0] + (3 * (j - i) if j - i > 1 else -1 if piece in words else -4), -i))
        score, i = max(each)
        paths.append((score, [*paths[-i][1], run[-i:j]]))
    return paths[-1]


def test_all_runs_are_segmented(spark, tmp_path):
    common = "an ther tion ble s la"
    rows = [(1, f"{common} " * 25, "en"), (2, f"{common} kurz " * 25 + "thertionbleanlathertionble x", "de"), (3, "thertion " + "anther" * 40 + "q", "fr"), (4, None, "es"), (5, "ANTHER bleu9tions \u00e9tion", None), (6, "", "en")]
    sf_dir = documents(spark, tmp_path, rows)
    freq = Counter(x for _, t, _ in rows for x in re.findall("[a-z]+", t or ""))
    words = {w for w, n in freq.items() if len(w) <= 6 and n >= 20}
    assert "kurz" in words and max(map(len, freq)) > 200 and min(map(len, freq)) == 1
    want = {run: best(run, words) for run in freq}
    q = {k: f(spark, sf_dir).collect() for k, f in plans.queries().items() if k in ("segment_latin", "word_frequency_of_segments", "word_offsets", "segment_edges", "word_wrapping")}
    assert {r.run: (r.score2, r.segmented.split("\u00b7")) for r in q["segment_latin"]} == want and len(q["segment_latin"]) == len(want)
    assert Counter({r.word: r.n for r in q["word_frequency_of_segments"]}) == Counter(w for _, tokens in want.values() for w in tokens)
    offsets = {(r.run, r.word_no): (r.word, r.start, r.end) for r in q["word_offsets"]}
    assert offsets == {(run, k): (w, len("".join(tokens[:k])), len("".join(tokens[: k + 1]))) for run, (_, tokens) in want.items() for k, w in enumerate(tokens)}
    edges = {(r.run, r.i, r.j) for r in q["segment_edges"]}
    assert edges == {(x, i, j) for x in freq for i in range(len(x)) for j in range(i + 1, min(len(x), i + 6) + 1) if j == i + 1 or x[i:j] in words}
    wrapping = {r.run: (r.words, r.rest) for r in q["word_wrapping"]}
    assert wrapping.keys() == freq.keys()
    assert all(w.replace("|", "") + rest == run for run, (w, rest) in wrapping.items()) and wrapping["thertion"] == ("the|rt", "ion") and wrapping["s"] == ("", "s")


def test_long_runs(spark):
    """Runs of many stretches against the plain recurrence; a run of a million characters comes back whole."""
    r = random.Random(6)
    words = {"ab", "ba", "aba", "abab", "cc", "c", "abcabc", "bcabca", "aa", "aaaaaa"}
    runs = ["".join(r.choice("abc") for _ in range(n)) for n in (1, 255, 256, 257, 260, 261, 511, 513, 900, 2000)] + ["a" * 1030, "abc" * 700, "d" * 300, "\U00020000a" * 200]
    dictionary = spark.createDataFrame([(w,) for w in words], "word string")
    got = {x.run: (x.score2, x.tokens) for x in segment.segment(spark.createDataFrame([(x,) for x in [*runs, *runs, ""]], "run string"), dictionary).collect()}
    assert got == {x: best(x, words) for x in runs}
    spans = segment.word_spans(segment.segment(spark.createDataFrame([(runs[9],)], "run string"), dictionary), ["run"]).collect()
    assert sorted((x.word_no, x.word, x.start, x.end) for x in spans) == [(k, w, len("".join(got[runs[9]][1][:k])), len("".join(got[runs[9]][1][: k + 1]))) for k, w in enumerate(got[runs[9]][1])]
    long = "".join(r.choice("abc") for _ in range(1_000_000))
    x = segment.segment(spark.createDataFrame([(long,)], "run string"), dictionary).first()
    assert x.run == long and all(len(t) == 1 or t in words for t in x.tokens) and x.score2 == best_score(long, words)


def best_score(run, words):
    scores = [0]
    for j in range(1, len(run) + 1):
        scores.append(max(scores[i] + (3 * (j - i) if j - i > 1 else -1 if run[i:j] in words else -4) for i in range(max(0, j - 6), j) if j - i == 1 or run[i:j] in words))
    return scores[-1]


def test_starts(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        lengths = [k % 7 for k in range(n)]
        df = spark.createDataFrame([(lengths,)], "x array<int>")
        assert df.select(starts(F.col("x"))).first()[0] == [sum(lengths[:k]) for k in range(n)]
