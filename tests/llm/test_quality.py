from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexora.llm import pairwise_quality, queries, rule_cascade
from tests.compare import duck_rows, spark_rows
from tests.llm.conftest import prose, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(t):
    t = t or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def test_measures(spark, odd, none):
    got = rule_cascade.judge(odd)
    assert set(odd.columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    rows = got.select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(rows) == len(texts())
    for r in rows:
        assert tuple(r[2:8]) == by_hand(r.text)
        assert not (r.kept and r.base_failed)
    assert rule_cascade.judge(none).count() == 0


def test_order_of_rules_leaves_verdicts(spark, odd):
    x, parts = rule_cascade.counted(odd.drop("n_words", "kept").withColumn("_hashes", F.lit(1)).withColumn("_Words", F.lit(2)))
    rules = rule_cascade.rules(parts)
    a = x.select(rule_cascade.cascade(rules).alias("v")).groupBy("v").count().collect()
    b = x.select(rule_cascade.cascade(rules[::-1]).alias("v")).groupBy("v").count().collect()
    assert sorted(a) == sorted(b) and all(r.v is not None for r in a)
    base = rule_cascade.base_rules()
    assert sorted(rule_cascade.ordered(odd.select("text"), base)) == sorted(r.name for r in [*base, *rules])


def test_order_is_by_rejections_per_second_of_what_is_left():
    rows = [(True, True, False, False)] * 6 + [(False, True, False, False)] * 2 + [(False, False, True, False)] * 3
    assert rule_cascade.greedy("abcd", [1.0, 2.0, 0.9, 0.1], rows) == ["a", "c", "b", "d"]  # after a, b rejects but 2 rows in 2 seconds; d none


def test_measured_costs(spark):
    df = spark.createDataFrame([(prose(i, 1500),) for i in range(300)], "text string").repartition(4).checkpoint()
    x, parts = rule_cascade.counted(df)
    every = [*rule_cascade.base_rules(), *rule_cascade.rules(parts)]
    seconds, rows = rule_cascade.costs(x, parts, every)
    by = dict(zip((r.name for r in every), seconds, strict=True))
    assert by["repeated_words"] > 3 * by["few_words"] and len(rows) == 300 and not any(map(any, rows))


def test_sample_is_of_all_partitions(spark):
    df = spark.createDataFrame([(f"{i % 8} " + "y" * (40_000 if i % 2 else 20),) for i in range(4000)], "text string").repartition(8, "text")
    got = rule_cascade.sampled(df, rows=400).collect()
    assert 300 < len(got) < 500 and len({r.text for r in got}) == 8
    assert rule_cascade.sampled(df.limit(5)).count() == 5


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, prose(1, 50), 7, 8, 9, 10)], "doc_id long, text string, _h int, _lines int, _WINDOWS int, _words int")
    got = rule_cascade.judge(df).first()
    assert (got._h, got._lines, got._WINDOWS, got._words, got.kept) == (7, 8, 9, 10, True)


def test_rules_keep_prose_and_drop_junk(spark):
    junk = ["THIS IS LOUD! " * 12 + prose(1, 3).upper(), " ".join(f"{w} |" for w in prose(2, 40).split()), " ".join(w + "***" for w in prose(3, 40).split()), "word " * 90]
    rows = [(i, prose(50 + i, 60 + i)) for i in range(20)] + [(100 + i, t) for i, t in enumerate(junk)]
    kept = {r.doc_id for r in rule_cascade.accepted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(20))


def test_accepted_keeps_columns(spark, odd, none):
    got = rule_cascade.accepted(odd)
    assert got.dtypes == odd.dtypes and got.count() > 20
    assert rule_cascade.accepted(none).count() == 0


def test_query_op6(spark, sf_dir):
    assert spark_rows(queries.op6_rule_cascade(spark, sf_dir)) == duck_rows(queries.oracle_sql()["op6_rule_cascade"], sf_dir)


# ---- classifier


def test_fit_ranks():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, len(pairwise_quality.NAMES)))
    y = (x[:, 3] - x[:, 5] + 0.1 * r.normal(size=500) > -0.8).astype(int)
    m = pairwise_quality.fit(x, y)
    s = m.score(x)
    assert ((s >= pairwise_quality.AT) == y).mean() > 0.95 and s.min() >= 0 and s.max() <= 1
    assert abs((s < pairwise_quality.AT).mean() - (y == 0).mean()) < 0.01
    for only in (np.ones(500, int), np.zeros(500, int)):
        assert pairwise_quality.fit(x, only).score(x).tolist() == pytest.approx([0.5] * 500)
    assert pairwise_quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == pytest.approx([0.5] * 2)


def test_loss_falls_to_its_least():
    """Newton's result against plain gradient descent on the same pairs."""
    r = np.random.default_rng(1)
    x = r.normal(size=(80, len(pairwise_quality.NAMES)))
    y = (x[:, 0] + r.normal(size=80) > 0).astype(int)
    m = pairwise_quality.fit(x, y, pairs=4000, seed=2)
    z = np.clip((x - m.mean) / m.scale, -8, 8)
    rng = np.random.default_rng(2)
    d = z[rng.choice(np.flatnonzero(y == 1), 4000)] - z[rng.choice(np.flatnonzero(y == 0), 4000)]
    w = np.zeros(x.shape[1])
    for _ in range(4000):
        w += 0.5 * (d.T @ (1 / (1 + np.exp(d @ w))) / 4000 - pairwise_quality.RIDGE * w)
    assert np.allclose(w, m.weight, atol=1e-3)


def test_classifier_tables(spark, odd, none):
    labels = spark.createDataFrame([(100 + i, i % 2, None) for i in range(20)] + [(None, 1, 0), (4, None, 0), (1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    got = pairwise_quality.classify(odd, labels).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in texts()), key=str)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert pairwise_quality.classify(none, labels).count() == 0
    assert {r.score for r in pairwise_quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    kept = pairwise_quality.accepted(odd, labels)
    assert kept.dtypes == odd.dtypes


def test_held_out_labels_are_not_read(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", __import__("pyspark").sql.functions.expr("IF(pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 5) = 0, 1 - quality, quality)"))
    a, b = (pairwise_quality.train(docs, x) for x in (labels, turned))
    assert np.array_equal(a.weight, b.weight) and a.threshold == b.threshold


def test_query_op4_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op4_pairwise_quality(spark, sf).collect()}
    held = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(held) > 40 and sum(q == g.predicted for q, g in held) / len(held) > 0.95
