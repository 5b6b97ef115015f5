from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from lexora.llm.common import attach, each_copy, lowest


def test_lowest_is_bounded_and_the_same_each_time(spark):
    ids = spark.range(5000).select(F.col("id").alias("a"))
    some = [r.a for r in lowest(ids, ["a"], 100).collect()]
    assert len(set(some)) == 100 and some == [r.a for r in lowest(ids.repartition(7), ["a"], 100).collect()]
    assert lowest(ids.limit(30), ["a"], 100).count() == 30 and lowest(ids.limit(0), ["a"], 100).count() == 0


def test_attach_gives_each_row_its_groups_total(spark):
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"k{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = attach(df, ["k"], F.col("v"), [F.sum("v").alias("_t")], [F.sum("_t").alias("total")], salts=8).collect()
    want = Counter()
    for k, v in rows:
        want[k] += v
    assert sorted((r.k or "", r.v, r.total) for r in got) == sorted((k or "", v, want[k]) for k, v in rows)


def test_lowest_where_keys_repeat(spark):
    for rows in ([1] * 5000, [1] * 5000 + [2, 3], list(range(40)) * 100):
        some = lowest(spark.createDataFrame([(x,) for x in rows], "a long"), ["a"], 100).collect()
        assert len(some) == 100


def test_each_copy_numbers_equal_rows(spark):
    rows = [(None, "a")] * 50 + [(1, None)] * 7 + [(1, "b")]
    got = each_copy(spark.createDataFrame(rows, "k long, v string"), "i", chunk=8).collect()
    assert Counter(map(tuple, got)) == Counter((*r, i) for r, n in Counter(rows).items() for i in range(n))
    assert each_copy(spark.createDataFrame([], "k long, v string"), "i").count() == 0
