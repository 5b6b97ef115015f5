"""The URL models against plain Markov models over all grams, on tables and on whole results."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexora.llm import queries, url_models
from tests.llm.test_archives_and_urls import parts, rule


def grams(seen):
    x = "\x02" * 4 + seen + "\x03"
    return [x[i : i + 5] for i in range(len(x) - 4)]


def brute(urls, scored=()):
    """The mean log ratio of the characters of each URL of (seen, bad) and of scored; bad of None adds no counts."""
    count = {True: Counter(), False: Counter()}
    for seen, bad in urls:
        if bad is not None:
            count[bad].update(grams(seen))
    by, context = ({b: Counter() for b in count} for _ in range(2))
    for b, c in count.items():
        for g, n in c.items():
            for k in range(1, 6):
                by[b][g[-k:]] += n
                context[b][k, g[-k:][:-1]] += n
    total = {b: sum(c.values()) for b, c in count.items()}

    def p(b, g):
        out = (by[b][g[-1]] + 1) / (total[b] + 256)
        for k in range(2, 6):
            out = (by[b][g[-k:]] + 4 * out) / (context[b][k, g[-k:][:-1]] + 4)
        return out

    return {seen: sum(math.log(p(True, g) / p(False, g)) for g in grams(seen)) / len(grams(seen)) for seen in {*(u for u, _ in urls), *scored} if seen}


def limit_of(scored):
    """The middle of the best thresholds, a multiple of 0.02, for (score, bad)."""
    r, a = (sum(bad == b for _, bad in scored) for b in (True, False))
    if not r or not a:
        return math.inf
    at = [(max(-300, min(300, math.floor(s / 0.02))), bad) for s, bad in scored]
    best = {b: sum(x >= b for x, bad in at if bad) / r - sum(x >= b for x, bad in at if not bad) / a for b in range(-300, 301)}
    fits = [b * 0.02 for b, x in best.items() if x >= max(best.values()) - 0.01 - 1e-9]
    return (min(fits) + max(fits)) / 2


def seen_of(url):
    if not url or "://" not in url:
        return url or ""
    at = url.index("://") + 3
    host, _ = parts(url)
    return url[:at] + host + url[at + len(host) :]


def judged_right(spark, rows, urls):
    """Rows of judge() against rules, models and calibration by hand."""
    held = {r.seen: r.out for r in spark.createDataFrame([(seen_of(u),) for u in {u for u in urls.values() if u}], "seen string").select("seen", url_models.held_out(F.col("seen")).alias("out")).collect()}
    known = {i: rule(*parts(u))[1] for i, u in urls.items()}
    seen = {i: seen_of(u) for i, u in urls.items()}
    bad = {i: None if known[i] is None else known[i] == "block" for i in urls}
    score = brute([(seen[i], None if bad[i] is None or held[seen[i]] else bad[i]) for i in urls if seen[i]])
    limit = limit_of([(score[seen[i]], bad[i]) for i in urls if bad[i] is not None and held[seen[i]]])
    if limit == math.inf:
        limit = limit_of([(score[seen[i]], bad[i]) for i in urls if bad[i] is not None])
    assert len(rows) == len(urls)
    for r in rows:
        s = score.get(seen[r.page_id])
        assert r.score == (None if s is None else pytest.approx(s, abs=1e-8))
        if s is None or abs(s - limit) > 1e-6:
            assert r.verdict == (known[r.page_id] or ("block" if s is not None and s >= limit else "allow"))
    return limit, score


def test_every_gram_is_kept(spark):
    r = random.Random(5)
    name = lambda parts: "".join(r.choice(parts) for _ in range(4))
    urls = {f"{name(['ther', 'tion', 'ble', 'an'])}.example.info/fr/a{i}/{'pages' * 4}": False for i in range(2000)}
    urls |= {f"casino-{name(['win', 'fun'])}.example.info/fr/b{i}/{'cards' * 4}": True for i in range(2000)}
    urls |= {"qzxvkj.example.info/wyq": False, "casino-jqxzk.example.info/xqy": True, "x": False, "nobody-counts-this.example": None}
    rows = [(i, u, bad) for i, (u, bad) in enumerate(urls.items())]
    df = spark.createDataFrame(rows, "id long, seen string, bad boolean").repartition(3)
    got = {x.id: x.score for x in url_models.score(df, url_models.train(df)).collect()}
    want = brute(urls.items())
    assert len(got) == len(rows)
    for i, u, _ in rows:
        assert got[i] == pytest.approx(want[u], abs=1e-8)


def test_verdicts_are_the_models(spark):
    """Rules decide some hosts' URLs; what the models learn there decides others with paths alike."""
    r = random.Random(3)
    word = lambda xs: "".join(r.choice(xs) for _ in range(3))
    fine, foul = ["ther", "tion", "ble", "an"], ["casino", "win", "poker", "fun"]
    urls = [f"http://a{i}.net/de/{word(fine)}/{word(fine)}" for i in range(150)] + [f"http://b{i}.org/es/{word(foul)}/{word(foul)}" for i in range(150)]
    urls += [f"http://c.info/{word(fine)}/{word(fine)}" for _ in range(40)] + [f"http://c.info/{word(foul)}/{word(foul)}?{word(foul)}" for _ in range(40)]
    urls += ["", None, "no scheme", f"{word(foul)}.{word(foul)}/{word(foul)}", "://", "http://x/" + "casinowin" * 3000, "HTTP://C.INFO/\n/\u4e2d"]
    of = dict(enumerate(urls))
    rows = url_models.judge(spark.createDataFrame(list(of.items()), "page_id long, url string")).collect()
    limit, _ = judged_right(spark, rows, of)
    got = {x.page_id: x.verdict for x in rows}
    assert limit < math.inf and [got[i] for i in range(300, 380)] == ["allow"] * 40 + ["block"] * 40 and got[383] == got[385] == "block"
    assert [got[i] for i in (380, 381)] == ["allow"] * 2
    only = url_models.judge(spark.createDataFrame([(i, u) for i, u in of.items() if i < 150 or i >= 300], "page_id long, url string"))
    assert only.where("verdict = 'block'").count() == 0


def test_repeated_rows_stay(spark):
    rows = [(None, "http://a.net/de/x")] * 900 + [(1, "http://b.org/es/y")] * 900 + [(2, None)] * 5 + [(3, "http://b.info/es/y")] * 40
    got = Counter((x.page_id, x.verdict) for x in url_models.judge(spark.createDataFrame(rows, "page_id long, url string")).collect())
    assert {k: n for (k, _), n in got.items()} == {None: 900, 1: 900, 2: 5, 3: 40} and got[None, "allow"] == got[1, "block"] == 900


def test_query_op2_whole_table(spark, sf_dir):
    of = {x.page_id: x.url for x in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    judged_right(spark, queries.op2_url_models(spark, sf_dir).collect(), of)


def test_scored_text(spark):
    urls = ["HTTP://Ab.C/P?Q#R", "x://A?B://C", "No Scheme/Q?r", "://", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [x[0] for x in df.select(url_models.scored_text(df["url"])).collect()] == ["HTTP://ab.c/P?Q#R", "x://a?B://C", "No Scheme/Q?r", "://", "", ""] == [seen_of(u) for u in urls]
