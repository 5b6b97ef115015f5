"""Operators against rules stated by hand or by brute force."""

from __future__ import annotations

import itertools
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexora import fixtures
from lexora.functions import entries as fn
from lexora.functions.text import percent_encoded, runs, sentences, trimmed
from lexora.operators import catalog, extract, segment, share
from lexora.operators import events as ev

M = "我 他 在 的 大 学 生 学生 大学 大学生 生活 国 难 国难 家 毁 大义 不容 不 容 不容置疑 研究 研究生 生命 起源 命 中华人民共和国 中华 人民 共和国 共和".split()


def segmented(spark, texts, words):
    r = segment.segment(spark.createDataFrame([(t,) for t in texts], "run string"), spark.createDataFrame([(w,) for w in words], "word string"))
    return {x["run"]: (x["tokens"], x["score2"]) for x in r.collect()}


@pytest.mark.parametrize(("words", "cases"), [
    (M, {"我": (["我"], -1), "们": (["们"], -4), "纾纾": (["纾", "纾"], -8), "大学生": (["大学生"], 9), "大学生活": (["大学", "生活"], 12), "我在大学": (["我", "在", "大学"], 4),
         "研究生命起源": (["研究", "生命", "起源"], 18), "不容置疑": (["不容置疑"], 12), "毁家纾国难": (["毁", "家", "纾", "国难"], 0), "大义不容辞": (["大义", "不容", "辞"], 8), "中华人民共和国": (["中华", "人民", "共和国"], 21)}),
    (["ab", "cd", "abcd"], {"abcd": (["abcd"], 12)}),
    (["abc", "de", "ab", "cde"], {"abcde": (["ab", "cde"], 15)}),
])
def test_segment(spark, words, cases):
    assert segmented(spark, [*cases, ""], words) == cases


def best(text, words):
    """All cuts of a text; the best score."""
    def score(t):
        return (-1 if t in words else -4) if len(t) == 1 else 3 * len(t) if t in words and len(t) <= 6 else -10**6

    n = len(text)
    cuts = (c for k in range(n) for c in itertools.combinations(range(1, n), k))
    return max(sum(score(text[i:j]) for i, j in zip((0, *c), (*c, n), strict=True)) for c in cuts)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=12, unique=True), st.sets(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=12))
def test_segment_is_optimal(spark, texts, words):
    for text, (tokens, score2) in segmented(spark, texts, words).items():
        assert "".join(tokens) == text and score2 == best(text, words)
        assert all(len(t) == 1 or t in words for t in tokens)


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("s"))).collect()]


def test_pinyin(spark):
    cases = {"zhuang1": "zhuāng", "lu:4": "lǜ", "nv3": "nǚ", "An1": "An", "Ai4": "Aì", "r5": "r", "gou3": "gǒu", "xue2": "xué", "ma5": "ma", "gui4": "guì", "liu2": "liú", "abc": "abc", "m2": "m", "·": "·", "duo1": "duō", "E2": "E", "ou1": "ōu", "": ""}
    assert one(spark, fn.accented, *cases) == list(cases.values())


def test_fragments(spark):
    def said(s):
        return F.transform(fn.fragments(s), lambda f: F.concat(f["kind"], F.lit(":"), f["text"]))

    cases = {
        "variant of 樁|桩[zhuang1]": ["text:variant of", "link:樁/桩", "pinyin:zhuāng"], "個|个[ge4],位[wei4]": ["link:個/个", "pinyin:gè", "text:,", "link:位", "pinyin:wèi"],
        "old man [lao3 ren2] (polite)": ["text:old man", "pinyin:lǎo rén", "text:(polite)"], "see 女[nu:3]": ["text:see 女[nu:3]"], "plain": ["text:plain"],
    }
    assert one(spark, said, *cases) == list(cases.values())


def test_senses(spark):
    (got,) = one(spark, fn.senses, "/to hit; to beat/ /CL:個|个[ge4]/dozen/")
    assert [(r["glosses"], r["is_classifier"]) for r in got] == [(["to hit", "to beat"], False), (["個|个[ge4]"], True), (["dozen"], False)]


def test_sentences_and_runs(spark):
    assert one(spark, sentences, "你好。？！ 再 见!a.b", "他说：「好。」走了") == [["你好。", "？", "！", "再", "见!", "a.b"], ["他说：「好。", "」走了"]]
    assert one(spark, runs, "我a们们，在々〇x\U00020000中") == [["我", "们们", "在", "中"]]
    assert one(spark, trimmed, "　a b\u0085\n") == ["a b"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab。！?　 \n", max_size=12), min_size=1, max_size=30))
def test_sentences_hold_all_but_blanks(spark, texts):
    for text, got in zip(texts, one(spark, sentences, *texts), strict=True):
        assert "".join(got) == re.sub(r"[\s　]", "", text)
        assert all(re.fullmatch(r"[^。！?]*[。！?]?", s) for s in got)


def test_percent_encoding(spark):
    assert one(spark, percent_encoded, "a b&c+d~!*()/?:@=;,%#[]中") == ["a%20b&c+d~!*()/?:@=;,%25%23%5B%5D%E4%B8%AD"]


def test_links(spark):
    got = one(spark, share.linked, "lexora://entry?s=%E6%A1%A9&t=%E6%A8%81", "lexora://entry?s=a&t=", "lexora://entry?s=", "http://entry?s=a", "lexora://other?s=a", None)
    assert [g and tuple(g) for g in got] == [("樁", "桩"), ("a", "a"), None, None, None, None]


def test_share_empty(spark):
    row = spark.createDataFrame([("  ", " p ")], "text string, prompt string")
    got = row.select(*[x.alias(f"{k}{i}") for k, v in share.shared(F.col("text"), F.col("prompt")).items() for i, x in enumerate(v)]).first()
    assert (got["dictionary0"], got["dictionary1"], got["clipboard0"], got["chat0"]) == (None, None, None, "p")


def log(spark, *rows):
    return spark.createDataFrame([(1, round(t * 1e6), i, *x) for i, (t, *x) in enumerate(rows)], "user long, us long, event_id long" + ", kind string, word string, found boolean" * (len(rows[0]) > 1))


def test_throttle(spark):
    got = ev.throttled(log(spark, *[(t,) for t in (0.0, 0.3, 0.6, 0.9, 1.3)]), "user", 0.5)
    assert sorted(r["us"] for r in got.collect()) == [0, 600_000, 1_300_000]
    edge = ev.throttled(log(spark, (0.0,), (0.5,), (1.0,)), "user", 0.5)
    assert sorted(r["us"] for r in edge.collect()) == [0, 1_000_000]


def test_taps(spark):
    rows = log(spark, (1.0, "press", None, None), (1.05, "tap", None, None), (1.08, "tap", None, None), (1.3, "tap", None, None))
    got = ev.taps(rows, "user", F.col("kind") == "press", F.col("kind") == "tap", 0.1).orderBy("us").collect()
    assert [r["suppressed"] for r in got] == [True, False, False]


def test_navigation(spark):
    steps = [("open", "a", True), ("push", "b", True), ("open", "x", False), ("pop", None, None), ("pop", None, None), ("pop", None, None), ("open", "c", True), ("close", None, None), ("push", "z", False)]
    rows = log(spark, *[(i, *s) for i, s in enumerate(steps)])
    got = ev.navigation(rows, "user", F.col("kind"), F.col("word"), F.col("found")).orderBy("event_id").collect()
    assert [(r["depth"], r["top"], r["can_go_back"]) for r in got] == [(1, "a", False), (2, "b", True), (2, "b", True), (1, "a", False), (0, None, False), (0, None, False), (1, "c", False), (0, None, False), (0, None, False)]


def test_import_order(spark):
    batch = spark.createDataFrame([(str(i), "t", ["x"], c, "f", None, i) for i, c in enumerate(["A", "A", None, None, "B"])], catalog.BOOK)
    kept = catalog.listed(catalog.imported(None, batch)).orderBy(F.desc("import_seq")).collect()
    assert [r["id"] for r in kept] == ["4", "2", "0"]


def test_stores(spark, tmp_path):
    from lexora.sources import stores

    path = f"file://{tmp_path}/books"
    assert stores.restore(spark, path, catalog.BOOK).count() == 0
    rows = spark.createDataFrame([("1", None, [], None, "f", None, 1)], catalog.BOOK)
    stores.persist(rows, path)
    assert [tuple(r) for r in stores.restore(spark, path, catalog.BOOK).collect()] == [("1", None, [], None, "f", None, 1)]
    at = f"file://{tmp_path}/places"
    for batch in ([("a", 1, "x"), ("b", 1, "y")], [("a", 3, "z"), ("b", 0, "w")]):
        stores.upsert_latest(spark.createDataFrame(batch, "key string, us long, place string"), at, "key", ["us"])
    assert sorted(tuple(r) for r in stores.restore(spark, at, "key string, us long, place string").collect()) == [("a", 3, "z"), ("b", 1, "y")]
    (tmp_path / "lines.txt").write_text("# note\n樁 桩 [zhuang1] /stake; post/\nbad\n", encoding="utf-8")
    assert [tuple(r)[1:] for r in stores.dictionary_text(spark, f"file://{tmp_path}/lines.txt").collect()] == [("樁", "桩", "zhuang1", "/stake; post/")]
    (tmp_path / "res").mkdir()
    (tmp_path / "res/a.js").write_text("x\ny")
    names = spark.createDataFrame([("a.js",), ("b.css",)], "file string")
    got = stores.text_or_empty(names, stores.bundled(spark, f"file://{tmp_path}/res"))
    assert sorted(tuple(r) for r in got.collect()) == [("a.js", "x\ny"), ("b.css", "")]


def test_epub_files(spark, tmp_path):
    from lexora.sources import epub

    (tmp_path / "a.epub").write_bytes(epub.packed("T", ["A"], "id", [("One", "x"), ("Two", "y")], b"img"))
    (tmp_path / "b.epub").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_bytes(b"")
    of = epub.files(spark, f"file://{tmp_path}")
    got = {r["path"].rsplit("/", 1)[1]: (r["title"], r["authors"], r["canonical_id"], r["cover"] and bytes(r["cover"])) for r in epub.metadata(of).collect()}
    assert got == {"a.epub": ("T", ["A"], "id", b"img"), "b.epub": (None, [], None, None)}
    assert [r["title"] for r in epub.contents(of).orderBy("node_id").collect()] == ["One", "Two"]
    assert [r["href"] for r in epub.documents(of).orderBy("spine_no").collect()] == ["c0.xhtml", "c1.xhtml"]


def test_text_nodes(spark):
    html = "<body><p>a<b>b</b> &amp;<p>c<!-- x --><script>d</script></div> <td>e</td>"
    got = extract.text_nodes(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert [r["text"] for r in got] == ["a", "b", " &", "c", "e"]


def test_fixture_entries_are_parsed(spark):
    assert fixtures.dictionary(spark).count() == len(fixtures.ENTRIES)


def test_plans_are_pushed_down(spark, sf_dir):
    plan = segment.edges(*__import__("lexora.plans.texts", fromlist=["_latin"])._latin(spark, sf_dir))._jdf.queryExecution().toString()
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan and "BroadcastHashJoin" in plan
    placed = extract.placed_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], "latin")._jdf.queryExecution().toString()
    assert "Window" not in placed and "Exchange" not in placed and "ReadSchema: struct<doc_id:bigint,text:string>" in placed


def test_references(spark):
    pairs = [("&lt;b&gt; &amp;amp; &eacute;&#233;&#xE9;&#x1F389;", "<b> &amp; \u00e9\u00e9\u00e9\U0001f389"), ("&nosuch; &; &#; & &amp", "&nosuch; &; &#; & &amp"), ("&#0;&#xD800;&#99999999999;", "\ufffd" * 3), ("", ""), ("plain", "plain"), ("&NotEqualTilde;x", "\u2242\u0338x"), (None, None)]
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, s string").select("i", extract.decoded(F.col("s")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: b for i, (_, b) in enumerate(pairs)}


def test_a_half_written_version_is_not_in_force(spark, tmp_path):
    from lexora.sources import stores

    path = f"file://{tmp_path}/store"
    rows = lambda *x: spark.createDataFrame(list(x), "key string, us long, place string")
    stores.upsert_latest(rows(("a", 1, "p"), ("b", 1, "q")), path, "key", ["us"])
    (tmp_path / "store/version=1").mkdir()
    (tmp_path / "store/version=1/part-0.json").write_text('{"key": "x"')  # a crash before the commit
    read = lambda: sorted(tuple(r) for r in stores.restore(spark, path, "key string, us long, place string").collect())
    assert read() == [("a", 1, "p"), ("b", 1, "q")]
    for _ in range(2):  # the batch comes again
        stores.upsert_latest(rows(("a", 2, "r")), path, "key", ["us"])
        assert read() == [("a", 2, "r"), ("b", 1, "q")]
    assert len(list((tmp_path / "store").glob("version=*"))) == 2


def test_covers_are_written(spark, tmp_path):
    from lexora.sources import stores

    rows = spark.createDataFrame([("a.jpg", b"one"), ("b.jpg", None), ("c.jpg", b"three")], "name string, content binary")
    got = {r["name"]: r["error"] for r in stores.write_files(rows, f"file://{tmp_path}/covers").collect()}
    assert got["a.jpg"] is None and got["c.jpg"] is None and got["b.jpg"]
    assert sorted(p.name for p in (tmp_path / "covers").glob("*.jpg")) == ["a.jpg", "c.jpg"] and (tmp_path / "covers/c.jpg").read_bytes() == b"three"


def test_dictionary_of_a_database(spark, tmp_path):
    from lexora.sources import stores

    spark._jvm.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = "jdbc:derby:memory:words;create=true"
    rows = [("樁", "桩", "zhuang1", "/stake; post/"), ("長", "长", None, "/long/"), ("生", "生", "sheng1", "/raw/"), ("生", "生", "sheng1", "/raw/")]
    made = spark._jvm.java.sql.DriverManager.getConnection(url).createStatement()
    made.execute('CREATE TABLE entries ("trad" VARCHAR(100), "simp" VARCHAR(100), "pinyin" VARCHAR(100), "senses_raw" VARCHAR(1000))')
    made.execute("INSERT INTO entries VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in rows))
    got = stores.dictionary_jdbc(spark, url, "entries").collect()
    assert sorted(tuple(r)[1:] for r in got if r.pinyin) == sorted(r for r in rows if r[2]) and len(got) == 4
    assert len({r.entry_id for r in got}) == 3  # equal rows are one entry
    assert [r.simp for r in stores.dictionary_jdbc(spark, url, '(SELECT * FROM entries WHERE "simp" IS NOT NULL) AS e').where("simp = '桩'").collect()] == ["桩"]


def test_incoming(spark):
    m = spark.createDataFrame([("/x/b.epub", "B", ["Z"], "2", b"c"), ("/x/a.epub", None, [], None, None)], "path string, title string, authors array<string>, canonical_id string, cover binary")
    got = catalog.incoming(m, 5).orderBy("import_seq").collect()
    assert [(r["book_file"], r["import_seq"] >= 5, r["cover_file"] is None) for r in got] == [("a.epub", True, True), ("b.epub", True, False)] and got[1]["cover_file"] == got[1]["id"] + ".jpg"
