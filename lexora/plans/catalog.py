"""Queries on the book catalog, settings, licenses, tables of contents and EPUB files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.operators import catalog as cat
from lexora.plans.registry import longs, query, table
from lexora.shared import cut, fresh
from lexora.sources import epub, stores

BOOKS = """books AS (SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS title,
  CASE p_partkey % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [p_brand] ELSE [p_brand, p_type] END AS authors,
  CASE WHEN p_partkey % 7 <> 0 THEN 'id-' || (p_partkey * 31 % 1500) END AS canonical_id, p_partkey || '.epub' AS book_file,
  CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 50) || '.jpg' END AS cover_file, p_partkey AS import_seq FROM part)"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    authors = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array("p_brand")).otherwise(F.array("p_brand", "p_type"))
    return table(spark, sf_dir, "part").select(
        k.cast("string").alias("id"), F.when(k % 11 != 0, F.col("p_name")).alias("title"), authors.alias("authors"),
        F.when(k % 7 != 0, F.concat(F.lit("id-"), (k * 31 % 1500).cast("string"))).alias("canonical_id"), F.concat(k.cast("string"), F.lit(".epub")).alias("book_file"),
        F.when(k % 3 != 0, F.concat((k % 50).cast("string"), F.lit(".jpg"))).alias("cover_file"), k.cast("long").alias("import_seq"),
    )


_KEPT = "k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY import_seq) AS n FROM books) WHERE n = 1)"


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.imported(None, books(spark, sf_dir))


@query(f"WITH {BOOKS}, {_KEPT} SELECT id, title, canonical_id, import_seq FROM k")
def book_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).select("id", "title", "canonical_id", "import_seq")


@query(f"WITH {BOOKS}, old AS (SELECT * FROM books WHERE import_seq <= 500), new AS (SELECT * FROM books WHERE import_seq > 500), {_KEPT.replace('FROM books', 'FROM new')} SELECT id, canonical_id FROM k WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.canonical_id IS NOT DISTINCT FROM k.canonical_id)")
def book_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second batch against a catalog: null ids equal each other."""
    b = books(spark, sf_dir)
    return cat.imported(b.where("import_seq <= 500"), b.where("import_seq > 500")).select("id", "canonical_id")


@query(f"""WITH {BOOKS}, {_KEPT} SELECT k.id, CASE WHEN b.id IS NULL THEN k.title ELSE upper(b.title) END AS title, k.import_seq FROM k LEFT JOIN (SELECT * FROM books WHERE import_seq % 2 = 0) b ON b.id = k.id""")
def book_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of even ids, some of which the catalog lacks."""
    changes = books(spark, sf_dir).where("import_seq % 2 = 0").withColumn("title", F.upper("title"))
    return cat.updated(_catalog(spark, sf_dir), changes).select("id", "title", "import_seq")


@query(f"WITH {BOOKS}, {_KEPT} SELECT id, coalesce(CASE WHEN import_seq % 5 = 0 THEN regexp_replace('  ' || title || ' ', '^ +| +$', '', 'g') || ' (2)' END, title) AS title FROM k")
def book_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalog(spark, sf_dir)
    titles = c.where("import_seq % 5 = 0").select("id", F.concat(F.lit("  "), "title", F.lit(" (2) \n")).alias("title"))
    return cat.renamed(c, titles).select("id", "title")


@query(f"WITH {BOOKS}, {_KEPT} SELECT id, title FROM k WHERE NOT (import_seq % 10 = 3)")
def book_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows equal in every field go; a row that was changed since stays."""
    c = _catalog(spark, sf_dir)
    rows = c.where("import_seq % 10 = 3").unionByName(c.where("import_seq % 10 = 4").withColumn("title", F.lit("another")))
    return cat.removed(c, rows).select("id", "title")


@query(f"WITH {BOOKS}, {_KEPT} SELECT unnest([book_file, cover_file]) AS file FROM k WHERE import_seq % 10 IN (3, 4) AND cover_file IS NOT NULL UNION ALL SELECT book_file FROM k WHERE import_seq % 10 IN (3, 4) AND cover_file IS NULL")
def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.deleted_files(_catalog(spark, sf_dir).where("import_seq % 10 IN (3, 4)"))


_TWICE = "t AS (SELECT * FROM k UNION ALL SELECT * REPLACE (import_seq + 100000 AS import_seq) FROM k WHERE import_seq % 4 = 0)"


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with every fourth book twice."""
    c = _catalog(spark, sf_dir)
    return c.unionByName(c.where("import_seq % 4 = 0").withColumn("import_seq", F.col("import_seq") + 100000))


@query(f"""WITH {BOOKS}, {_KEPT}, {_TWICE} SELECT id, CASE WHEN import_seq < 100000 AND import_seq % 6 = 0 THEN 'last' ELSE title END AS title, import_seq FROM t""")
def book_update_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several changes of one id, the last of which counts; of books with one id the first is changed."""
    c = _catalog(spark, sf_dir).where("import_seq % 6 = 0")
    changes = c.withColumn("title", F.lit("zero")).unionByName(c.withColumns({"title": F.lit("last"), "import_seq": F.col("import_seq") + 1}))
    return cat.updated(_twice(spark, sf_dir), changes).select("id", "title", "import_seq")


@query(f"""WITH {BOOKS}, {_KEPT}, {_TWICE} SELECT id, import_seq FROM t WHERE NOT (import_seq < 100000 AND import_seq % 12 IN (0, 1)) AND NOT (import_seq >= 100000 AND (import_seq - 100000) % 24 = 0)""")
def book_delete_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delete takes the first of equal books; two deletes take two."""
    c = _catalog(spark, sf_dir)
    rows = c.where("import_seq % 12 IN (0, 1)").unionByName(c.where("import_seq % 24 = 0"))
    return cat.removed(_twice(spark, sf_dir), rows).select("id", "import_seq")


@query(f"WITH {BOOKS}, {_KEPT} SELECT id, '/data/Books/' || book_file AS book_path, '/data/Covers/' || cover_file AS cover_path FROM k")
def book_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.located(_catalog(spark, sf_dir), "/data/").select("id", "book_path", "cover_path")


@query(f"WITH {BOOKS}, {_KEPT} SELECT id, title, array_to_string(authors, '|') AS authors, canonical_id, import_seq FROM k WHERE import_seq % 3 = 0")
def catalog_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog saved, saved again after books went, and read back from the version in force."""
    c, path = _catalog(spark, sf_dir), fresh(spark, "catalog")
    stores.persist(c, path)
    stores.persist(stores.restore(spark, path, cat.BOOK).where("import_seq % 3 = 0"), path)
    return stores.restore(spark, path, cat.BOOK).select("id", "title", F.array_join("authors", "|").alias("authors"), "canonical_id", "import_seq")


@query("SELECT 'file-' || (n_nationkey % 7) || '.txt' AS file, CASE WHEN n_nationkey % 7 < 5 THEN 'text ' || (n_nationkey % 7) || chr(10) || 'second line' ELSE '' END AS text FROM nation")
def bundled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundled files read whole; a name without a file gives an empty text."""
    folder = fresh(spark, "bundle")
    files = spark.range(5).select(F.concat(F.lit("file-"), "id", F.lit(".txt")).alias("name"), F.concat(F.lit("text "), "id", F.lit("\nsecond line")).cast("binary").alias("content"))
    stores.copy_files(files, folder)
    names = table(spark, sf_dir, "nation").select(F.concat(F.lit("file-"), F.col("n_nationkey") % 7, F.lit(".txt")).alias("file"))
    return stores.text_or_empty(names, stores.bundled(spark, folder))


@query("SELECT 'n' || n_nationkey || '.epub' AS file, CASE WHEN n_nationkey < 5 THEN 'old ' ELSE 'new ' END || n_nationkey AS content FROM nation")
def copies_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files copied where none of that name is there: those that are stay."""
    folder, n = fresh(spark, "books"), F.col("n_nationkey")
    files = lambda what, of: of.select(F.concat(F.lit("n"), n, F.lit(".epub")).alias("name"), F.concat(F.lit(what), n).cast("binary").alias("content"))
    stores.copy_files(files("old ", table(spark, sf_dir, "nation").where("n_nationkey < 5")), folder)
    stores.copy_files(files("new ", table(spark, sf_dir, "nation")), folder)
    return stores.bundled(spark, folder).select("file", F.col("text").alias("content"))


@query(f"WITH {BOOKS}, {_KEPT} SELECT id, coalesce(title, 'Untitled') AS title, CASE WHEN len(authors) = 0 THEN 'Unknown author' ELSE array_to_string(authors, ', ') END AS authors, import_seq FROM k ORDER BY import_seq DESC")
def book_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library, newest first."""
    return cat.listed(_catalog(spark, sf_dir)).orderBy(F.desc("import_seq"))


@query(f"WITH {BOOKS}, {_KEPT}, f AS (SELECT range || '.jpg' AS file, md5('cover ' || range) AS sum FROM range(0, 40)) SELECT k.id, k.cover_file, f.sum AS cover_md5 FROM k LEFT JOIN f ON f.file = k.cover_file")
def book_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers by file name; those that are missing or have no file are null."""
    files = spark.range(40).select(F.concat(F.lit("file:/books/covers/"), "id", F.lit(".jpg")).alias("path"), F.concat(F.lit("cover "), "id").cast("binary").alias("content"))
    return cat.with_covers(_catalog(spark, sf_dir), files).select("id", "cover_file", F.md5("cover").alias("cover_md5"))


@query(f"WITH {BOOKS}, {_KEPT} SELECT id, cover_file, CASE WHEN import_seq % 50 % 5 <> 0 THEN md5('cover ' || cover_file) END AS cover_md5, cover_file IS NOT NULL AND import_seq % 50 % 5 = 0 AS failed FROM k")
def covers_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers written as files and read back for their books; one that can't be written is reported and the others go on."""
    c, folder = _catalog(spark, sf_dir), fresh(spark, "covers")
    image = F.when(F.col("import_seq") % 50 % 5 != 0, F.concat(F.lit("cover "), "cover_file")).cast("binary")
    covers = c.where("cover_file IS NOT NULL").select(F.col("cover_file").alias("name"), image.alias("content")).dropDuplicates(["name"])
    failed = cut(stores.write_files(covers, folder).where("error IS NOT NULL"), "failed")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder)
    there = cat.with_covers(c, files).join(failed.select(F.col("name").alias("_name")), F.col("cover_file") == F.col("_name"), "left")
    return there.select("id", "cover_file", F.md5("cover").alias("cover_md5"), F.col("_name").isNotNull().alias("failed"))


@query(f"WITH {BOOKS}, {_KEPT} SELECT id, title, array_to_string(authors, '|') AS authors, canonical_id, book_file, cover_file FROM k")
def catalog_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books through their JSON form."""
    values = cat.encoded(_catalog(spark, sf_dir)).select(F.explode(cat.restored(F.concat(F.lit("["), "json", F.lit("]")))).alias("b")).select("b.*")
    return values.withColumn("authors", F.array_join("authors", "|"))


# ---- settings

_S = """s AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '{' WHEN 2 THEN '{"font": "serif"}' ELSE 'ok' END AS kind,
  CASE event_id % 2 WHEN 0 THEN 'custom' ELSE 'system' END AS mode, CASE event_id % 3 WHEN 0 THEN 'notoSerifSC' ELSE 'pingFangSC' END AS font, 1.0 + (event_id % 11) / 10.0 AS size,
  CASE event_id % 5 WHEN 0 THEN 'light' WHEN 1 THEN 'dark' WHEN 2 THEN 'sepia' ELSE 'system' END AS theme, event_id % 4 < 2 AS justify, CASE event_id % 7 WHEN 0 THEN 'full' ELSE 'quick' END AS style FROM events),
r AS (SELECT *, kind = 'ok' AND theme <> 'sepia' AS good FROM s)"""


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    theme = F.when(i % 5 == 0, "light").when(i % 5 == 1, "dark").when(i % 5 == 2, "sepia").otherwise("system")
    record = F.to_json(F.struct(
        F.when(i % 2 == 0, "custom").otherwise("system").alias("interaction_mode"), F.when(i % 3 == 0, "notoSerifSC").otherwise("pingFangSC").alias("font"), (F.lit(1.0) + (i % 11) / 10).alias("font_size"),
        F.lit(1.5).alias("line_height"), F.lit(1.0).alias("margins"), (i % 4 < 2).alias("justify"), theme.alias("theme"), F.when(i % 7 == 0, "full").otherwise("quick").alias("prompt_style")))
    json = F.when(i % 9 == 0, F.lit(None)).when(i % 9 == 1, "{").when(i % 9 == 2, '{"font": "serif"}').otherwise(record)
    return table(spark, sf_dir, "events").select("event_id", cat.read_settings(json).alias("s"))


@query(f"WITH {_S} SELECT event_id, CASE WHEN good THEN mode ELSE 'custom' END AS interaction_mode, CASE WHEN good THEN font ELSE 'notoSerifSC' END AS font, CAST(CASE WHEN good THEN size ELSE 1.2 END AS DOUBLE) AS font_size, CASE WHEN good THEN theme ELSE 'system' END AS theme, CASE WHEN good THEN justify ELSE true END AS justify, CASE WHEN good THEN style ELSE 'quick' END AS prompt_style FROM (SELECT * REPLACE (coalesce(good, false) AS good) FROM r)")
def settings_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored settings, some absent, broken or with an unknown value: those are the defaults as a whole."""
    return _settings(spark, sf_dir).select("event_id", "s.interaction_mode", "s.font", "s.font_size", "s.theme", "s.justify", "s.prompt_style")


@query(f"""WITH {_S}, g AS (SELECT *, coalesce(good, false) AS ok FROM r)
SELECT event_id, CASE WHEN NOT ok OR font = 'notoSerifSC' THEN 'Noto Serif SC' ELSE 'PingFang SC' END AS family, CASE WHEN ok AND theme <> 'system' THEN theme WHEN event_id % 2 = 0 THEN 'dark' ELSE 'light' END AS theme,
CASE WHEN NOT ok OR justify THEN 'justify' ELSE 'start' END AS align, ok AND mode = 'system' AS selectable FROM g""")
def settings_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    device = F.when(F.col("event_id") % 2 == 0, "dark").otherwise("light")
    return _settings(spark, sf_dir).select("event_id", F.inline(F.array(cat.resolved(F.col("s"), device))))


@query("""SELECT event_id, round(least(greatest(value / 40, 1.0), 2.0), 1) AS font_size, format('{:.1f}', round(least(greatest(value / 40, 1.0), 2.0), 1)) AS shown, round(least(greatest(value / 40, 0.0), 2.0), 1) AS margins FROM events""")
def settings_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value") / 40
    return table(spark, sf_dir, "events").select("event_id", cat.clamped(x, "font_size").alias("font_size"), cat.tenths(cat.clamped(x, "font_size")).alias("shown"), cat.clamped(x, "margins").alias("margins"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{v}', '{cat.SHOWN[v]}', CAST({i} AS BIGINT))" for e, vs in cat.ENUMS.items() for i, v in enumerate(vs)) + ") AS t(enum, value, display, ord)")
def settings_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.enum_rows(spark)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'system' ELSE 'custom' END AS interaction_mode, CASE WHEN event_id % 2 = 0 THEN 'quick' ELSE 'full' END AS prompt_style FROM events")
def settings_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    mode, style = F.when(i % 3 == 0, "custom").when(i % 3 == 1, "system"), F.when(i % 2 == 0, "full").otherwise("quick")
    return table(spark, sf_dir, "events").select("event_id", cat.toggled(mode, "interaction_mode").alias("interaction_mode"), cat.toggled(style, "prompt_style").alias("prompt_style"))


_TEXTS = ("'Permission is granted.'", "'The license file can''t be read.'", "'The license file is missing.'")


@query("SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{n}', '{s}', {t})" for i, ((n, s, _, _), t) in enumerate(zip(cat.LICENSES, _TEXTS, strict=True))) + ") AS t(id, name, subtitle, text)")
def license_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three licenses: one readable, one that isn't text, one missing."""
    names = [f"file:/licenses/{r}.{x}" for _, _, r, x in cat.LICENSES]
    files = spark.createDataFrame([(names[0], b"Permission is granted."), (names[1], b"\xff\xfe\x00")], "path string, content binary")
    return cat.licenses(spark, files)


# ---- contents and EPUB


@query("""WITH t AS (SELECT r_regionkey AS book_id, 'r' || r_regionkey AS node, lpad('0', 10, '0') AS path, 0 AS depth, r_name AS label FROM region
UNION ALL SELECT n_regionkey, 'n' || n_nationkey, lpad('0', 10, '0') || '/' || lpad(CAST(n_nationkey AS VARCHAR), 10, '0'), 1, 'n' || n_nationkey || '.html' FROM nation
UNION ALL SELECT n_regionkey, 'c' || c_custkey, lpad('0', 10, '0') || '/' || lpad(CAST(n_nationkey AS VARCHAR), 10, '0') || '/' || lpad(CAST(c_custkey AS VARCHAR), 10, '0'), 2, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'c' || c_custkey END FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT CAST(book_id AS BIGINT) AS book_id, CAST(depth AS BIGINT) AS depth, label AS href_or_id, row_number() OVER (PARTITION BY book_id ORDER BY path) - 1 AS ordinal FROM t""")
def toc_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of regions, nations and customers in pre-order; entries have a href, else a title, else an id."""
    none = F.lit(None).cast("string")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("book_id"), F.concat(F.lit("r"), "r_regionkey").alias("node_id"), none.alias("parent_id"), F.lit(0).alias("pos"), none.alias("href"), F.col("r_name").alias("title"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("book_id"), F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_nationkey").alias("pos"), F.concat(F.lit("n"), "n_nationkey", F.lit(".html")).alias("href"), F.col("n_name").alias("title"))
    of = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = table(spark, sf_dir, "customer").join(of, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("book_id"), F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.concat(F.lit("n"), "n_nationkey").alias("parent_id"), F.col("c_custkey").alias("pos"), none.alias("href"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("title"))
    toc = region.unionByName(nation).unionByName(customer)
    return longs(cat.flattened(toc).select("book_id", "depth", "href_or_id", "ordinal"), "book_id", "depth", "ordinal")


def _epubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An EPUB for each nation, made on the executors; every fifth file is broken."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, name, region in b.itertuples(index=False):
                data = epub.packed(name, [f"Author {region}", "Second & Co"] if k % 2 else [], f"urn:nation:{k}" if k % 3 else None, [(f"{name} {i}", f"Text <{i}> of {name}.") for i in range(k % 4 + 1)], b"\xff\xd8" + bytes([k]) if k % 4 else None)
                out.append((f"/books/{k}.epub", data if k % 5 else data[:60]))
            yield pd.DataFrame(out, columns=["path", "content"])

    return rows.mapInPandas(run, "path string, content binary")


@query("""SELECT '/books/' || n_nationkey || '.epub' AS path, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS title, CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 2 = 1 THEN 'Author ' || n_regionkey || '|Second & Co' ELSE '' END AS authors,
CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 3 <> 0 THEN 'urn:nation:' || n_nationkey END AS canonical_id, CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 4 <> 0 THEN CAST(3 AS BIGINT) END AS cover_bytes FROM nation""")
def epub_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = epub.metadata(_epubs(spark, sf_dir))
    return m.select("path", "title", F.array_join("authors", "|").alias("authors"), "canonical_id", F.octet_length("cover").cast("long").alias("cover_bytes"))


@query("SELECT '/books/1.epub' AS path, n_name AS title FROM nation WHERE n_nationkey = 1")
def epub_picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one file that an import takes of several."""
    return epub.metadata(epub.picked(_epubs(spark, sf_dir).where("path <> '/books/0.epub'"))).select("path", "title")


@query("WITH n AS (SELECT *, unnest(range(0, n_nationkey % 4 + 1)) AS i FROM nation WHERE n_nationkey % 5 <> 0) SELECT '/books/' || n_nationkey || '.epub' AS path, i AS spine_no, 'c' || i || '.xhtml' AS href, n_name || ' ' || i || 'Text <' || i || '> of ' || n_name || '.' AS text FROM n")
def epub_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexora.operators.extract import decoded

    d = epub.documents(_epubs(spark, sf_dir))
    return d.select("path", "spine_no", "href", decoded(F.regexp_replace("html", "<[^>]*>", "")).alias("text"))


@query("WITH n AS (SELECT *, unnest(range(0, n_nationkey % 4 + 1)) AS i FROM nation WHERE n_nationkey % 5 <> 0) SELECT '/books/' || n_nationkey || '.epub' AS book_id, i AS ordinal, 'c' || i || '.xhtml' AS href_or_id, n_name || ' ' || i AS title FROM n")
def epub_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    toc = epub.contents(_epubs(spark, sf_dir)).withColumn("node_id", F.col("node_id").cast("string")).withColumn("parent_id", F.col("parent_id").cast("string"))
    return longs(cat.flattened(toc).select("book_id", "ordinal", "href_or_id", "title"), "ordinal")
