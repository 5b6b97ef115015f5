"""The book catalog: imports without duplicates, keyed updates, whole-row deletes, covers, listing; settings and licenses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexora.functions.text import trimmed
from lexora.shared import cut

BOOK = "id string, title string, authors array<string>, canonical_id string, book_file string, cover_file string, import_seq long"
FIELDS = ("id", "title", "authors", "canonical_id", "book_file", "cover_file")


def imported(catalog: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The rows of batch that the catalog gains: of each canonical_id the first by import_seq, if the catalog lacks it.

    Null ids equal each other, so of books without one only the first is ever kept.
    """
    new = batch.groupBy("canonical_id").agg(F.min_by(F.struct(*batch.columns), F.struct("import_seq", "id")).alias("_r")).select("_r.*")
    if catalog is None:
        return new
    known = catalog.select(F.col("canonical_id").alias("_known")).distinct()
    return new.join(known, F.col("canonical_id").eqNullSafe(F.col("_known")), "left_anti")


def incoming(metadata: DataFrame, first_seq: int = 0) -> DataFrame:
    """Books of EPUB metadata rows (path, title, authors, canonical_id, cover): new ids, file names, and numbers from first_seq that rise with the path, with gaps."""
    name = F.substring_index("path", "/", -1)
    x = metadata.orderBy("path").withColumn("id", F.uuid()).withColumn("import_seq", F.monotonically_increasing_id() + first_seq)
    return x.select("id", "title", "authors", "canonical_id", name.alias("book_file"), F.when(F.col("cover").isNotNull(), F.concat("id", F.lit(".jpg"))).alias("cover_file"), F.col("import_seq").cast("long").alias("import_seq"), "cover")


def updated(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """catalog with changes put in place: of each id the last change, by import_seq, replaces the first book of that id.

    Changes of other ids do nothing; further books of the id stay as they are.
    """
    last = changes.groupBy("id").agg(F.max_by(F.struct(*FIELDS), F.struct("import_seq", *FIELDS)).alias("_c"))
    by = last.select(F.col("id").alias("_id"), "_c")
    first = F.row_number().over(W.partitionBy("id").orderBy("import_seq")) == 1
    x = catalog.withColumn("_first", first).join(by, F.col("id") == F.col("_id"), "left")
    hit = F.col("_c").isNotNull() & F.col("_first")
    return x.select(*[F.when(hit, F.col(f"_c.{c}")).otherwise(F.col(c)).alias(c) for c in FIELDS], "import_seq")


def removed(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """catalog without, for each of rows, the first book (by import_seq) that equals it in every field, nulls included."""
    gone = rows.groupBy(*FIELDS).agg(F.count("*").alias("_times")).select("_times", *[F.col(c).alias(f"_{c}") for c in FIELDS])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FIELDS])
    nth = F.row_number().over(W.partitionBy(*FIELDS).orderBy("import_seq"))
    x = catalog.withColumn("_nth", nth).join(gone, same, "left")
    return x.where(F.col("_nth") > F.coalesce("_times", F.lit(0))).select(*catalog.columns)


def deleted_files(rows: DataFrame) -> DataFrame:
    """The files that a delete drops, whether or not its row is in the catalog."""
    return rows.select(F.explode(F.array_compact(F.array("book_file", "cover_file"))).alias("file"))


def renamed(catalog: DataFrame, titles: DataFrame) -> DataFrame:
    """catalog with the trimmed titles of (id, title); of an id's titles the greatest counts."""
    by = titles.groupBy(F.col("id").alias("_id")).agg(F.max(trimmed(F.col("title"))).alias("_title"))
    return catalog.join(by, F.col("id") == F.col("_id"), "left").withColumn("title", F.coalesce("_title", "title")).drop("_id", "_title")


def listed(catalog: DataFrame) -> DataFrame:
    """id, shown title and authors; the newest has position 1."""
    title = F.coalesce("title", F.lit("Untitled"))
    authors = F.when(F.size(F.coalesce("authors", F.array())) == 0, "Unknown author").otherwise(F.array_join("authors", ", "))
    return catalog.select("id", title.alias("title"), authors.alias("authors"), "import_seq")


def with_covers(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """catalog with cover, the content of the file of that name (of several, of the first path); null without one."""
    by = files.groupBy(F.substring_index("path", "/", -1).alias("_file")).agg(F.min_by("content", "path").alias("cover"))
    return catalog.join(by, F.col("cover_file") == F.col("_file"), "left").drop("_file")


def located(catalog: DataFrame, base: str) -> DataFrame:
    """catalog with book_path and cover_path, where the files are below the folder base; null without a file."""
    below = lambda folder, name: F.concat(F.lit(f"{base.rstrip('/')}/{folder}/"), F.col(name))
    return catalog.withColumns({"book_path": below("Books", "book_file"), "cover_path": below("Covers", "cover_file")})


def encoded(catalog: DataFrame) -> DataFrame:
    return catalog.select("import_seq", F.to_json(F.struct(*FIELDS)).alias("json"))


def restored(values: Column) -> Column:
    """Books of a JSON array; nothing where it can't be read."""
    one = "array<struct<id:string,title:string,authors:array<string>,canonical_id:string,book_file:string,cover_file:string>>"
    return F.coalesce(F.from_json(values, one), F.array().cast(one))


# ---- settings

# The settings' fields, their values and defaults; sizes go by steps of a tenth.
SETTINGS = "interaction_mode string, font string, font_size double, line_height double, margins double, justify boolean, theme string, prompt_style string"
DEFAULTS = ("custom", "notoSerifSC", 1.2, 1.5, 1.0, True, "system", "quick")
ENUMS = {"interaction_mode": ("custom", "system"), "font": ("notoSerifSC", "pingFangSC"), "theme": ("light", "dark", "system"), "prompt_style": ("quick", "full")}
RANGES = {"font_size": (1.0, 2.0), "line_height": (1.0, 2.0), "margins": (0.0, 2.0)}
FAMILIES = {"notoSerifSC": "Noto Serif SC", "pingFangSC": "PingFang SC"}
SHOWN = {"custom": "Dictionary", "system": "System", "notoSerifSC": "Noto Serif", "pingFangSC": "PingFang", "light": "Light", "dark": "Dark", "quick": "Quick", "full": "Full"}


def defaults() -> Column:
    names = [f.split()[0] for f in SETTINGS.split(", ")]
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, DEFAULTS, strict=True)])


def read_settings(json: Column) -> Column:
    """The record in json; the defaults as a whole if it is absent, broken, incomplete or has an unknown value."""
    s = F.from_json(json, SETTINGS)
    names = [f.split()[0] for f in SETTINGS.split(", ")]
    ok = reduce(lambda a, b: a & b, [s[n].isNotNull() for n in names] + [s[n].isin(*v) for n, v in ENUMS.items()])
    return F.when(F.coalesce(ok, F.lit(False)), s).otherwise(defaults())


def resolved(s: Column, device: Column) -> Column:
    """What the page is shown with; a theme "system" is the device's."""
    family = F.when(s["font"] == "notoSerifSC", FAMILIES["notoSerifSC"]).otherwise(FAMILIES["pingFangSC"])
    theme = F.when(s["theme"] == "system", device).otherwise(s["theme"])
    return F.struct(family.alias("family"), theme.alias("theme"), F.when(s["justify"], "justify").otherwise("start").alias("align"), (s["interaction_mode"] == "system").alias("selectable"))


def clamped(value: Column, name: str) -> Column:
    low, high = RANGES[name]
    return F.round(F.least(F.greatest(value, F.lit(low)), F.lit(high)), 1)


def tenths(value: Column) -> Column:
    return F.format_string("%.1f", value)


def toggled(value: Column, enum: str) -> Column:
    """The other value of an enum of two: the first becomes the second, anything else the first."""
    first, second = ENUMS[enum]
    return F.when(value == first, F.lit(second)).otherwise(F.lit(first))


def enum_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, v, SHOWN[v], i) for e, values in ENUMS.items() for i, v in enumerate(values)], "enum string, value string, display string, ord long")


# ---- licenses

LICENSES = [("Reader toolkit", "BSD 3-Clause", "toolkit-license", "txt"), ("Chinese-English dictionary", "CC BY-SA 4.0", "dictionary-license", "txt"), ("Serif font", "SIL Open Font License 1.1", "font-license", "txt")]


def licenses(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The licenses with their texts; a missing file and one that isn't text have notes of their own."""
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(LICENSES)], "id long, name string, subtitle string, resource string, extension string")
    by = files.select(F.substring_index("path", "/", -1).alias("_file"), F.try_validate_utf8(F.col("content").cast("string")).alias("_text"))
    x = rows.join(by, F.concat("resource", F.lit("."), "extension") == F.col("_file"), "left")
    text = F.when(F.col("_file").isNull(), "The license file is missing.").when(F.col("_text").isNull(), "The license file can't be read.").otherwise(F.col("_text"))
    return x.select("id", "name", "subtitle", text.alias("text"))


# ---- contents


def flattened(toc: DataFrame) -> DataFrame:
    """book_id, node_id, depth, href_or_id, title and ordinal of a forest (book_id, node_id, parent_id, pos, href, title) in pre-order.

    Levels are joined one by one, so that a level is as distributed as any join;
    the path of positions gives the order.
    """
    key = lambda pos: F.lpad(pos.cast("string"), 10, "0")
    label = F.coalesce("href", "title", F.col("node_id").cast("string"))
    level = toc.where("parent_id IS NULL").select("book_id", "node_id", F.lit(0).alias("depth"), label.alias("href_or_id"), "title", key(F.col("pos")).alias("path"))
    out, depth = level, 0
    children = toc.where("parent_id IS NOT NULL").select(F.col("book_id").alias("_book"), F.col("node_id").alias("_node"), "parent_id", label.alias("_label"), F.col("title").alias("_title"), key(F.col("pos")).alias("_pos"))
    while True:
        depth += 1
        level = level.join(children, (F.col("book_id") == F.col("_book")) & (F.col("node_id") == F.col("parent_id")))
        level = level.select("book_id", F.col("_node").alias("node_id"), F.lit(depth).alias("depth"), F.col("_label").alias("href_or_id"), F.col("_title").alias("title"), F.concat("path", F.lit("/"), "_pos").alias("path"))
        level = cut(level, "contents")  # the next level starts from what is written, not from all levels before
        if not level.limit(1).count():
            return out.withColumn("ordinal", F.row_number().over(W.partitionBy("book_id").orderBy("path")) - 1).drop("path")
        out = out.unionByName(level)
