"""Small stores: whole-list JSON values, bundled texts, dictionary tables; written by Spark's committed writers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def persist(rows: DataFrame, path: str) -> None:
    """Overwrite the store with all rows: a new version beside the others, which is in force once it is whole."""
    _written(rows, path)


def restore(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The store's rows; unreadable lines are left out, an absent store is empty."""
    now = _in_force(spark, path)
    if now is None:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(f"{path}/version={now}")
    return rows.where("_corrupt IS NULL").drop("_corrupt")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a store: folders that Spark's commit has marked."""
    hadoop, p = _path(spark, path)
    fs = p.getFileSystem(hadoop)
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    found = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    return sorted(v for v in found if fs.exists(_path(spark, f"{path}/version={v}/_SUCCESS")[1]))


def _in_force(spark: SparkSession, path: str) -> int | None:
    return (_versions(spark, path) or [None])[-1]


def _written(rows: DataFrame, path: str, kept: int = 2) -> None:
    """Write the next version; a version that a crash left half written is overwritten, and old ones but the last few go."""
    spark = rows.sparkSession
    now = _in_force(spark, path)
    rows.write.mode("overwrite").json(f"{path}/version={0 if now is None else now + 1}")
    for old in _versions(spark, path)[:-kept]:
        hadoop, p = _path(spark, f"{path}/version={old}")
        p.getFileSystem(hadoop).delete(p, True)


def copy_files(rows: DataFrame, folder: str) -> None:
    """Copy the files of rows (name, content) into a folder, but for names that are there; a file that can't be written is an error."""
    spark = rows.sparkSession
    hadoop, base = _path(spark, folder)
    fs = base.getFileSystem(hadoop)
    fs.mkdirs(base)
    there = spark.createDataFrame([(x.getPath().getName(),) for x in fs.listStatus(base)], "_name string")
    new = rows.join(there, F.col("name") == F.col("_name"), "left_anti").dropDuplicates(["name"])
    write_files(new, folder).where("error IS NOT NULL").foreach(_failed)


def _failed(row) -> None:
    raise OSError(f"{row['name']}: {row['error']}")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write the files of rows (name, content) below a folder of any file system that Arrow opens; name and an error, null where it went well.

    A file is written beside its place and moved there, so that none is seen
    half written; a file that fails is reported and the others go on.
    """

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for b in batches:
            out = []
            for name, content in zip(b["name"], b["content"], strict=True):
                beside = f"{base}/.{name}.{uuid.uuid4().hex}"  # of this attempt alone
                try:
                    data = bytes(content)
                    with store.open_output_stream(beside) as f:
                        f.write(data)
                    store.move(beside, f"{base}/{name}")
                    out.append((name, None))
                except (OSError, TypeError) as e:
                    out.append((name, str(e)))
            yield pd.DataFrame(out, columns=["name", "error"]).astype(object)

    return rows.select("name", "content").mapInPandas(run, "name string, error string")


def upsert_latest(rows: DataFrame, path: str, key: str, order: list[str]) -> None:
    """For foreachBatch: the store's next version has each key's last row of those there and rows.

    A crash at any point leaves the version before in force, and a batch that
    comes again changes nothing.
    """
    spark = rows.sparkSession
    now = _in_force(spark, path)
    both = rows if now is None else rows.unionByName(spark.read.schema(rows.schema).json(f"{path}/version={now}"))
    _written(both.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*"), path)


def upserted(stream: DataFrame, path: str, key: str, order: list[str], checkpoint: str) -> DataFrame:
    """Keep a stream's last row of each key in a store until what is there now is read; the store's rows."""
    q = stream.writeStream.foreachBatch(lambda rows, _: upsert_latest(rows, path, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return restore(stream.sparkSession, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema))


def published(stream: DataFrame, receive: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand each micro-batch of a stream, with its number, to a receiver; a batch that comes again has the same number."""
    stream.writeStream.foreachBatch(receive).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def bundled(spark: SparkSession, folder: str) -> DataFrame:
    """file and text of the folder's files, whole."""
    texts = spark.read.text(folder, wholetext=True)
    return texts.select(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("file"), F.col("value").alias("text"))


def text_or_empty(names: DataFrame, of: DataFrame) -> DataFrame:
    """names (file) with text, empty where the file is missing."""
    return names.join(of, "file", "left").select("file", F.coalesce("text", F.lit("")).alias("text"))


def dictionary_text(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary in lines `trad simp [pinyin] /sense/sense/`; lines that begin with # are notes."""
    line = r"^(\S+) (\S+) \[([^\]]*)\] (/.*/)\s*$"
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & F.col("value").rlike(line))
    part = lambda i: F.regexp_extract("value", line, i)
    return rows.select(F.xxhash64("value").alias("entry_id"), part(1).alias("trad"), part(2).alias("simp"), part(3).alias("pinyin"), part(4).alias("senses_raw"))


def dictionary_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A dictionary table of any database with a JDBC driver."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return rows.select(F.xxhash64("trad", "simp", "pinyin", "senses_raw").alias("entry_id"), "trad", "simp", "pinyin", "senses_raw")


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path(path)
