"""The folder that the driver and all executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where the setting is absent, a local master gets a temporary folder; any
    other master is an error, as its executors wouldn't see such a folder.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("lexora.shared.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lexora-")
        spark.conf.set("lexora.shared.dir", where)
    return where.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs start there, whichever executors are lost."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def spent(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing will read again, as what was made from them has been written itself."""
    for df in tables:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
