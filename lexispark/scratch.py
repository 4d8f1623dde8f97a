"""Files of a session: a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is not set a local session gets a temporary one; others must set it."""
    where = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='lexispark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one, deleted when the application ends."""
    path = f"{shared_folder(spark)}/lexispark-{uuid.uuid4().hex}"
    fs, p = filesystem(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path
