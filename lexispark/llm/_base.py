"""Shared pieces of the training-data operators: word splitting, table access, scratch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_folder, remove

#: ASCII white space, the only separators of words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN, -1))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_prefix(*frames: DataFrame) -> str:
    """A start of column names that no column of the frames has, whatever its case, so that working columns clash with none."""
    taken, prefix = {c.lower() for f in frames for c in f.columns}, "w_"
    while any(c.startswith(prefix) for c in taken):
        prefix = "w" + prefix
    return prefix


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    The files live in the folder of ``spark.checkpoint.dir``, so they outlast any executor; they are deleted when the application
    ends, or before by ``dropped``.
    """
    spark = df.sparkSession
    path = f"{new_folder(spark)}/{name}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_in = path.rsplit("/", 1)[0]
    return back


def dropped(*frames: DataFrame) -> None:
    """Delete the files of frames from ``stored`` that nothing reads any more."""
    for df in frames:
        if where := getattr(df, "stored_in", None):
            remove(df.sparkSession, where)
