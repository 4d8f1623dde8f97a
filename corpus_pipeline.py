"""The corpus pipeline: five stages over ``documents``, each by one of the training-data operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet and reads it again for the
next stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import decontamination, jaccard_join, language_id, packing, pii
from lexispark.llm._base import dropped, free_prefix, stored, table
from lexispark.llm.queries import DEMO_KEY, _learnt

#: Probability from which a language is believed.
MIN_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: null texts, texts without letters, and scores under ``MIN_SCORE``.

    If no training row has a language there is no model to judge by; then only null texts and texts without letters go. Rows are judged
    by their texts alone, so null ids, repeated rows and further columns, whatever their names, stay as they are; an empty table
    gives an empty table.
    """
    model = language_id.fit(docs.where(_learnt()))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    w = free_prefix(docs)
    found = language_id.predict(docs, model, lang=w + "lang", score=w + "score")
    return found.where((F.col(w + "lang") != language_id.UNKNOWN) & (F.col(w + "score") >= MIN_SCORE)).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each group of near duplicates keeps exactly one row, of the smallest id in it; a group without any id keeps one too.

    Rows of one id whose texts are not near duplicates are different groups. Rows without words (null and empty texts too) are like no
    other and stay. Of equal rows one stays. Further columns stay, whatever their names; an empty table gives an empty table.
    """
    return jaccard_join.representatives(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage like a benchmark item go.

    Null and empty texts stay, and so do rows without an id unless their own text leaks; repeated rows stay or go together. Further
    columns stay, whatever their names; an empty table gives an empty table.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts are replaced by pseudonyms; n_chars follows the text, and stays null where it was.

    All rows stay, with null and empty texts and repeated ones; further columns stay, whatever their names; an empty table gives an empty
    table.
    """
    return pii.pseudonymise(docs, DEMO_KEY).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of the packed token sequences: one row for each piece of a text.

    Null and empty texts have no tokens and give no row; null ids, null sources and repeated rows are packed like any other; further
    columns are not read; an empty table gives an empty table.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_leaked),
    ("pii", pseudonymise),
    ("packing", pack),
]
#: Models, shingle hashes and sequential packing are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = stored(stage(spark, docs, sf_dir), name)
        dropped(docs)  # nothing reads the stage before any more
        docs = after
    return docs
