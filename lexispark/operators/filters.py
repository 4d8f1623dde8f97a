"""Search filters over utterances."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalized


@dataclass(frozen=True)
class Filters:
    """Lists of accepted values; an empty list accepts all. ``source`` is the token layer, raw or provided."""

    corpus_id: tuple[str, ...] = ()
    year: tuple[str, ...] = ()
    category: tuple[str, ...] = ()
    topic: tuple[str, ...] = ()
    speaker_sex: tuple[str, ...] = ()
    speaker_age: tuple[str, ...] = ()
    speaker_occupation: tuple[str, ...] = ()
    source: str = "raw"
    stopwords: str = ""

    FIELDS = ("corpus_id", "year", "category", "topic", "speaker_sex", "speaker_age", "speaker_occupation")

    def predicate(self, fields: tuple[str, ...] = FIELDS) -> Column:
        """One IN list for each restricted field, which Catalyst pushes to the scan."""
        lists = [(f, [v for v in getattr(self, f) if v]) for f in fields]
        return reduce(lambda a, b: a & b, (F.col(f).isin(v) for f, v in lists if v), F.lit(True))

    @property
    def only_corpus(self) -> bool:
        return not any(v for f in self.FIELDS if f != "corpus_id" for v in getattr(self, f))

    @property
    def kind(self) -> str:
        return "provided" if self.source == "provided" else "raw"

    @property
    def layer(self) -> str:
        return "provided" if self.source == "provided" else "tokens"

    def apply(self, utterances: DataFrame) -> DataFrame:
        return utterances.where(self.predicate())

    def _words(self) -> list[str]:
        return sorted({w for w in self.stopwords.replace(",", " ").split() if w})

    def stopword_list(self, spark: SparkSession) -> list[str]:
        """The stopwords as tokens."""
        words = self._words()
        return sorted({x for x in spark.range(1).select(*(normalized(F.lit(w)) for w in words)).first() if x}) if words else []

    def without_stopwords(self, column: Column) -> Column:
        words = self._words()
        return ~column.isin(*(normalized(F.lit(w)) for w in words)) if words else F.lit(True)


def filter_options(documents: DataFrame, speakers: DataFrame) -> DataFrame:
    """Distinct values that are not blank, of documents (year, category, topic) and speakers (sex, age, occupation)."""
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col(kind).alias("value")).where(F.col("value") != "").distinct()
    parts = [pick(documents, c) for c in ("year", "category", "topic")] + [pick(speakers, c) for c in ("sex", "age", "occupation")]
    return reduce(DataFrame.union, parts)
