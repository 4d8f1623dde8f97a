"""Corpus statistics: counts, frequencies and distributions.

Where at most corpora are chosen the counted tables answer (``token_stats``, ``value_stats``), which are as large as the vocabulary;
with any other filter the utterances are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import looks_marked
from ..sources.tables import speaker_label
from .filters import Filters


def occurrences(utterances: DataFrame, layer: str = "tokens") -> DataFrame:
    """One row per token: corpus_id, row_id, token_index, term."""
    return utterances.select("corpus_id", "row_id", F.posexplode(f"{layer}.normalized").alias("token_index", "term"))


def terms(utterances: DataFrame, layer: str = "tokens") -> DataFrame:
    return utterances.select(F.explode(f"{layer}.normalized").alias("term"))


def top(rows: DataFrame, value: Column, n: int, count: Column | None = None) -> DataFrame:
    """The n most frequent values; ties by value."""
    number = F.count(F.lit(1)) if count is None else F.sum(count)
    return rows.groupBy(value.alias("value")).agg(number.alias("count")).orderBy(F.desc("count"), "value").limit(n)


def _counted(stats: DataFrame, filters: Filters, kind: str) -> DataFrame:
    return stats.where(filters.predicate(("corpus_id",)) & (F.col("kind") == kind))


def token_frequency(utterances: DataFrame, token_stats: DataFrame, filters: Filters = Filters(), n: int = 100) -> DataFrame:
    if filters.only_corpus:
        rows = _counted(token_stats, filters, filters.kind)
        return top(rows.where(filters.without_stopwords(F.col("term"))), F.col("term"), n, F.col("count"))
    rows = terms(filters.apply(utterances), filters.layer)
    return top(rows.where(filters.without_stopwords(F.col("term"))), F.col("term"), n)


def summary(utterances: DataFrame, filters: Filters = Filters(), document_stats: DataFrame | None = None, token_stats: DataFrame | None = None, value_stats: DataFrame | None = None) -> DataFrame:
    """One row of counts; documents and speakers are counted within their corpus and document.

    If at most corpora are chosen, the counted tables answer, where they are given, and markers are raw ones whatever the layer. Else
    counts go up from speakers to documents to corpora, so nothing is counted by distinct values and each step only shuffles sums.
    """
    raw = filters.only_corpus
    whole = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    if raw and document_stats is not None:
        docs = document_stats.where(filters.predicate(("corpus_id",))).groupBy("corpus_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("utterance_count").alias("n"), F.sum("speaker_count").alias("speakers"))
        docs = docs.agg(F.count(F.lit(1)).alias("corpus_count"), whole("documents", "document_count"), whole("n", "utterance_count"), whole("speakers", "speaker_count"))
        return docs.crossJoin(_counted(token_stats, filters, filters.kind).agg(whole("count", "token_count"))).crossJoin(_counted(value_stats, filters, "marker").agg(whole("count", "non_speech_count")))
    marked = F.filter("tokens.normalized" if raw else f"{filters.layer}.normalized", looks_marked)
    total = lambda c: F.sum(c).alias(c)
    rows = filters.apply(utterances).select("corpus_id", "doc_id", "speaker_id", F.size(f"{filters.layer}.normalized").alias("tokens"), F.size(marked).alias("marks"))
    rows = rows.groupBy("corpus_id", "doc_id", "speaker_id").agg(F.count(F.lit(1)).alias("n"), total("tokens"), total("marks"))
    rows = rows.groupBy("corpus_id", "doc_id").agg(F.count("speaker_id").alias("speakers"), total("n"), total("tokens"), total("marks"))
    rows = rows.groupBy("corpus_id").agg(F.count("doc_id").alias("documents"), *(total(c) for c in ("speakers", "n", "tokens", "marks")))
    return rows.agg(
        F.count("corpus_id").alias("corpus_count"),
        whole("documents", "document_count"),
        whole("n", "utterance_count"),
        whole("speakers", "speaker_count"),
        whole("tokens", "token_count"),
        whole("marks", "non_speech_count"),
    )


def distribution(utterances: DataFrame, value_stats: DataFrame, field: str, filters: Filters = Filters()) -> DataFrame:
    """Topics or categories: of documents (top 100, no blanks) if at most corpora are chosen, else of utterances (top 50)."""
    if filters.only_corpus:
        return top(_counted(value_stats, filters, field), F.col("value"), 100, F.col("count"))
    return top(filters.apply(utterances), F.col(field), 50)


def speaker_distribution(utterances: DataFrame, value_stats: DataFrame, filters: Filters = Filters()) -> DataFrame:
    if filters.only_corpus:
        return top(_counted(value_stats, filters, "speaker"), F.col("value"), 100, F.col("count"))
    return top(filters.apply(utterances), speaker_label(), 50)


def marker_distribution(utterances: DataFrame, value_stats: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Non-speech markers; of the raw layer if at most corpora are chosen, else of the chosen layer."""
    if filters.only_corpus:
        return top(_counted(value_stats, filters, "marker"), F.col("value"), 100, F.col("count"))
    return top(terms(filters.apply(utterances), filters.layer).where(looks_marked(F.col("term"))), F.col("term"), 50)
