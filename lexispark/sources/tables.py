"""The tables of a stored corpus: what is kept of its files, and what is counted from it when it is published."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import legacy_hangul, looks_marked, normalized, tokens, trim

#: Shown for a speaker's sex or age that is not known (fixed value).
UNKNOWN = "미상"
TOKENS = "array<struct<surface:string,normalized:string>>"
PROVIDED = "array<struct<surface:string,normalized:string,lemma:string,pos:string>>"
SCHEMAS = {
    "utterances": "row_id long, doc_id string, utterance_id string, speaker_id string, sequence long, form string, original_form string, "
    f"tokens {TOKENS}, provided {PROVIDED}, time string, start double, end double, note string, category string, topic string, year string, "
    "speaker_age string, speaker_sex string, speaker_occupation string, metadata string",
    "documents": "doc_id string, title string, author string, publisher string, date string, topic string, category string, year string, metadata string",
    "speakers": "doc_id string, speaker_id string, age string, occupation string, sex string, birthplace string, principal_residence string, "
    "current_residence string, education string, device string, keyboard string, metadata string",
    "document_stats": "doc_id string, utterance_count long, first_sequence long, last_sequence long, speaker_count long",
    "topic_stats": "category string, topic string, count long",
    "token_stats": "kind string, term string, count long",
    "value_stats": "kind string, value string, count long",
    "postings": "kind string, term string, part long, rows array<long>, at array<int>",
    "grams": "gram string, part long, blocks array<long>",
}


def speaker_label():
    part = lambda c: F.when(F.col(c) != "", F.col(c)).otherwise(F.lit(UNKNOWN))
    return F.concat(part("speaker_sex"), F.lit(" / "), part("speaker_age"))


def tokenised(rows: DataFrame) -> DataFrame:
    """Utterances with their raw tokens, of the form or else the original form; given tokens are normalised and blank ones go."""
    rows = rows.withColumns({c: legacy_hangul(F.col(c)) for c in ("form", "original_form")})
    named = F.transform("provided", lambda t: F.struct(normalized(t["surface"]).alias("normalized"), t["lemma"].alias("lemma"), t["pos"].alias("pos")))
    # a given token is shown by its normalised form
    given = F.transform(F.filter(named, lambda t: t["normalized"] != ""), lambda t: F.struct(t["normalized"].alias("surface"), t["normalized"].alias("normalized"), t["lemma"].alias("lemma"), t["pos"].alias("pos")))
    text = F.when(trim(F.col("form")) != "", F.col("form")).otherwise(F.col("original_form"))
    return rows.withColumn("tokens", tokens(text)).withColumn("provided", F.coalesce(given, F.array().cast(PROVIDED)))


def derived(utterances: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """The counted tables of stored utterances and documents; each is one aggregate over the columns that it needs.

    value_stats counts documents by topic and by category, utterances by speaker, and raw markers; blank values are not counted.
    Terms are counted by ``counted_terms`` from their postings.
    """
    topics = documents.groupBy("category", "topic").agg(F.count(F.lit(1)).alias("count"))
    value = lambda rows, kind, v: rows.select(F.lit(kind).alias("kind"), v.alias("value")).where(F.col("value") != "").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("count"))
    markers = utterances.select(F.explode(F.filter("tokens.normalized", looks_marked)).alias("t"))
    values = [value(documents, "topic", F.col("topic")), value(documents, "category", F.col("category")), value(utterances, "speaker", speaker_label()), value(markers, "marker", F.col("t"))]
    # by speaker first, so no value is counted as distinct
    spoken = utterances.groupBy("doc_id", "speaker_id").agg(F.count(F.lit(1)).alias("n"), F.min("sequence").alias("low"), F.max("sequence").alias("high"))
    return {
        "document_stats": spoken.groupBy("doc_id").agg(F.sum("n").alias("utterance_count"), F.min("low").alias("first_sequence"), F.max("high").alias("last_sequence"), F.count("speaker_id").alias("speaker_count")),
        "topic_stats": topics,
        "value_stats": reduce(DataFrame.union, values),
    }


def counted_terms(postings: DataFrame) -> DataFrame:
    """Every term by kind (raw and provided tokens, lemmas and tags) with its occurrences."""
    return postings.groupBy("kind", "term").agg(F.sum(F.size("rows")).cast("long").alias("count")).sortWithinPartitions("kind", "term")


def merged(name: str, batch: DataFrame, before: dict[str, DataFrame], rows: DataFrame) -> DataFrame:
    """A counted table with a batch's counts added. ``before`` has the tables without the batch, ``rows`` the batch's utterances.

    Counts add up; only the speakers of documents that go on in the batch are counted again, in those documents.
    """
    both = before[name].unionByName(batch)
    keys = {"topic_stats": ("category", "topic"), "token_stats": ("kind", "term"), "value_stats": ("kind", "value")}
    if name in keys:
        return both.groupBy(*keys[name]).agg(F.sum("count").alias("count"))
    on = batch.join(before[name].select("doc_id"), "doc_id", "left_semi").select("doc_id")
    said = before["utterances"].join(on, "doc_id", "left_semi").select("doc_id", "speaker_id").union(rows.join(on, "doc_id", "left_semi").select("doc_id", "speaker_id"))
    again = said.distinct().groupBy("doc_id").agg(F.count("speaker_id").alias("again"))
    summed = both.groupBy("doc_id").agg(F.sum("utterance_count").alias("utterance_count"), F.min("first_sequence").alias("first_sequence"), F.max("last_sequence").alias("last_sequence"), F.max("speaker_count").alias("speaker_count"))
    return summed.join(again, "doc_id", "left").withColumn("speaker_count", F.coalesce("again", "speaker_count")).drop("again")
