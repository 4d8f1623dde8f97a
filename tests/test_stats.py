"""Statistics and exploration against plain counting, with blanks, nulls, ties and empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from samples import token_stats, utterances

from lexispark.operators import explore, search, stats
from lexispark.operators.filters import Filters, filter_options
from lexispark.sources.index import postings
from lexispark.sources.tables import counted_terms, derived

DOCUMENTS = "corpus_id string, doc_id string, title string, topic string, category string, year string"


@pytest.fixture(scope="module")
def rows(spark):
    said = [("d", "a", "One {cough} two"), ("d", "b", "two two"), ("e", "a", ""), ("e", "", "{cough} {Sigh}"), ("f", "c", "..."), ("f", "c", "two")]
    rows = utterances(spark, said)
    rows = rows.withColumn("year", F.when(F.col("doc_id") == "f", F.lit(None)).otherwise(F.col("year")))
    return rows.withColumn("speaker_sex", F.when(F.col("speaker_id") == "a", "F").when(F.col("speaker_id") == "c", F.lit(None)).otherwise("")).cache()


@pytest.fixture(scope="module")
def documents(spark):
    data = [("c", "d", "One", "t", "k", "2020"), ("c", "e", None, "t", "", "2020"), ("c", "f", "50% off", "", None, None), ("c", "g", "none", "u", "k", "")]
    return spark.createDataFrame(data, DOCUMENTS).cache()


def counts(df, *fields):
    return {tuple(r[f] for f in fields[:-1]): r[fields[-1]] for r in df.collect()}


def test_derived(rows, documents):
    got = derived(rows.drop("corpus_id"), documents.drop("corpus_id"))
    want = Counter(t["normalized"] for r in rows.collect() for t in r["tokens"])
    assert {r["term"]: r["count"] for r in counted_terms(postings(rows.drop("corpus_id"), 5, 100)).where("kind = 'raw'").collect()} == want
    values = counts(got["value_stats"], "kind", "value", "count")
    assert {k: v for k, v in values.items() if k[0] == "topic"} == {("topic", "t"): 2, ("topic", "u"): 1}
    assert {k: v for k, v in values.items() if k[0] == "category"} == {("category", "k"): 2}
    assert {k: v for k, v in values.items() if k[0] == "speaker"} == {("speaker", "F / 미상"): 2, ("speaker", "미상 / 미상"): 4}
    assert {k: v for k, v in values.items() if k[0] == "marker"} == {("marker", "{cough}"): 2, ("marker", "{sigh}"): 1}
    assert counts(got["document_stats"], "doc_id", "utterance_count") == {("d",): 2, ("e",): 2, ("f",): 2}


def test_frequencies(rows):
    terms = token_stats(rows)
    everything = [tuple(r) for r in stats.token_frequency(rows, terms).collect()]
    assert everything == [("two", 4), ("{cough}", 2), ("...", 1), ("one", 1), ("{sigh}", 1)]  # ties by value
    assert [tuple(r) for r in stats.token_frequency(rows, terms, Filters(stopwords="TWO, one"), 2).collect()] == [("{cough}", 2), ("...", 1)]
    only = Filters(category=("cat",), corpus_id=("c",))
    assert [tuple(r) for r in stats.token_frequency(rows, terms, only).collect()] == everything
    assert stats.token_frequency(rows, terms, Filters(year=("none",))).count() == 0


def test_summary(rows):
    got = stats.summary(rows).first().asDict()
    assert got == {"corpus_count": 1, "document_count": 3, "utterance_count": 6, "speaker_count": 5, "token_count": 9, "non_speech_count": 3}
    assert stats.summary(rows, Filters(year=("2020",))).first()["utterance_count"] == 4
    assert set(stats.summary(rows.limit(0)).first()) == {0}


def test_distributions(rows, documents):
    values = derived(rows.drop("corpus_id"), documents.drop("corpus_id"))["value_stats"].withColumn("corpus_id", F.lit("c"))
    assert [tuple(r) for r in stats.distribution(rows, values, "topic").collect()] == [("t", 2), ("u", 1)]
    assert [tuple(r) for r in stats.distribution(rows, values, "topic", Filters(year=("2020",))).collect()] == [("top", 4)]
    assert [tuple(r) for r in stats.speaker_distribution(rows, values).collect()] == [("미상 / 미상", 4), ("F / 미상", 2)]
    assert [tuple(r) for r in stats.marker_distribution(rows, values, Filters(year=("2020",))).collect()] == [("{cough}", 2), ("{sigh}", 1)]


def test_explore(rows, documents):
    topics = documents.groupBy("corpus_id", "category", "topic").agg(F.count(F.lit(1)).alias("count"))
    tree = explore.tree(topics).first().asDict(True)
    assert tree["count"] == 4 and [(c["category"], c["count"], [t["topic"] for t in c["topics"]]) for c in tree["categories"]] == [("k", 2, ["t", "u"]), (None, 1, [""]), ("", 1, ["t"])]
    assert explore.topic_counts(topics, 1).count() == 3 and explore.tree(topics.limit(0)).count() == 0
    numbers = rows.groupBy("corpus_id", "doc_id").agg(F.count(F.lit(1)).alias("utterance_count"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"))
    listed = lambda **k: [(r["doc_id"], r["utterance_count"]) for r in explore.list_documents(documents, numbers, "c", **k).collect()]
    assert listed() == [("d", 2), ("e", 2), ("f", 2), ("g", 0)] and listed(limit=2, offset=1) == [("e", 2), ("f", 2)]
    assert listed(category="k") == [("d", 2), ("g", 0)] and listed(query="0%_o") == [("f", 2)] and listed(query="T", topic="t") == [("d", 2), ("e", 2)] and listed(query="zz") == []
    assert [r["sequence"] for r in explore.document_page(rows, "c", "d", 1, 5).collect()] == [2] and explore.document_page(rows, "c", "zz").count() == 0


def test_options(rows, documents, spark):
    speakers = spark.createDataFrame([("20", "F", ""), ("20", "M", None)], "age string, sex string, occupation string")
    got = {(r["kind"], r["value"]) for r in filter_options(documents, speakers).collect()}
    assert got == {("year", "2020"), ("category", "k"), ("topic", "t"), ("topic", "u"), ("sex", "F"), ("sex", "M"), ("age", "20")}


def test_export_of_nothing_and_nulls(rows, spark, tmp_path):
    corpora = spark.createDataFrame([], "corpus_id string, name string")
    hits, _ = search.matched(rows, token_stats(rows), search.Request("two"))
    assert search.export_csv(hits, corpora, f"file://{tmp_path}/a.csv") == 3
    line = (tmp_path / "a.csv").read_bytes().decode().split("\r\n")[3]
    assert line.split(",")[:7] == ["", "c", "f", "f.6", "c", "6", ""]
    hits, _ = search.matched(rows, token_stats(rows), search.Request("zzzz", mode="regex"))
    assert search.export_csv(hits, corpora, f"file://{tmp_path}/b.csv") == 0 and (tmp_path / "b.csv").read_bytes().count(b"\n") == 1
