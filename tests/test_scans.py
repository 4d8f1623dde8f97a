"""What must not be shuffled or sorted: the corpus in a search for frequent terms, texts where sentences are drawn, the places of an index."""

import pytest

from lexispark.operators import lookup, merge
from lexispark.operators.filters import Filters
from lexispark.operators.search import Request, matched
from lexispark.sources import index
from samples import token_stats, utterances


def nodes(plan):
    children = plan.children()
    return [plan, *(n for k in range(children.size()) for n in nodes(children.apply(k)))]


@pytest.mark.parametrize(
    "request_", [Request('[text="the"]{1,2}', mode="cql"), Request('[text="the"] []{0,2} [text~"^o"]', mode="cql"), Request('[text="the"] [text="of"]', mode="cql"), Request("the", filters=Filters(category=("cat",))), Request("the")]
)
def test_frequent_terms_are_scanned(spark, monkeypatch, request_):
    monkeypatch.setattr(lookup, "KEYED", 0)
    rows = utterances(spark, [("d", "s", f"the of {k} the one of" if k % 2 else f"other {k}") for k in range(40)])
    stats = token_stats(rows)
    places = "transform(sequence(0, size(tokens) - 1), i -> named_struct('term', tokens[i].normalized, 'at', i))"
    postings = rows.selectExpr("corpus_id", "row_id", f"explode({places}) as x").groupBy("corpus_id", "x.term").agg({"row_id": "collect_list", "x.at": "collect_list"}).toDF("corpus_id", "term", "rows", "at").selectExpr("corpus_id", "'raw' as kind", "term", "0L as part", "rows", "at")
    index = lookup.Index(stats, postings, spark.createDataFrame([], "corpus_id string, gram string, part long, blocks array<long>"))
    found, plain = (matched(rows, stats, request_, x)[0].rows for x in (index, None))
    key = ["row_id", "ordinal", *(c for c in ("s", "e") if c in plain.columns)]
    assert sorted(found.select(*key).collect()) == sorted(plain.select(*key).collect()) != []
    assert not {n.nodeName() for n in nodes(found._jdf.queryExecution().optimizedPlan())} & {"Join", "Aggregate", "Window", "RepartitionByExpression"}


def test_sentences_are_drawn_without_their_texts(spark):
    plan = merge.sentences(utterances(spark, [("d", "a", "one"), ("d", "a", "two."), ("d", "b", "three.")]))._jdf.queryExecution().optimizedPlan()
    windows = [n.output().mkString(" ") for n in nodes(plan) if n.nodeName() == "Window"]
    assert windows and not any(f"{c}#" in x for x in windows for c in ("text", "form", "label", "utterance_id"))


def test_an_index_is_written_without_a_shuffle(spark):
    rows = utterances(spark, [("d", "s", f"the of {k}") for k in range(40)])
    for made in (index.postings(rows, 120, 40), index.grams(rows)):
        assert not {n.nodeName() for n in nodes(made._jdf.queryExecution().optimizedPlan())} & {"Join", "Aggregate", "Window", "RepartitionByExpression"}
