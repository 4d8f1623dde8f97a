"""Token patterns against backtracking, search, export and collocations."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from samples import token_stats, utterances

from lexispark.operators import collocation, cql, search
from lexispark.operators.filters import Filters


def test_parse():
    e = cql.parse(' [ text = "sea" ]{2}[]{0,4} [pos~"^N"]  [lemma="a\\"b"] ')
    assert [(x.least, x.most, x.field, x.op, x.value) for x in e] == [(2, 2, "text", "=", "sea"), (0, 4, None, None, None), (1, 1, "pos", "~", "^N"), (1, 1, "lemma", "=", 'a"b')]


@pytest.mark.parametrize("bad", ["", "  ", "sea", '[text="a"] x [text="b"]', '[word="x"]', "[]{3,2}", '[text="a"', '[text="a]', "[]{1,}", "[]{x}", "[]+", '[text="a" text="b"]', '[text=a]', "]"])
def test_parse_refuses(bad):
    with pytest.raises(ValueError, match="not a token pattern"):
        cql.parse(bad)


def slow_matches(elements, words):
    out = []

    def fits(e, w):
        value = {"text": w, "lemma": w.rstrip("s"), "pos": "NNS" if w.endswith("s") else "NN"}.get(e.field)
        return e.field is None or (value == e.value if e.op == "=" else e.value in value)

    def walk(k, at, start):
        if k == len(elements):
            out.append((start, at))
            return
        for n in range(elements[k].least, elements[k].most + 1):
            if at + n <= len(words) and all(fits(elements[k], w) for w in words[at : at + n]):
                walk(k + 1, at + n, start)

    for s in range(len(words)):
        walk(0, s, s)
    return out


def test_matches_random(spark):
    rnd = random.Random(1)
    lines = [" ".join(rnd.choice(["ab", "abs", "cs", "d"]) for _ in range(rnd.randint(0, 7))) for _ in range(60)]
    rows = utterances(spark, [("d", "s", t) for t in lines]).cache()
    conditions = ["[]", '[text="ab"]', '[text="cs"]', '[text~"b"]', '[lemma="ab"]', '[pos="NNS"]', '[pos~"S"]']
    for _ in range(14):
        parts = []
        for _ in range(rnd.randint(1, 3)):
            least = rnd.randint(0, 2)
            parts.append(rnd.choice(conditions) + rnd.choice(["", f"{{{least},{least + rnd.randint(0, 2)}}}"]))
        query = " ".join(parts)
        want = [(k, i, s, e) for k, t in enumerate(lines, 1) for i, (s, e) in enumerate(slow_matches(cql.parse(query), t.split()))]
        got = [(r["row_id"], r["ordinal"], r["s"], r["e"]) for r in cql.search(rows, query, "provided").orderBy("row_id", "ordinal").collect()]
        assert got == want, query


def find(spark, rows, *args, **kwargs):
    page = search.search(rows, token_stats(rows), search.Request(*args, **kwargs))
    return page, None if page.rows is None else [(r["utterance_id"], r["left"], r["hit"], r["right"]) for r in page.rows.orderBy("row_id", "ordinal").collect()]


def test_search(spark):
    rows = utterances(spark, [("d", "s", "Grey gulls cross the bay"), ("d", "s", "Two gulls, one bay."), ("e", "t", "no birds at all"), ("e", "t", "")]).cache()
    page, got = find(spark, rows, "GULLS", limit=1)
    assert page.has_more and got == [("d.1", ["Grey"], ["gulls"], ["cross", "the", "bay"])]
    page, got = find(spark, rows, "gulls", limit=5, offset=1, context=1)
    assert not page.has_more and got == [("d.2", ["Two"], ["gulls,"], ["one"])]
    assert find(spark, rows, '[text="gulls"] []{0,3} [text="bay"]', "cql")[1] == [("d.1", ["Grey"], ["gulls", "cross", "the", "bay"], []), ("d.2", ["Two"], ["gulls,", "one", "bay."], [])]
    assert [g[2] for g in find(spark, rows, '[pos="NNS"]', "cql")[1]] == [["gulls"], ["cross"], ["gulls"], ["birds"]]
    assert [g[2] for g in find(spark, rows, "ulls, o")[1]] == [["Two", "gulls,", "one", "bay."]]
    assert [g[2] for g in find(spark, rows, "^no|y\\.$", "regex")[1]] == [["bay."], ["no"]]
    for args in (("x",), ("  ",), ("(", "regex"), ("[", "cql")):
        page, got = find(spark, rows, *args)
        assert got is None and page.warnings
    assert find(spark, rows, "gulls", filters=Filters(category=("other",)))[1] == []


def test_export(spark, tmp_path):
    rows = utterances(spark, [("d", "s", 'say "hi", gulls'), ("d", "s", "two\ngulls", None, 1.5, 3.0), ("d", "s", " gulls ")])
    hits, _ = search.matched(rows, token_stats(rows), search.Request("gulls"))
    path = tmp_path / "out.csv"
    assert search.export_csv(hits, spark.createDataFrame([("c", "Corpus, one")], "corpus_id string, name string"), f"file://{path}") == 3
    lines = path.read_bytes().decode("utf-8").split("\r\n")
    assert lines[0] == "﻿" + ",".join(search.CSV) and len(search.CSV) == 21 and lines[4:] == [""]
    assert lines[1] == '"Corpus, one",c,d,d.1,s,1,2020,cat,top,,,,,,,"say ""hi"",",gulls,,"say ""hi"", gulls","say ""hi"", gulls",'
    assert lines[2] == '"Corpus, one",c,d,d.2,s,2,2020,cat,top,,1.5,3,,,,two,gulls,,"two\ngulls","two\ngulls",'
    assert lines[3].endswith(",,gulls,, gulls , gulls ,")


def test_collocations(spark):
    rnd = random.Random(5)
    lines = [" ".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 12))) for _ in range(80)]
    rows = utterances(spark, [("d", "s", t) for t in lines]).cache()
    words, near, nodes = Counter(), Counter(), 0
    for t in lines:
        w = t.split()
        words.update(w)
        for i, x in enumerate(w):
            if x == "a":
                nodes += 1
                near.update((y, "left" if j < i else "right") for j, y in enumerate(w) if j != i and abs(i - j) <= 2 and y != "b")
    got = collocation.collocations(rows, token_stats(rows), "A,", 2, 2, filters=Filters(stopwords="a b"))
    assert (got.node_count, got.total_tokens) == (nodes, sum(words.values()))
    assert {(r["token"], r["side"]): r["frequency"] for r in got.rows.collect()} == {k: n for k, n in near.items() if n >= 2}
    for r in got.rows.collect():
        expected = nodes * words[r["token"]] / sum(words.values())
        assert math.isclose(r["mi"], math.log2(r["frequency"] / expected)) and math.isclose(r["t_score"], (r["frequency"] - expected) / math.sqrt(r["frequency"]))
    capped = collocation.collocations(rows, token_stats(rows), "a", 2, 1, max_occurrences=3)
    assert capped.node_count == nodes and capped.warnings and capped.rows.agg(F.sum("frequency")).first()[0] <= 12
    assert collocation.collocations(rows, token_stats(rows), "zzz").rows.count() == 0


def test_odd_rows(spark):
    rows = utterances(spark, [("d", "s", ""), ("d", "s", "..."), ("d", "s", "word " * 4000)])
    empty = rows.limit(0)
    assert [r["e"] for r in cql.search(rows, '[text="word"]{3} [text="word"]').where("s = 3996").collect()] == [4000]
    assert find(spark, empty, "abc")[1] == [] and cql.search(empty, "[]").count() == 0
    assert collocation.collocations(empty, token_stats(empty), "a").rows.count() == 0
