"""The search index against scans, and search patterns against a slow translation."""

import random
import re

import pytest
from pyspark.sql import functions as F
from samples import token_stats, utterances

from lexispark.operators import cql, lookup, patterns, search
from lexispark.operators.filters import Filters
from lexispark.operators.lookup import Index
from lexispark.sources import index as indexed
from lexispark.sources.store import Store

SPACE = "[\\t-\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
#: A piece in the dialect, and the same for Python.
PIECES = [
    ("a", "a"), ("b", "b"), ("한", "한"), ("\U0001f600", "\U0001f600"), (r"\s", SPACE), (r"\S", SPACE.replace("[", "[^", 1)), (".", "[^\\n\\r\\u2028\\u2029]"), (r"\w", "[A-Za-z0-9_]"), (r"\d", "[0-9]"), ("[^]", "[\\s\\S]"), ("[ab한]", "[ab한]"),
    ("[^a\\s]", "(?!a|" + SPACE + ")[\\s\\S]"), (r"[\w-]", "[A-Za-z0-9_-]"), (r"\u{61}", "a"), (r"😀", "\U0001f600"), (r"\x62", "b"), (r"\b", "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"),
    (r"\B", "(?:(?<=[A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<![A-Za-z0-9_])(?![A-Za-z0-9_]))"), ("^", r"\A"), ("$", r"\Z"), ("(?=b)", "(?=b)"), ("(?<!a)", "(?<!a)"), (r"\.", r"\."), ("[.&&b[]", "[.&b\\[]"), (r"\p{Script=Hangul}", "[가-힣]"),
]
SIGNS = ["a", "b", "ab", "aba", "한", "\U0001f600", " ", "　", " ", "\u0085", "\n", "1", "_", ".", "&", "[", "é"]


def piece(rnd, depth=0):
    k = rnd.random()
    if depth < 3 and k < 0.25:
        parts = [piece(rnd, depth + 1) for _ in range(rnd.randint(1, 3))]
        js, py = "".join(p[0] for p in parts), "".join(p[1] for p in parts)
        if k < 0.1:
            other = piece(rnd, depth + 1)
            js, py = f"{js}|{other[0]}", f"{py}|{other[1]}"
        js, py = f"({js})", f"({py})"
    else:
        js, py = rnd.choice(PIECES)
        if js in (r"\b", r"\B", "^", "$", "(?=b)", "(?<!a)"):
            return js, py
    times = rnd.choice(["", "", "", "?", "+", "*", "{2}", "{1,2}", "+?"])
    return js + times, (f"(?:{py})" if times else py) + times


def holds(need, text):
    if need is None or isinstance(need, str):
        return need is None or need in text
    return (all if isinstance(need, patterns.AllOf) else any)(holds(n, text) for n in need.needs)


def test_patterns_equal_a_slow_translation(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 9))) for _ in range(150)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1).cache()
    made = [tuple("".join(x) for x in zip(*[piece(rnd) for _ in range(rnd.randint(1, 4))], strict=True)) for _ in range(150)]
    got = rows.select("k", *(F.col("t").rlike(cql.java_regex(js)).alias(f"p{i}") for i, (js, _) in enumerate(made))).orderBy("k").collect()
    for i, (js, py) in enumerate(made):
        want = [bool(re.search(py, t)) for t in texts]
        assert [r[f"p{i}"] for r in got] == want, js
        need = patterns.compiled(js)[1]
        assert all(holds(need, t) for t, w in zip(texts, want, strict=True) if w), (js, need)


@pytest.mark.parametrize(
    ("pattern", "need"),
    [
        ("abc", "abc"), ("abc|abd", patterns.AnyOf(("abc", "abd"))), ("ab?c", patterns.AllOf(("a", "c"))), ("xy+z", patterns.AllOf(("xy", "yz"))), ("x{3}y", "xxxy"), ("(abc|d)e", patterns.AllOf((patterns.AnyOf(("abc", "d")), "e"))),
        ("a\\bb", "ab"), ("(abc)*", None), (".*", None), ("ab(?=cd)ef", "abef"), ("abc|.", None), ("tion[a-z]{3}s", patterns.AllOf(("tion", "s"))), ("\\u{d55c}글", "한글"), ("(?<x_1>ab)\\k<x_1>", "ab"), ("a{0}b", "b"), ("(ab){2,}c", patterns.AllOf(("ab", "c"))),
    ],
)
def test_needs(pattern, need):
    assert patterns.compiled(pattern)[1] == need


@pytest.mark.parametrize("bad", ["a**", "a++", "(", ")", "[", "a{2,1}", "{", "}", "]", "\\", "\\y", "[b-a]", "[\\w-z]", "?", "(?<a>x)(?<a>y)", "\\p{Nothing}", "(?i:a)", "^*", "(?=a)+", "\\u{110000}", "\\k<none>", "a{,2}"])
def test_bad_patterns(spark, bad):
    with pytest.raises(ValueError, match="not a regular expression"):
        cql.java_regex(bad)


def test_ranges_hold_all_ids():
    rnd = random.Random(3)
    for _ in range(200):
        ids = sorted(rnd.sample(range(300), rnd.randint(1, 40)))
        for most in (1, 2, 5, 64):
            found = lookup.ranges(ids, most)
            assert len(found) <= most and all(any(a <= k <= b for a, b in found) for k in ids)
            assert found == sorted(found) and all(a <= b for a, b in found)
    assert lookup.ranges([]) == []
    assert lookup.ranges([1, 2, 9, 10], 2) == [(1, 2), (9, 10)]


def rows_of(spark, n=400, seed=2):
    rnd = random.Random(seed)
    words = ["sea", "Seagull", "gulls", "of", "of", "of", "the", "한국어", "바다", "\U0001f600\U0001f601x", "ab%c", "x_y", "É", "{laugh}", "운동장에서"]
    return utterances(spark, [(f"d{k % 7}", f"s{k % 3}", " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9)))) for k in range(n)])


def index_of(rows, tokens=None):
    many = rows.agg(F.sum(F.size("tokens"))).first()[0]
    with_id = lambda df: df.withColumn("corpus_id", F.lit("c"))
    return Index(token_stats(rows), with_id(indexed.postings(rows.drop("corpus_id"), tokens or many, 400)), with_id(indexed.grams(rows.drop("corpus_id"))))


@pytest.mark.parametrize("places", [1, 7, 1000])
def test_postings_are_all_places_in_order(spark, monkeypatch, places):
    monkeypatch.setattr(indexed, "PLACES", places)
    monkeypatch.setattr(indexed, "EMITTED", 5)
    monkeypatch.setattr(indexed, "TOKENS", 20)
    rnd = random.Random(places)
    ids = rnd.sample(range(1, 90), 60)  # in no order
    word = lambda: rnd.choice(["a", "b", "\U0001f600", "", None])
    data = [(i, None if i % 9 == 0 else [(word(),) for _ in range(rnd.randint(0, 5))], [(word(), word(), word()) for _ in range(rnd.randint(0, 3))]) for i in ids]
    rows = spark.createDataFrame(data, "row_id long, tokens array<struct<normalized:string>>, provided array<struct<normalized:string,lemma:string,pos:string>>").coalesce(2)
    layers = {"raw": (1, 0), "provided": (2, 0), "lemma": (2, 1), "pos": (2, 2)}
    want = sorted((kind, x[f], r[0], at) for r in data for kind, (c, f) in layers.items() for at, x in enumerate(r[c] or []) if x[f] is not None)
    got = indexed.postings(rows, 100, 89).collect()
    assert sorted((r["kind"], r["term"], row, at) for r in got for row, at in zip(r["rows"], r["at"], strict=True)) == want
    for r in got:
        assert list(zip(r["rows"], r["at"], strict=True)) == sorted(zip(r["rows"], r["at"], strict=True)) and {row // 18 for row in r["rows"]} == {r["part"]}


def test_each_row_of_a_term_lies_in_one_entry(spark, monkeypatch):
    monkeypatch.setattr(indexed, "PLACES", 5)
    monkeypatch.setattr(indexed, "EMITTED", 1)
    rows = utterances(spark, [("d", "s", "sea of sea of sea of sea of sea") for _ in range(30)])
    entries = indexed.postings(rows, 270, 30).where("kind = 'raw' AND term = 'sea'").collect()
    assert sorted(row for r in entries for row in set(r["rows"])) == list(range(1, 31))


REQUESTS = [
    *(search.Request(q, field=f) for q in ("sea", "the", "of the", "eagul", "SEAGULL o", "한국", "한국어 바", "동장에", "\U0001f600\U0001f601", "ab%c", "f_the", "%", "x_y", "zzz", "ulls of the sea", "laugh} ", "É") for f in ("form", "original_form")),
    *(search.Request(q, mode="regex") for q in ("of\\sthe", "gul+s\\b", "(sea|of) the", "한국어|바다 of", "[^]{3}", "^sea", "no such thing", "x_y$", "바다{1,2}")),
    *(search.Request(q, mode="cql") for q in ('[text="of"] [text="the"]', '[text="sea"] []{0,3} [text="of"]', '[text="of"] []{1,2} [text="of"]', '[text="of"]{2}', '[text="gulls"] [text~"a"] [text="of"]', '[text="none"] [text="of"]', '[]{2}', '[lemma="gull"] [pos="NN"]', '[text="the"]{0,1} [text="sea"]', '[pos="NNS"] [] [lemma="of"]')),
]


@pytest.mark.parametrize("small", [False, True])
def test_index_finds_what_the_scan_finds(spark, monkeypatch, small):
    if small:
        for module, name, value in ((indexed, "BLOCK", 4), (lookup, "BLOCK", 4), (indexed, "BLOCKS", 8), (indexed, "TOKENS", 100), (indexed, "SIGNS", 50), (indexed, "PAIRS", 30), (lookup, "RANGES", 3), (lookup, "KEYED", 25)):
            monkeypatch.setattr(module, name, value)
    rows = rows_of(spark).cache()
    stats_, index = token_stats(rows).cache(), index_of(rows)
    index = Index(index.token_stats.cache(), index.postings.cache(), index.grams.cache())
    found = lambda hits: sorted(tuple(r) for r in hits.rows.select("row_id", "ordinal", *(["s", "e"] if hits.shown is None else [])).collect())
    every = REQUESTS[1::3] if small else REQUESTS[::2]
    for k, request in enumerate(every):
        if k % 3 == 2:  # a filter besides
            request = search.Request(request.query, request.mode, request.field, filters=Filters(category=("cat",) if k % 2 else ("none",), source="provided" if k % 5 == 0 else "raw"))
        slow, warned = search.matched(rows, stats_, request)
        fast, warned2 = search.matched(rows, stats_, request, index)
        assert warned == warned2 and (slow is None) == (fast is None), request
        if slow is not None:
            want = found(slow)
            assert found(fast) == want, request
            if fast.keys is not None:
                assert sorted(tuple(r) for r in fast.keys.select("row_id", "ordinal", *(["s", "e"] if fast.shown is None else [])).collect()) == want, request


def scanned(df) -> int:
    """Rows that the scans of utterances gave."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0

    def walk(node):
        nonlocal total
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            walk(node.executedPlan())
            return
        if node.nodeName().startswith("Scan parquet") and "form" in node.simpleString(200):
            total += node.metrics().apply("numOutputRows").value()
        for i in range(node.children().size()):
            walk(node.children().apply(i))
        if node.nodeName().startswith(("ShuffleQueryStage", "BroadcastQueryStage")):
            walk(node.plan())

    walk(plan)
    return total


def test_look_ups_read_some_pages_only(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    lines = [f"line {k} of many" if k % 5000 else f"line {k} rare cormorant" for k in range(60_000)]
    names = utterances(spark, [("d", "s", "x")]).drop("corpus_id", "tokens")
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "row_id long, form string").coalesce(2)
    for f in names.schema.fields:
        if f.name not in ("row_id", "form"):
            value = F.col("form") if f.name == "original_form" else F.col("row_id").cast(f.dataType) if f.name in ("utterance_id", "sequence") else F.array().cast("array<struct<surface:string,lemma:string,pos:string>>") if f.name == "provided" else F.lit(None if f.name in ("time", "start", "end") else "d").cast(f.dataType)
            rows = rows.withColumn(f.name, value)
    documents = spark.createDataFrame([("d",)], "doc_id string").withColumns({c: F.lit("") for c in ("title", "author", "publisher", "date", "topic", "category", "year", "metadata")})
    store.publish({"corpus_id": "c", "name": "c", "source_path": "c"}, rows, documents, spark.createDataFrame([], "doc_id string, speaker_id string, age string, occupation string, sex string, birthplace string, principal_residence string, current_residence string, education string, device string, keyboard string, metadata string"), 1)
    stored, terms = store.table("utterances"), store.table("token_stats")
    for request, n in ((search.Request("re cormor"), 12), (search.Request("rare corm.rant", mode="regex"), 12), (search.Request('[text="rare"] [text~"c"]', mode="cql"), 12)):
        hits, _ = search.matched(stored, terms, request, store.index())
        assert hits.rows.count() == n
        assert scanned(hits.rows.select("row_id", "form")) < 0.5 * len(lines), request
        slow, _ = search.matched(stored, terms, request)
        assert scanned(slow.rows.select("row_id", "form")) == len(lines)


@pytest.mark.parametrize("request_", [search.Request("of", limit=7), search.Request("eagul", limit=5), search.Request('[text="of"] []{0,2} [text="of"]', mode="cql", limit=9), search.Request("sea|the", mode="regex", limit=40)])
def test_pages_by_cursor_are_pages_by_offset(spark, request_):
    from dataclasses import replace

    rows = rows_of(spark, 90).cache()
    stats_, index = token_stats(rows).cache(), index_of(rows)
    hits, _ = search.matched(rows, stats_, request_)
    want = [tuple(r) for r in hits.rows.orderBy(*search.ORDER).select("row_id", "ordinal").collect()]
    got, request, pages = [], request_, 0
    while True:
        page = search.search(rows, stats_, request, index)
        got += [tuple(r) for r in page.rows.orderBy(*search.ORDER).select("row_id", "ordinal").collect()]
        pages += 1
        if not page.has_more:
            break
        request = replace(request_, after=page.cursor)
    assert got == want and pages == max(1, -(-len(want) // request_.limit))
    with pytest.raises(ValueError, match="not a cursor"):
        search.search(rows, stats_, replace(request_, after="!!"), index)
