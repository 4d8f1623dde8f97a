import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import PROSE, no_documents, odd_documents
from pyspark.sql import functions as F

from lexispark.llm import jaccard_join, queries

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_components(rows):
    """(key, set size, smallest linked key) of each row, over all pairs."""
    sets = [(k, shingles(t)) for k, t in rows]
    seen, group = defaultdict(list), list(range(len(sets)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, s) in enumerate(sets):
        shared = Counter(j for g in s for j in seen[g])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                group[root(i)] = root(j)
        for g in s:
            seen[g].append(i)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[root(i)] = min((x for x in (least.get(root(i)), k) if x is not None), default=None)
    return [(k, len(s), least[root(i)]) for i, (k, s) in enumerate(sets)]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()]
    order = lambda x: [(-1 if v is None else v) for v in x]
    assert sorted(got, key=order) == sorted(slow_components(rows), key=order)


@pytest.mark.parametrize(("block", "heavy"), [(2000, 750_000), (3, 750_000), (2000, 32)])
def test_near_copies(spark, monkeypatch, block, heavy):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "HEAVY", heavy)  # with 32 all classes are in the sample, and shingles of 8 classes are heavy
    monkeypatch.setattr(jaccard_join, "RANGE_SHINGLES", 500)
    rnd = random.Random(3)
    vocabulary = [f"v{k}" for k in range(300)]
    rows, common = [], " ".join(rnd.choice(vocabulary) for _ in range(30))
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(6, 120))]
        for _ in range(8):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((len(rows) + 10, " ".join(w) + (" " + common if rnd.random() < 0.4 else "")))
        rows.append((len(rows) + 10, rows[-1][1].upper()))
    chain = [f"c{k}" for k in range(60)]
    rows += [(900 - k, " ".join(chain[k : k + 48])) for k in range(12)]  # each is linked with its neighbours only
    check(spark, rows)


def test_heavy_shingles_and_even_keys(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HEAVY", 32)
    texts = [f"all share this line here x{k} y{k}" for k in range(10)] + [f"two of them do z{k // 2}" for k in range(26)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = jaccard_join._heavy(rows, 0, 36)
    common = {int(h) for h in jaccard_join.shingle_sets(pa.array(["all share this line here"], pa.large_string()))[1]}
    assert {int(h) for h in found} == common and len(jaccard_join._heavy(rows, 0, 31)) == 0
    for n in (1, 7, 40):
        keys = jaccard_join._even_keys(spark, n)
        where = spark.createDataFrame([(int(k),) for k in keys], "k int").selectExpr(f"pmod(hash(k), {n}) as p").collect()
        assert sorted(r["p"] for r in where) == list(range(n))


def test_count_of_links(spark):
    rnd = random.Random(9)
    base, rows = [f"w{k}" for k in range(60)], []
    for k in range(14):
        w = list(base)
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(60)] = f"x{rnd.randrange(99)}"
        rows.append((k, " ".join(w)))
    rows += [(20, rows[0][1]), (21, "all alone here with these words"), (22, None)]
    sets = {k: frozenset(shingles(t)) for k, t in rows}
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), count_links=True).collect()}
    assert got == {k: sum(1 for x in set(sets.values()) if x and s and x != s and near(s, x)) for k, s in sets.items()}


def test_thresholds(spark):
    words = [f"t{k}" for k in range(40)]
    check(spark, [(k, " ".join(words[: n + 4])) for k, n in enumerate((8, 10, 11, 12, 13, 15, 16, 20, 25, 26))])
    check(spark, [(1, "a b c d"), (2, "A B\tC d"), (3, "a b c"), (4, "a b c d e"), (5, "a b c d e"), (None, "a b c"), (7, None), (8, ""), (9, " \n")])


@pytest.mark.parametrize("extra", [False, True])
def test_odd(spark, extra):
    docs = odd_documents(spark, extra)
    order = lambda x: [(-1 if v is None else v) for v in x]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()), key=order)
    assert got == sorted(slow_components([(r["doc_id"], r["text"]) for r in docs.collect()]), key=order)
    assert jaccard_join.near_duplicates(no_documents(spark)).count() == 0


def test_walk():
    rnd = np.random.default_rng(4)
    probe = np.unique(rnd.integers(0, 300, 120))
    paths = sorted((np.sort(rnd.choice(300, rnd.integers(0, 150), replace=False)) for _ in range(200)), key=lambda p: p.astype(">i8").tobytes())
    need = [int(x) for x in rnd.integers(0, 60, 200)]
    for p, least, got in zip(paths, need, jaccard_join.walk(probe, paths, need), strict=True):
        n = len(np.intersect1d(probe, p))
        assert got == (n if n >= least else -1)


def test_sets_of_batches():
    texts = ["a b c d e f", "", "x y", " A  b c d e\nf "]
    of, h = jaccard_join.shingle_sets(pa.array(texts, pa.large_string()))
    assert of.tolist() == [0, 0, 2, 3, 3] and h[:2].tolist() == h[3:].tolist()


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op8_jaccard_join(spark, SF).collect()]
    assert sorted(got) == sorted(slow_components(rows))


def test_dealing_takes_the_same_time_at_any_number_of_ranges():
    """A task makes rows for the ranges of the first step only."""
    import time

    rng = np.random.default_rng(1)
    words = np.array([f"w{k}" for k in range(5000)])
    texts = [" ".join(rng.choice(words, 400)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    seconds, rows = {}, {}
    for ranges in (500, 1000, 100_000, 1_000_000):
        begun = time.perf_counter()
        rows[ranges] = sum(b.num_rows for b in jaccard_join.deal([batch], 0, np.arange(ranges), np.zeros(0, np.uint64), jaccard_join._width(ranges)))
        seconds[ranges] = time.perf_counter() - begun
    packs = -(-2000 * 396 // jaccard_join.PACKED)  # each makes a row for a range of the first step at most
    assert max(rows.values()) <= packs * jaccard_join.FAN and seconds[1_000_000] < 3 * seconds[500]


@pytest.mark.parametrize("heavy", [False, True])
def test_two_steps_of_dealing_give_the_same(spark, monkeypatch, heavy):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, jaccard_join.near_duplicates(docs, count_links=True).collect()))
    monkeypatch.setattr(jaccard_join, "RANGE_SHINGLES", 2000)
    monkeypatch.setattr(jaccard_join, "FAN", 3)
    if heavy:
        monkeypatch.setattr(jaccard_join, "HEAVY", 20)
        monkeypatch.setattr(jaccard_join, "HEAVY_SAMPLE", 20)
    assert sorted(map(tuple, jaccard_join.near_duplicates(docs, count_links=True).collect())) == want


def test_representatives_of_rows_with_maps(spark):
    docs = spark.createDataFrame([(1, PROSE * 3), (1, PROSE * 3), (2, PROSE * 3), (3, "other words that stand alone here"), (4, None)], "doc_id long, text string")
    docs = docs.withColumn("m", F.expr("map('k', doc_id)")).withColumn("s", F.expr("named_struct('a', if(doc_id = 1, null, 1), 'b', array(null, doc_id))"))
    assert sorted(r["doc_id"] for r in jaccard_join.representatives(docs).collect()) == [1, 3, 4]
