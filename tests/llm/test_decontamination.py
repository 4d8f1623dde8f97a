import random
from collections import Counter

import pytest
from cases import no_documents, odd_documents
from pyspark.sql import functions as F

from lexispark.llm import decontamination, queries

SF = "/root/testdata/sf0.001"


def grams(w, width):
    return Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def slow_leaks(docs, items):
    """The best similarity of each document and item over all windows, if it reaches 0.8."""
    out = {}
    for d, text in docs:
        w = (text or "").lower().split()
        for i, it in items:
            x = (it or "").lower().split()
            if not x:
                continue
            width, n = min(5, len(x)), min(len(x), len(w))
            b = grams(x, width)
            for s in range(len(w) - n + 1 if w else 0):
                a = grams(w[s : s + n], width)
                both, union = sum((a & b).values()), sum((a | b).values())
                if union and 100 * both >= 80 * union:
                    out[d, i] = max(out.get((d, i), 0), both / union)
    return out


@pytest.fixture(scope="module")
def planted():
    """Documents with changed items in them, the items, and what brute force finds."""
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [text(n) for n in (1, 3, 4, 5, 6, 9, 15, 22, 31, 40, 59, 120)] + [["a"] * 30, ["b", "c"] * 20]
    docs = []
    for k in range(120):
        w = text(rnd.randint(0, 200))
        for it in rnd.sample(items[3:], 2):
            it = list(it)
            for _ in range(rnd.choice([0, 0, 0, 1, 2])):
                at = rnd.randrange(len(it))
                rnd.choice([lambda: it.pop(at), lambda: it.insert(at, "new"), lambda: it.__setitem__(0, "first"), lambda: it.__setitem__(-1, "last")])()
                if len(it) < 2:
                    break
            at = rnd.randint(0, len(w))
            w[at:at] = it
        docs.append((k, " ".join(x.upper() if rnd.random() < 0.1 else x for x in w)))
    docs += [(500, " ".join(items[9][:36])), (501, " ".join(items[8])), (502, "a " * 40), (503, "b c " * 50)]
    items = [(k, " ".join(w)) for k, w in enumerate(items)]
    want = slow_leaks(docs, items)
    assert len(want) > 150
    return docs, items, want


@pytest.mark.parametrize(("small", "blocks"), [(True, 24), (False, 24), (True, 64)])
def test_against_brute_force(spark, monkeypatch, planted, small, blocks):
    if not small:
        monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", 0)
    docs, items, want = planted
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), blocks=blocks).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in got}
    assert set(got) <= set(want) and (blocks < 64 or set(got) == set(want))
    # a fingerprint of few shingles may lie beyond the radius though its window is similar, at the edge of the threshold only
    missed = set(want) - set(got)
    assert all(want[k] < 0.9 for k in missed) and len(missed) <= 0.005 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 or want[k] < 0.95 for k in got)


def test_simhash(spark):
    rnd = random.Random(2)
    rows = [[rnd.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 3, 8, 20, 63)]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "a array<bigint>").select(decontamination.simhash(F.col("a"), 6)).collect()]
    for g, r in zip(got, rows, strict=True):
        want = sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in r) > len(r))
        assert g % (1 << 64) == want


@pytest.mark.parametrize("extra", [False, True])
def test_odd(spark, extra):
    docs = odd_documents(spark, extra)
    items = spark.createDataFrame([(1, None), (2, ""), (None, "the cat sat on the mat while seven"), (3, "x"), (3, "x"), (4, "word " * 40)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).collect()}
    assert got == {(0, None), (6, None), (8, None), (4, 3), (5, 4)}
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in decontamination.decontaminate(docs, items).collect()) == [-1, 1, 2, 3, 7]
    assert decontamination.decontaminate(docs, items).columns == docs.columns
    assert decontamination.leaks(no_documents(spark), items).count() == 0
    assert decontamination.leaks(docs, items.limit(0)).count() == 0


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {tuple(w[i : i + 5]) for _, t in items for w in [t.lower().split()] for i in range(len(w) - 4)}
    near = [(d, t) for d, t in docs if any(tuple(w[i : i + 5]) in found for w in [t.lower().split()] for i in range(len(w) - 4))]
    want = slow_leaks(near, items)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in queries.op2_decontamination(spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_edge_of_the_threshold(spark):
    rnd = random.Random(8)
    items = [(k, [f"i{k}w{rnd.randrange(10**6)}" for _ in range(50)]) for k in range(20)]
    # one word in the middle leaves 41 of 46 shingles, a similarity of 0.804
    docs = [(100 * k + at, " ".join([*w[:at], "new", *w[at + 1 :]])) for k, w in items for at in range(5, 45)]
    items = [(k, " ".join(w)) for k, w in items]
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, d // 100) for d, _ in docs}
