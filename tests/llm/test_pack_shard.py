import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from cases import no_documents, odd_documents

from lexispark.llm import packing, queries, sharding

SF = "/root/testdata/sf0.001"


def check_shards(got, docs, n):
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs)
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r["shard"] < n
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return [sizes[k] for k in range(n)]


@pytest.mark.parametrize("extra", [False, True])
def test_shards_odd(spark, extra):
    docs = odd_documents(spark, extra)
    rows = docs.collect()
    got = sharding.shard(docs, 3).collect()
    check_shards(got, rows, 3)
    for r in got:
        text = next(d["text"] for d in rows if d["doc_id"] == r["doc_id"]) or ""
        assert (r["size"], r["text_crc32"]) == (len(text.encode()) + 8, zlib.crc32(text.encode()))
    assert sharding.shard(no_documents(spark), 3).count() == 0


def test_shards_hot_group(spark):
    texts = ["same old text again"] * 800 + [f"text number {k} of many" for k in range(1600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.shard(docs, 4, atoms_per_shard=64).collect()
    sizes = check_shards(got, docs.collect(), 4)
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 4


def test_equal_texts_stay_together_unless_larger_than_a_shard(spark):
    """15 per cent of the rows are null and more than a shard by rows, not by bytes."""
    texts = [None if k % 20 < 3 else f"number {k} " * (3 + k % 9) for k in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.shard(docs, 24).collect()
    sizes = check_shards(got, docs.collect(), 24)
    assert len({r["shard"] for r in got if texts[r["doc_id"]] is None}) == 1
    assert max(sizes) - min(sizes) <= max(len(t or "") for t in texts) + 16


@pytest.mark.parametrize("seed", range(3))
def test_pack_vectors_replayed(seed):
    rnd = np.random.default_rng(seed)
    vectors = np.vstack([rnd.integers(1, 50, (200, 3)), [[10, 10, 900], [700, 5, 5]]]).astype(float)
    bins = sharding.pack_vectors(vectors, 5)
    share = vectors.sum(axis=0) / 5
    held = np.zeros((5, 3))
    for k in sorted(range(len(vectors)), key=lambda k: (-max(vectors[k] / share), k)):
        v = vectors[k] / share
        left = 1 - held
        room = [b for b in range(5) if left[b][0] >= v[0] - 1e-9]
        whole = [b for b in room if (left[b] >= v - 1e-9).all()]
        if room:
            best = max(whole or room, key=lambda b: (round(float(left[b] @ v), 9), -b))
            assert round(float(left[bins[k]] @ v), 9) == round(float(left[best] @ v), 9) and bins[k] in (whole or room)
        else:
            assert left[bins[k]][0] == max(left[:, 0])
        held[bins[k]] += v
    assert abs(held[:, 0] - 1).max() < 0.2


def test_shard_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.op5_sharding(spark, SF).collect()
    sizes = check_shards(got, docs, 24)
    largest = max(len(d["text"].encode()) + 8 for d in docs)
    assert max(sizes) - min(sizes) <= largest
    text = {d["doc_id"]: d["text"] for d in docs}
    at = defaultdict(set)
    for r in got:
        at[text[r["doc_id"]]].add(r["shard"])
    assert all(len(x) == 1 for x in at.values())


@pytest.mark.parametrize("seed", range(4))
def test_pack_group_is_best_fit(seed):
    """Replays the placements: each piece is in the tightest of all bins that it fits and does not conflict with."""
    rnd = random.Random(seed)
    rows = [(rnd.randint(1, 100), k, 0, rnd.choice("aaabc"), rnd.choice([1, 2, 100 + k])) for k in range(300)]
    got = packing.pack_group(pd.DataFrame(rows, columns=["n_tokens", "key", "piece", "source", "cluster"]), 100, 2)
    assert sorted(got["key"]) == list(range(300)) and (got["n_tokens"].diff().dropna() <= 0).all()
    bins = {}
    for r in got.itertuples():
        fits = [b["left"] for b in bins.values() if b["left"] >= r.n_tokens and b["sources"][r.source] < 2 and r.cluster not in b["clusters"]]
        b = bins.setdefault(r.bin, {"left": 100, "sources": Counter(), "clusters": set()})
        assert b["left"] == min(fits, default=100) and b["left"] >= r.n_tokens and r.offset == 100 - b["left"]
        assert b["sources"][r.source] < 2 and r.cluster not in b["clusters"]
        b["left"] -= r.n_tokens
        b["sources"][r.source] += 1
        b["clusters"].add(r.cluster)


@pytest.mark.parametrize("extra", [False, True])
def test_pack_odd(spark, extra):
    got = packing.pack(odd_documents(spark, extra), capacity=50).collect()
    tokens = Counter()
    for r in got:
        tokens[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for r in odd_documents(spark).collect():
        want[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert tokens == +want
    assert packing.pack(no_documents(spark)).count() == 0


def test_pack_groups_follow_pieces(spark):
    """Many pieces of few documents are dealt to many groups."""
    docs = spark.createDataFrame([(k, "w " * 5000, "s") for k in range(4)], "doc_id long, text string, source string")
    got = packing.pack(docs, capacity=50, group_rows=100).collect()
    assert len(got) == 400 and len({r["bin"] >> 32 for r in got}) > 1


def test_pack_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokens, bins = Counter(), defaultdict(list)
    for r in queries.op4_best_fit_packing(spark, SF).collect():
        tokens[r["doc_id"]] += r["n_tokens"]
        bins[r["bin"]].append(r)
    assert tokens == {k: len(d["text"].split()) for k, d in docs.items() if d["text"].split()}
    for rows in bins.values():
        assert sum(r["n_tokens"] for r in rows) <= packing.CAPACITY
        assert max(Counter(r["source"] for r in rows).values()) <= packing.PER_SOURCE
        texts = [docs[r["doc_id"]]["text"].lower() for r in rows]
        assert len(texts) == len(set(texts))


@pytest.mark.parametrize("same_key", [True, False])
def test_equal_rows_take_time_in_proportion(same_key):
    """Each of n pieces of one cluster needs a bin of its own."""
    import time

    def seconds(n):
        pieces = pd.DataFrame({"key": [1] * n if same_key else range(n), "source": ["a"] * n, "cluster": [7] * n, "piece": [0] * n, "n_tokens": [30] * n})
        begun = time.perf_counter()
        assert packing.pack_group(pieces, 2048, 2)["bin"].nunique() == n
        return time.perf_counter() - begun

    assert seconds(40_000) < 12 * max(0.1, seconds(4_000))


def test_equal_rows_are_dealt_to_all_groups(spark):
    from cases import equal_rows

    got = packing.pack(equal_rows(spark, 5000), group_rows=500).select("bin", "source").collect()
    sizes = Counter(r["bin"] >> 32 for r in got)
    assert len(got) == 5002 and len(sizes) == 11 and max(sizes.values()) < 700
    assert max(Counter(r["bin"] for r in got).values()) <= 3
