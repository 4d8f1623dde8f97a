"""The class-based language model against slow counts, slow likelihoods and slow scores."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import PROSE, SCHEMA, no_documents, odd_documents

from lexispark.llm import class_lm as L
from lexispark.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
SF = "/root/testdata/sf0.001"


def slow_tokens(text):
    return [*WORD.findall((text or "").translate(UPPER)), None]


def test_hashes_tell_words_apart():
    texts = ["a b", "b a", "A B", "", " ", "é É ß", "x" * 63, "x" * 64, "x" * 65, "x" * 200 + "y" + "x" * 64, "x" * 64 + "y" + "x" * 200, "a\x00b\x1fc", "tail", "head next", "\t\n mixed\x0b\x0cspace \r "]
    h, offsets = L.hashed_words(pa.array(texts, pa.large_string()))
    names = {}
    for k, t in enumerate(texts):
        got, want = h[offsets[k] : offsets[k + 1]].tolist(), slow_tokens(t)
        assert len(got) == len(want) and got[-1] == int(L.END)
        for x, w in zip(got, want, strict=True):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def test_long_texts_are_cut_between_words(monkeypatch):
    texts = pa.array([PROSE * 50, "w" * 5000, "", "end"], pa.large_string())
    want = L.hashed_words(texts)
    monkeypatch.setattr(L, "CHUNK", 100)
    got = L.hashed_words(texts)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_gains_are_differences_of_the_likelihood():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 30, 3000)
    cls = np.arange(30) % 5
    pairs = lambda c: np.bincount(c[tokens[:-1]] * 6 + c[tokens[1:]], minlength=36).reshape(6, 6).astype(float)
    for word in range(30):
        n = pairs(cls)
        at = tokens == word
        twice = float((at[:-1] & at[1:]).sum())
        after = np.bincount(cls[tokens[1:][at[:-1] & ~at[1:]]], minlength=6).astype(float)
        before = np.bincount(cls[tokens[:-1][at[1:] & ~at[:-1]]], minlength=6).astype(float)
        got = L.gains(n, 5, int(cls[word]), before, after, twice)
        for b in range(5):
            moved = cls.copy()
            moved[word] = b
            assert got[b] == pytest.approx(L.likelihood(pairs(moved)) - L.likelihood(n), abs=1e-6)


def _texts(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("text")


@pytest.fixture(scope="module")
def fitted(spark):
    return L.fit(_texts(spark), classes=8, most=300, rounds=3)


def _slow_classes(texts, words, cls, k):
    """Class of each token of each text, -1 for words that are not frequent."""
    out = []
    for t in texts:
        h, _ = L.hashed_words(pa.array([t or ""], pa.large_string()))
        out.append(cls[words.of(h)])
    return out


@pytest.mark.parametrize("limits", [(1000, 1000), (1, 1)])
def test_neighbours_transitions_and_places(spark, monkeypatch, limits):
    monkeypatch.setattr(L, "MERGED", limits[0])
    monkeypatch.setattr(L, "FAN", limits[1])
    texts = _texts(spark).repartition(5)
    rows = [r["text"] for r in texts.collect()]
    words = L.frequent(L.word_counts(texts), 200)
    k = 6
    cls = np.append(np.arange(200) % k, [k, k + 1])
    want = np.zeros((k + 2, k + 2))
    beside = {}
    for t in rows:
        h, _ = L.hashed_words(pa.array([t or ""], pa.large_string()))
        c = cls[words.of(h)].tolist()
        for i, (a, b) in enumerate(zip([k + 1, *c], c, strict=False)):
            want[a, b] += 1
            if b == k:
                beside.setdefault(int(h.view(np.int64)[i]), Counter())[a, c[i + 1]] += 1
    table = L.neighbours(texts, words, groups=7)
    assert table.count() == 202
    got = L.transitions(table, cls, k + 2)
    assert (got == want).all()
    placed = L.place_others(texts, words, cls, got, k, 5).collect()
    assert {r["h"]: dict(zip(zip(r["left"], r["right"], strict=True), r["times"], strict=True)) for r in placed} == beside
    forward, size = L._log_share(got, 1), np.log(got.sum(axis=1)[:k] + 1)
    for r in placed[:200]:
        fit = [sum(m * (forward[a, b] + forward[b, c]) for (a, c), m in beside[r["h"]].items()) - r["n"] * size[b] for b in range(k)]
        assert r["n"] == sum(beside[r["h"]].values()) and fit[r["cls"]] == pytest.approx(max(fit))


def test_exchange_raises_the_likelihood(spark):
    texts = _texts(spark)
    words = L.frequent(L.word_counts(texts), 300)
    beside = L.neighbours(texts, words)
    values = []
    for rounds in (0, 1, 3):
        cls = L.exchange(beside, words, 8, rounds)
        values.append(L.likelihood(L.transitions(beside, cls, 10)))
        assert cls[:-2].max() < 8 and cls[-2:].tolist() == [8, 9]
    assert values[0] < values[1] < values[2]


def test_probabilities_sum_to_one(fitted):
    rows = fitted.words.collect()
    assert len(rows) == fitted.n_words == len({r["h"] for r in rows})
    cls, n = np.array([r["cls"] for r in rows] + [fitted.k, fitted.k + 1]), np.array([r["n"] for r in rows] + [fitted.ends, 0])
    assert n.sum() == fitted.tokens
    for before in range(fitted.k + 2):
        assert fitted.probability(np.full(len(cls), before), cls, n).sum() == pytest.approx(1)


@pytest.mark.parametrize("sent", [L.SENT, 50, 1])
def test_scores_are_slow_scores(spark, fitted, sent):
    docs = odd_documents(spark, extra=True).unionByName(spark.createDataFrame([(200, PROSE * 20_000, None, None, None), (201, "unseen " * 40, None, None, None)], SCHEMA), allowMissingColumns=True)
    docs = docs.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    table = {r["h"]: (r["cls"], r["n"]) for r in fitted.words.collect()}
    want = []
    for key, text in docs.collect():
        h, _ = L.hashed_words(pa.array([text or ""], pa.large_string()))
        tokens = slow_tokens(text)
        found = [(fitted.k, fitted.ends) if w is None else table.get(x, (fitted.k + 1, 0)) for x, w in zip(h.view(np.int64).tolist(), tokens, strict=True)]
        cls, n = (np.array(x) for x in zip(*found, strict=True))
        p = fitted.probability(np.append(fitted.k, cls[:-1]), cls, n)
        want.append((str(key), len(tokens), int((n > 0).sum()), float(np.log10(fitted.base(n)).sum()), float(np.log10(p).sum())))
    got = [(str(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in L.score(docs, fitted, sent=sent).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9)


def test_query_counts_and_base_are_slow_ones(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in rows}
    c = Counter(w for k, t in rows if not held[k] for w in slow_tokens(t))
    total, types = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.5) / (total + 0.5 * (types + 1))) for w in slow_tokens(t))
    want = {k: (held[k], len(slow_tokens(t)), sum(c[w] > 0 for w in slow_tokens(t)), total, base(t)) for k, t in rows}
    better = Counter()
    for r in queries.op13_class_lm(spark, SF).collect():
        assert tuple(r)[1:5] == want[r["doc_id"]][:4] and r["base_score"] == pytest.approx(want[r["doc_id"]][4])
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]))
        better[r["held_out"]] += r["score"] - r["base_score"]
    assert better[True] > 0 and better[False] > 0


def test_nothing_to_learn_from(spark):
    for docs in (no_documents(spark), spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None)], SCHEMA)):
        model = L.fit(docs)
        rows = L.score(odd_documents(spark), model).collect()
        assert len(rows) == odd_documents(spark).count() and all(r["score"] <= 0 and math.isfinite(r["score"]) for r in rows)
        assert L.score(no_documents(spark), model).count() == 0
