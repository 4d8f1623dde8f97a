import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import PROSE, equal_rows, no_documents, odd_documents

from lexispark.llm import language_id, quality_model, queries, toxicity

SF = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_quality_query(spark, labels):
    got = queries.op9_quality_model(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    out = [r["predicted"] == labels[r["doc_id"]]["quality"] for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean(out) > 0.95


def test_language_query(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op7_language_id(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(lang)
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]) > 0.97


def test_toxicity_query(spark, labels):
    got = queries.op1_toxicity(spark, SF).collect()
    known = [(r, labels[r["doc_id"]]["toxic"]) for r in got if r["held_out"] and r["doc_id"] in labels]  # never learnt from
    assert all(r["held_out"] == held(r["doc_id"]) for r in got) and sum(y for _, y in known) >= 5
    assert np.mean([r["toxic"] for r, y in known if y == 0]) < 0.02


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r, labels[r["doc_id"]]) for r in queries.op1_toxicity(spark, sf).where("held_out").collect() if r["doc_id"] in labels]
    assert sum(y for _, y in got) > 80 and np.mean([r["toxic"] for r, y in got if not y]) < 0.01
    assert np.mean([r["toxic"] for r, y in got if y]) > 0.75
    assert np.mean([r["expected_severity"] for r, y in got if y]) > 1.5 + np.mean([r["expected_severity"] for r, y in got if not y])


@pytest.mark.parametrize("extra", [False, True])
def test_odd(spark, extra):
    docs = odd_documents(spark, extra)
    stats = quality_model.with_statistics(docs)
    marks = spark.createDataFrame([(0, 1, 1), (0, 0, 0), (4, None, None), (None, 1, 1), (6, 0, 1), (9, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    scores = quality_model.score(stats, quality_model.fit(stats, marks)).collect()
    assert len(scores) == 11 and all(0 <= r["score"] <= 1 for r in scores)
    model = language_id.fit(docs)
    got = language_id.predict(docs, model).collect()
    assert len(got) == 11 and all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3)) for r in got)
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}
    tox = toxicity.score(docs, toxicity.fit(docs, marks)).collect()
    assert len(tox) == 11 and all(0 <= r["toxic_score"] <= 1 for r in tox)


def test_empty(spark):
    docs, marks = no_documents(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    stats = quality_model.with_statistics(docs)
    assert quality_model.score(stats, quality_model.fit(stats, marks)).count() == 0
    assert language_id.fit(docs) is None and language_id.predict(docs, None).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, marks)).count() == 0


def test_statistics_match_slow_ones():
    texts = ["", "Ab ab, AB!! cd.\n$5 cd cd", "été \U0001f600 x", "  \n"]
    got = quality_model.statistics(pa.array(texts, pa.large_string()))
    for t, row in zip(texts, got, strict=True):
        w = t.split()
        n, m = max(1, len(t)), max(1, len(w))
        root = lambda x: np.arcsin(np.sqrt(x))
        want = [np.log1p(len(t)), np.log1p(len(w)), np.log1p(sum(map(len, w)) / m), root(sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t) / n)]
        want += [root(sum(c in "#*$%&|<>{}[]\\^~_=+@/" for c in t) / n), root(t.count("!") / n), root(sum(c in "0123456789" for c in t) / n), root(len(set(w)) / m)]
        want += [root(max(Counter(w).values(), default=0) / m), root(sum(a == b for a, b in zip(w, w[1:], strict=False)) / m), root(sum(len(x) <= 3 for x in w) / m)]
        want += [np.log1p(len(t) / (1 + t.count("\n"))), root((t.count(".") + t.count(",")) / n)]
        assert np.allclose(row, want)


def test_ordinal_gradient():
    """More marking words give a higher expected severity, and the thresholds are in order."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(400):
        n = k % 4
        f = np.unique(np.concatenate([rng.integers(100, 5000, 20), np.arange(n * 3)])).astype(np.int64)
        rows.append((n, f, np.ones(len(f), np.int64)))
    model = toxicity.train(rows)
    assert (np.diff(model.thresholds) > 0).all()
    severity = model.exceed(np.array([model.weights[: 3 * n].sum() for n in range(4)])).sum(axis=1)
    assert (np.diff(severity) > 0).all()


def test_grades():
    labels, hits = np.array([0, 1, 1, 1, 1, 1, 1]), np.array([9.0, 1, 1, 2, 2, 3, 3])
    assert toxicity.grade(labels, hits).tolist() == [0, 1, 1, 2, 2, 3, 3]
    assert toxicity.grade(np.zeros(2), np.zeros(2)).tolist() == [0, 0]


def test_screening_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k % 3 == 0), sorted({int(f) for f in rng.integers(0, 40, 12)} | ({50} if k % 3 == 0 and k % 2 else set()) | ({51} if k % 3 and k % 4 else set()))) for k in range(300)]
    used, marks = toxicity.screened(spark.createDataFrame(rows, "y int, f array<int>"))
    want = {}
    for f in range(60):
        t = np.array([[sum(1 for y, x in rows if y == a and (f in x) == b) for b in (False, True)] for a in (0, 1)], dtype=float)
        if t[:, 1].sum() and t[:, 0].sum():
            expected = np.outer(t.sum(axis=1), t.sum(axis=0)) / t.sum()
            if ((t - expected) ** 2 / expected).sum() >= toxicity.CHI_SQUARE:
                want[f] = bool(t[1, 1] > expected[1, 1])
    assert dict(zip(used.tolist(), marks.tolist(), strict=True)) == want and {50, 51} <= set(want)


def slow_features(text):
    """Counts of a text's words and word beginnings, up to four."""
    found = Counter()
    for w in text.split():
        bare = w.lower().strip(toxicity.EDGES)
        if bare:
            found[toxicity._feature("w", bare)] += 1
        for n in toxicity.STEMS:
            if len(bare) > n:
                found[toxicity._feature("s", bare[:n])] += 1
    return {f: min(n, toxicity.MOST) for f, n in found.items()}


def test_toxicity_prediction_is_the_slow_one(spark):
    texts = ["Ab, abcdef abcdef! abcdefgh", "", None, "one one one one one two", "!!! --"]
    model = toxicity.Model(np.random.default_rng(3).normal(size=toxicity.FEATURES).astype(np.float32), np.array([-1.0, 0.5, 2.0]))
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        total = sum(float(model.weights[f]) * n for f, n in slow_features(t or "").items())
        p = [1 / (1 + np.exp(-(total - c))) for c in model.thresholds]
        edges = [1.0, *p, 0.0]
        assert np.isclose(r["toxic_score"], p[0]) and np.isclose(r["expected_severity"], sum(p)) and r["severity"] == int(np.argmax([a - b for a, b in zip(edges, edges[1:], strict=False)]))


def test_ordinal_step_is_the_gradient():
    """One step of training moves the weights against the numeric gradient of the negative log likelihood."""
    thresholds = np.array([1.0, 2.5, 4.0])

    def loss(w, y, x):
        s = [1.0, *(1 / (1 + np.exp(-(w @ x - thresholds)))), 0.0]
        return -np.log(s[y] - s[y + 1])

    x = np.array([1.0, 3.0])
    for y in range(4):
        w, e = np.zeros(2), 1e-6
        numeric = np.array([(loss(w + e * np.eye(2)[k], y, x) - loss(w - e * np.eye(2)[k], y, x)) / (2 * e) for k in range(2)])
        s = [1.0, *(1 / (1 + np.exp(thresholds))), 0.0]
        assert np.allclose(-(1 - s[y] - s[y + 1]) * x, numeric, atol=1e-5)


def slow_language(text, model):
    """TF-IDF of character n-grams by loops, and the model's probabilities."""
    signs, last = [], False
    for c in text.lower():
        if c.isalpha():
            signs.append(ord(c))
            last = True
        elif last:
            signs.append(32)
            last = False
    counts = Counter()
    for i in range(len(signs)):
        h = 0
        for n in range(1, 4):
            if i + n <= len(signs):
                h = (h * 0x9E3779B97F4A7C15 + signs[i + n - 1] + n) % (1 << 64)
                counts[(h * 0xD6E8FEB86659FD93 % (1 << 64)) >> 50] += 1
    x = {f: (1 + np.log(n)) * model.idf[f] for f, n in counts.items()}
    norm = np.sqrt(sum(v * v for v in x.values()))
    logits = (sum((v / norm) * model.weights[f] for f, v in x.items()) + model.weights[-1]) / model.temperature
    p = np.exp(logits - logits.max())
    return p / p.sum()


def test_language_prediction_is_the_slow_one(spark):
    rng = np.random.default_rng(6)
    model = language_id.Model(["de", "en", "fr"], rng.normal(size=(language_id.FEATURES + 1, 3)).astype(np.float32), rng.uniform(1, 5, language_id.FEATURES), 0.7)
    texts = ["Ein Text, a text; un texte!", "x", "\u00c9t\u00e9 2020 \u6f22\u5b57 \U00010437", "a1b2 -- c"]
    got = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        p = slow_language(t, model)
        assert r["lang_pred"] == model.languages[int(p.argmax())] and np.isclose(r["score"], p.max(), atol=1e-5)


def test_temperature_is_the_best_of_its_grid():
    rng = np.random.default_rng(7)
    rows = []
    for k in range(300):
        y = k % 2 if rng.random() < 0.8 else 1 - k % 2  # noisy, so sure predictions are wrong at times
        at = np.array([10 + k % 2, 20 + int(rng.integers(0, 5))])
        rows.append(("ab"[y], at, np.array([0.8, 0.6])))
    model = language_id.train(rows, np.ones(language_id.FEATURES))

    def loss(t):
        total = 0.0
        for y, at, x in rows[::5]:
            logits = (x @ model.weights[at].astype(float) + model.weights[-1]) / t
            total -= logits["ab".index(y)] - np.log(np.exp(logits).sum())
        return total

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    assert loss(model.temperature) <= min(map(loss, grid)) + 1e-3


def test_posterior_is_the_slow_one():
    """Scores equal the ratio of two Gaussian densities by their textbook formula."""
    rng = np.random.default_rng(8)
    d = 4
    covs = [(lambda a: a @ a.T + np.eye(d))(rng.normal(size=(d, d))) for _ in range(2)]
    means, x = [rng.normal(size=d) for _ in range(2)], rng.normal(size=(20, d))
    factors = [np.linalg.cholesky(c) for c in covs]
    model = quality_model.Model(np.zeros(d), np.ones(d), means, [np.linalg.inv(f) for f in factors], [2 * np.log(np.diag(f)).sum() for f in factors], 0.3)
    density = [np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(c)) for m, c in zip(means, covs, strict=True)]
    assert np.allclose(model.posterior(x), density[1] * np.exp(0.3) / (density[1] * np.exp(0.3) + density[0]))


@pytest.mark.parametrize("key", [None, 7])
def test_equal_rows_and_one_id(spark, key, monkeypatch):
    """The samples are of different texts, and bounded whatever repeats."""
    docs = equal_rows(spark, 5000, key)
    monkeypatch.setattr(language_id, "train", lambda rows, idf, f=language_id.train: (sizes.append(len(rows)), f(rows, idf))[1])
    sizes = []
    model = language_id.fit(docs, per_class=50)
    assert model.languages == ["de", "en"] and sizes[0] < 120
    got = language_id.predict(docs, model).where("doc_id <> 5002").collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)
    marks = spark.createDataFrame([(k, 1 if k < 100 else 0, k % 2) for k in range(5003)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "train", lambda rows, f=toxicity.train: (sizes.append(len(rows)), f(rows))[1])
    scores = toxicity.score(docs, toxicity.fit(docs, marks, per_class=10)).collect()
    assert len(scores) == 5002 and sizes[1] <= 20
    stats = quality_model.with_statistics(docs)
    assert quality_model.score(stats, quality_model.fit(stats, marks)).count() == 5002


def test_one_language_alone(spark):
    docs = equal_rows(spark, 1000).where("lang = 'en' and doc_id < 1000")
    got = language_id.predict(docs, language_id.fit(docs, per_class=3)).collect()
    assert {r["lang_pred"] for r in got} == {"en"}


def test_many_languages_are_learnt_or_an_error(spark):
    docs = spark.createDataFrame([(k, f"{PROSE} {k}", f"l{k:03}") for k in range(300)], "doc_id long, text string, lang string")
    assert len(language_id.fit(docs, sample=300).languages) == 300
    with pytest.raises(ValueError, match="more than 299"):
        language_id.fit(docs, languages=299)
