"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are the words of a text and their beginnings of four to seven letters, counted up to four. All thresholds share one weight
vector: P(grade > k) is the logistic of the text's sum of weights minus the k-th threshold. The labels are binary, and no label says
how bad a text is, so severity is no more than an ordinal reading of P(toxic): clean texts have grade 0, and toxic training texts have
grade 1 to 3 by how many of their features mark toxic texts. A longer text can hold more of them. (Grades by their share, which is free
of length, were tried: of 97 held-out toxic texts 62 were caught then, against 80 this way.)
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from ._base import dropped, stored

FEATURES = 1 << 20
GRADES = 4
PER_CLASS = 3000
UPDATES, EPOCHS = 24_000, 30
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.02
STEMS, MOST = (4, 5, 6, 7), 4
#: A feature is used if its chi-square with the label reaches this; with a million features, chance does not.
CHI_SQUARE = 30.0
#: P(grade > 0) from which a text counts as toxic.
TOXIC = 0.35
EDGES = ".,;:!?\"'()[]{}<>|*%&$#"


def _feature(kind: str, word: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}{word}") % FEATURES


def features(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count up to MOST) of the distinct features of each text, in order."""
    bounds, codes, vocabulary = textkit.word_codes(texts)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    pairs, times = np.unique(owner * len(vocabulary) + codes, return_counts=True)
    owner, codes = pairs // len(vocabulary), pairs % len(vocabulary)
    bare = [w.lower().strip(EDGES) for w in vocabulary]
    table = np.array([(_feature("w", w) if w else -1, *(_feature("s", w[:n]) if len(w) > n else -1 for n in STEMS)) for w in bare], dtype=np.int64)
    both = table[codes].ravel()
    pairs = (np.repeat(owner, table.shape[1]) * FEATURES + both)[both >= 0]
    pairs, at = np.unique(pairs, return_inverse=True)
    counts = np.bincount(at, np.repeat(times, table.shape[1])[both >= 0], minlength=len(pairs))
    return pairs // FEATURES, pairs % FEATURES, np.minimum(counts, MOST)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, total: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text (row) and threshold (column)."""
        return 1 / (1 + np.exp(-np.clip(total[:, None] - self.thresholds[None, :], -30, 30)))


def screened(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of the sample (y, f) whose presence goes with the label, sorted, and a mask of those that mark toxic texts.

    Counted by Spark; only features that reach ``CHI_SQUARE`` come to the driver, at most ``FEATURES``.
    """
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    seen = sample.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("has"))
    odd = F.col("toxic") * n0 - (F.col("has") - F.col("toxic")) * n1  # toxic * (n0 - clean) - clean * (n1 - toxic)
    chi = F.lit(float(n0 + n1)) * odd.cast("double") ** 2 / F.greatest(F.lit(1.0), F.lit(float(n0) * n1) * F.col("has") * (F.lit(n0 + n1) - F.col("has")))
    rows = sorted(seen.where(chi >= CHI_SQUARE).select("f", (odd > 0).alias("mark")).collect())
    return np.array([r["f"] for r in rows], dtype=np.int64), np.array([r["mark"] for r in rows], dtype=bool)


def grade(labels: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Grades of the training texts: 0 if clean, else 1 to 3 by terciles of the counts of marking features."""
    toxic = hits[labels > 0]
    cuts = np.quantile(toxic, [1 / 3, 2 / 3]) if len(toxic) else np.zeros(2)
    return np.where(labels > 0, 1 + (hits > cuts[0]).astype(int) + (hits > cuts[1]), 0)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """Follow-the-regularised-leader on the ordinal likelihood of (grade, features, counts); thresholds are kept in order."""
    y = [r[0] for r in rows]
    z, n = np.zeros(FEATURES), np.zeros(FEATURES)
    thresholds = np.array([1.0, 2.5, 4.0])
    seen = np.full(GRADES - 1, 1.0)

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(min(EPOCHS, max(4, UPDATES // max(1, len(rows))))):
        for i in order.permutation(len(rows)):
            _, f, x = rows[i]
            w = weights(f)
            s = 1 / (1 + np.exp(-np.clip(w @ x - thresholds, -30, 30)))  # P(grade > k)
            k = y[i]
            upper, lower = (s[k - 1] if k else 1.0), (s[k] if k < GRADES - 1 else 0.0)
            # d log(upper - lower) / d sum of weights
            g = -(1 - upper - lower) * x
            p = max(upper - lower, 1e-9)
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
            z[f] += g - sigma * w
            n[f] += g * g
            step = np.zeros(GRADES - 1)
            if k:
                step[k - 1] += upper * (1 - upper) / p
            if k < GRADES - 1:
                step[k] -= lower * (1 - lower) / p
            seen += step * step
            thresholds = np.maximum.accumulate(thresholds - 0.1 * step / np.sqrt(seen) + np.array([0, 1e-6, 2e-6]))
    return Model(weights(np.arange(FEATURES)).astype(np.float32), thresholds)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """A model from a sample of at most ``per_class`` labelled texts of each class, chosen by a hash of key and text.

    Equal rows are one, and a key with many texts gives no more of them than fit. A key that has both labels counts as toxic; null keys and
    labels are left out, null and empty texts have no features. Without labelled rows, or with one class alone, no feature is used and
    all texts score alike.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("l_key")).agg(F.max(label).cast("int").alias("y"))
    at = F.pmod(F.xxhash64("l_key", F.lit("toxicity")), F.lit(1 << 30))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, F.lit(min(1.0, per_class / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, per_class / max(1, counts.get(0, 0)))))
    chosen = known.where(at < share * (1 << 30))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("key") == F.col("l_key")).select("key", "text", "y", F.xxhash64("key", "text").alias("row"))
    # the hash of the last row of each class that is taken; hashes only are ranked
    last = rows.select("y", "row").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("y").orderBy("row"))).where(F.col("nth") <= per_class)
    last = {r["y"]: r["row"] for r in last.groupBy("y").agg(F.max("row").alias("row")).collect()}
    rows = rows.where(F.col("row") <= F.when(F.col("y") == 1, F.lit(last.get(1))).otherwise(F.lit(last.get(0)))).dropDuplicates(["y", "row"]).select("key", "text", "y")

    def make(part: pa.RecordBatch, texts: pa.LargeStringArray) -> pa.RecordBatch:
        owner, found, counts = features(texts)
        cuts = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (found, counts.astype(np.int32))]
        return pa.RecordBatch.from_arrays([part.column("key"), part.column("y"), *lists], ["key", "y", "f", "x"])

    kind = rows.schema["key"].dataType.simpleString()
    sample = stored(rows.mapInArrow(textkit.per_slice(make), f"key {kind}, y int, f array<int>, x array<int>"), "sample")
    used, marks = screened(sample)

    def keep(batches):
        for batch in batches:
            lists = batch.column("f")
            owner = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            f, x = lists.flatten().to_numpy(), batch.column("x").flatten().to_numpy()
            at = np.minimum(np.searchsorted(used, f), max(0, len(used) - 1))
            here = used[at] == f if len(used) else np.zeros(len(f), bool)
            marking = here & marks[at] if len(used) else here
            hits = np.bincount(owner[marking], x[marking], minlength=len(batch)).astype(float)
            cuts = pa.array(np.searchsorted(owner[here], np.arange(len(batch) + 1)), pa.int32())
            kept = [pa.ListArray.from_arrays(cuts, pa.array(v[here], pa.int32())) for v in (f, x)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), pa.array(hits), *kept], ["key", "y", "hits", "f", "x"])

    # a text comes to the driver as its used features only
    small = sample.mapInArrow(keep, f"key {kind}, y int, hits double, f array<int>, x array<int>").toArrow().sort_by([("key", "ascending"), ("y", "ascending"), ("hits", "ascending")])
    dropped(sample)
    grades = grade(small.column("y").to_numpy(), small.column("hits").to_numpy())
    cut = lambda c: [v.values.to_numpy(zero_copy_only=False) for v in small.column(c).combine_chunks()]
    return train(list(zip(grades.tolist(), cut("f"), cut("x"), strict=True)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, toxic_score (P(grade > 0)), expected_severity (0 to 3), severity (the likeliest grade), toxic.

    Null and blank texts have no features, and score as texts without any marking feature. Repeated rows and null keys are rows like any
    other; other columns are not read. An empty table gives an empty table.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    at = np.flatnonzero(model.weights)  # only these travel to the executors
    small, thresholds = model.weights[at], model.thresholds

    def run(batches):
        weights = np.zeros(FEATURES, dtype=np.float64)
        weights[at] = small
        local = Model(weights, thresholds)
        for batch in batches:
            for part, texts in textkit.slices(batch):
                owner, found, counts = features(texts)
                exceed = local.exceed(np.bincount(owner, weights[found] * counts, minlength=len(texts)))
                edges = np.column_stack([np.ones(len(texts)), exceed, np.zeros(len(texts))])
                arrays = [part.column("key"), pa.array(exceed[:, 0]), pa.array(exceed.sum(axis=1)), pa.array((edges[:, :-1] - edges[:, 1:]).argmax(axis=1), pa.int32()), pa.array(exceed[:, 0] >= TOXIC)]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "toxic_score", "expected_severity", "severity", "toxic"])

    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, toxic_score double, expected_severity double, severity int, toxic boolean")
    return out.withColumnRenamed("key", key)
