"""Quality scores by regularised quadratic discriminant analysis of document statistics.

Each class has a Gaussian over transformed statistics of a text. Its covariance is shrunk towards the pooled one and
towards a multiple of the identity. A score is the posterior of label 1, from the difference of the two log densities,
whose Mahalanobis terms use Cholesky factors that are made once. The fit needs counts, sums and sums of products only,
so it covers all labelled rows by one aggregate of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

STATISTICS = ("chars", "words", "word_length", "upper", "symbols", "bangs", "digits", "distinct", "top_word", "again", "short_words", "line_length", "commas_stops")
SHRINK_POOLED, SHRINK_IDENTITY = 0.05, 0.02
FLOOR = 1e-4


def _marks(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars.encode())] = True
    return table


UPPER = _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
SYMBOLS = _marks("#*$%&|<>{}[]\\^~_=+@/")
DIGITS = _marks("0123456789")


def statistics(texts: pa.LargeStringArray) -> np.ndarray:
    """One row of transformed statistics for each text; an empty text's shares are 0."""
    data, offsets = textkit.buffer(texts)
    count = lambda marks: textkit.between(marks, offsets)
    chars = count((data & 0xC0) != 0x80)
    bounds, codes, vocabulary = textkit.word_codes(texts)
    n_words = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), n_words)
    keys, times = np.unique(owner * max(1, len(vocabulary)) + codes, return_counts=True)
    of = keys // max(1, len(vocabulary))
    distinct = np.bincount(of, minlength=len(texts))
    top = np.zeros(len(texts))
    np.maximum.at(top, of, times)
    lengths = np.array([len(w) for w in vocabulary] or [0])[codes] if len(codes) else np.zeros(0, np.int64)
    again = np.zeros(len(codes), dtype=bool)
    again[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    words, one = np.maximum(n_words, 1), np.maximum(chars, 1)
    sums = lambda x: textkit.between(x, bounds)
    root = lambda x: np.arcsin(np.sqrt(np.clip(x, 0, 1)))
    return np.column_stack(
        [
            np.log1p(chars),
            np.log1p(n_words),
            np.log1p(sums(lengths) / words),
            root(count(UPPER[data]) / one),
            root(count(SYMBOLS[data]) / one),
            root(count(data == ord("!")) / one),
            root(count(DIGITS[data]) / one),
            root(distinct / words),
            root(top / words),
            root(sums(again) / words),
            root(sums(lengths <= 3) / words),
            np.log1p(chars / (1 + count(data == ord("\n")))),
            root((count(data == ord(".")) + count(data == ord(","))) / one),
        ]
    )


def with_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``stats`` (array of the transformed statistics) of every row; null texts count as empty.

    Null and repeated keys are rows like any other; other columns are not read, whatever their names. An empty table gives an empty one.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def make(part: pa.RecordBatch, texts: pa.LargeStringArray) -> pa.RecordBatch:
        x = statistics(texts)
        stats = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([part.column("key"), stats], ["key", "stats"])

    return rows.mapInArrow(textkit.per_slice(make), f"key {rows.schema['key'].dataType.simpleString()}, stats array<double>")


@dataclass
class Model:
    """Means, inverted Cholesky factors and log determinants of both classes, after scaling."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    inverses: list[np.ndarray]
    logdets: list[float]
    log_prior: float

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = [-0.5 * (((z - m) @ inv.T) ** 2).sum(axis=1) - 0.5 * ld for m, inv, ld in zip(self.means, self.inverses, self.logdets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_prior, -700, 700)))


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Model:
    """Fits on all rows of ``stats`` whose key is labelled 0 or 1; a key labelled both ways counts as 0.

    Null keys and null labels are left out. Without rows of a class, the class has the pooled moments.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("l_key")).agg(F.min(label).cast("int").alias("y"))
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    f = [F.get("stats", F.lit(i)) for i in range(d)]
    # first sums within the rows of a partition and class, then over all
    moments = stats.join(known, F.col("key") == F.col("l_key")).groupBy("y").agg(F.count(F.lit(1)).alias("n"), *(F.sum(x) for x in f), *(F.sum(f[i] * f[j]) for i, j in pairs)).collect()
    n, sums, squares = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in moments:
        n[r[0]], sums[r[0]] = r[1], r[2 : 2 + d]
        for (i, j), v in zip(pairs, r[2 + d :], strict=True):
            squares[r[0], i, j] = squares[r[0], j, i] = v
    total = max(1.0, n.sum())
    centre = sums.sum(axis=0) / total
    scale = np.sqrt(np.maximum(np.diag(squares.sum(axis=0)) / total - centre**2, FLOOR))
    means, covs = [], []
    for c in (0, 1):
        m = sums[c] / n[c] if n[c] else centre
        s = squares[c] / n[c] - np.outer(m, m) if n[c] else np.diag(scale**2)
        means.append((m - centre) / scale)
        covs.append(s / np.outer(scale, scale))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / total if n.sum() else np.eye(d)
    inverses, logdets = [], []
    for c in covs:
        c = (1 - SHRINK_POOLED) * c + SHRINK_POOLED * pooled
        c = (1 - SHRINK_IDENTITY) * c + (SHRINK_IDENTITY * max(np.trace(c) / d, FLOOR) + FLOOR) * np.eye(d)
        factor = np.linalg.cholesky(c)
        inverses.append(np.linalg.inv(factor))
        logdets.append(2 * float(np.log(np.diag(factor)).sum()))
    return Model(centre, scale, means, inverses, logdets, float(np.log((n[1] + 1) / (n[0] + 1))))


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``key`` and ``score`` (posterior of label 1, 0 to 1) of every row of ``stats``.

    All rows stay, repeated ones and those without a key too; empty texts have statistics and so a score. An empty table gives an empty one.
    """

    def run(batches):
        for b in batches:
            x = b.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) if len(b) else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(model.posterior(x))], ["key", "score"])

    return stats.mapInArrow(run, f"key {stats.schema['key'].dataType.simpleString()}, score double")
