"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties, then calibrated by a temperature. Document
frequencies are counted over all training rows; the weights are fitted on a sample of about ``PER_CLASS`` different training
texts a language (whole texts), and about ``SAMPLE`` in all, which bounds what reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from ._base import free_prefix

FEATURES = 1 << 14
ORDERS = (1, 2, 3)
PER_CLASS, SAMPLE = 500, 20_000
#: Weights are kept for each language, so a label column with more values than this is an error.
LANGUAGES = 1024
EPOCHS, UPDATES = 3, 4000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _counts(texts: pa.LargeStringArray):
    """For each text its n-gram counts over the hashed features, or None if it has no letter.

    Texts are lower-cased, and every run of other signs counts as one space.
    """
    points, offsets = textkit.code_points(pc.utf8_lower(texts))
    alpha = _letters()[points]
    letters = textkit.between(alpha, offsets)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    keep = alpha.copy()
    keep[1:] |= alpha[:-1] & ~alpha[1:] & (owner[1:] == owner[:-1])
    signs = np.where(alpha, points, 32)[keep].astype(np.uint64)
    ends = np.concatenate([[0], np.cumsum(textkit.between(keep, offsets))])
    hashed, h = [], np.zeros(len(signs), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(signs) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + signs[n - 1 :] + np.uint64(n) if len(signs) >= n else np.zeros(0, np.uint64)
        if n in ORDERS:
            hashed.append((n, ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(50)).astype(np.int64)))
    for k in range(len(texts)):
        a, b = ends[k], ends[k + 1]
        yield np.bincount(np.concatenate([x[a : max(a, b - n + 1)] for n, x in hashed]), minlength=FEATURES) if letters[k] else None


def _tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features + 1 (bias) by languages
    idf: np.ndarray
    temperature: float = 1.0

    def probabilities(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        logits = (x @ self.weights[at] + self.weights[-1]) / self.temperature
        p = np.exp(logits - logits.max())
        return p / p.sum()


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """FTRL-proximal over (language, features, values); every fifth row is kept for the temperature, unless a language would have no other."""
    languages = sorted({r[0] for r in rows})
    index = {x: k for k, x in enumerate(languages)}
    k = len(languages)
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    held, used = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    if {r[0] for r in used} != set(languages):
        used = rows  # too few rows to spare any
    order = np.random.default_rng(7)
    for _ in range(max(EPOCHS, min(30, UPDATES // max(1, len(used))))):  # few rows are seen more often
        for i in order.permutation(len(used)):
            language, at, x = used[i]
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            w = weights(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[index[language]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    model = Model(languages, weights(np.arange(FEATURES + 1)), idf)
    if k > 1 and held:
        logits = np.array([x @ model.weights[at] + model.weights[-1] for _, at, x in held])
        y = np.array([index[r[0]] for r in held])

        def loss(t: float) -> float:
            s = logits / t
            top = s.max(axis=1)
            return float((top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

        model.temperature = float(min(np.exp(np.linspace(np.log(0.05), np.log(20), 121)), key=loss))
    model.weights = model.weights.astype(np.float32)
    return model


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", per_class: int = PER_CLASS, sample: int = SAMPLE, languages: int = LANGUAGES) -> Model | None:
    """A model from all rows of ``docs``; None if no row has a language and a letter.

    Null languages and texts without letters are left out. The weights are fitted on a sample of the different texts of each language, one at
    least: about ``per_class``, or less where all would be more than ``sample``. So repeated rows neither crowd the sample nor vanish from
    it. More than ``languages`` languages are an error. Null keys are rows like any other, other columns are not read.
    """
    rows = docs.select(F.col(language).cast("string").alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("at", F.xxhash64("text"))

    def frequencies(batches):
        total, n = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for _, texts in textkit.slices(batch):
                for counts in _counts(texts):
                    if counts is not None:
                        total += counts > 0
                        n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], ["feature", "df"])

    df = {r[0]: r[1] for r in rows.select("text").mapInArrow(frequencies, "feature int, df long").groupBy("feature").agg(F.sum("df")).collect()}
    n = df.pop(-1, 0)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + np.array([df.get(k, 0) for k in range(FEATURES)]))) + 1
    # each language gives the share of its different texts that makes about per_class of them, and the one of the least hash
    there = rows.select("lang", "at").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.pmod("at", F.lit(1 << 30)), "at")).alias("first")).limit(languages + 1).collect()
    if len(there) > languages:
        raise ValueError(f"more than {languages} languages")
    each = min(per_class, max(1, sample // len(there)))
    share = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"]), r["first"]["at"]) for r in there], "s_lang string, share double, first long")
    chosen = rows.join(F.broadcast(share), F.col("lang") == F.col("s_lang")).where((F.pmod("at", F.lit(1 << 30)) < F.col("share") * (1 << 30)) | (F.col("at") == F.col("first")))
    chosen = chosen.select("lang", "text", "at").dropDuplicates(["lang", "at"])

    def features(batches):
        for batch in batches:
            for part, texts in textkit.slices(batch):
                found = [_tf_idf(c, idf) if c is not None else None for c in _counts(texts)]
                ok = [i for i, f in enumerate(found) if f is not None]
                if ok:
                    yield pa.RecordBatch.from_arrays(
                        [part.column("lang").take(ok), part.column("at").take(ok), pa.array([found[i][0].astype(np.int32) for i in ok], pa.list_(pa.int32())), pa.array([found[i][1].astype(np.float32) for i in ok], pa.list_(pa.float32()))],
                        ["lang", "at", "f", "x"],
                    )

    found = chosen.mapInArrow(features, "lang string, at long, f array<int>, x array<float>").toArrow().sort_by([("at", "ascending"), ("lang", "ascending")])
    if not found.num_rows:
        return None
    cut = lambda c: [v.values.to_numpy(zero_copy_only=False) for v in found.column(c).combine_chunks()]
    return train(list(zip(found.column("lang").to_pylist(), cut("f"), [x.astype(float) for x in cut("x")], strict=True)), idf)


def predict(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Append the predicted language and its calibrated probability to every row of ``docs``.

    Null texts and texts without a letter (or a null model) get ``und`` with score 0. All rows stay, repeated ones too; columns with
    the new names, in whatever case, are replaced, all others stay. An empty table gives an empty table.
    """
    kept, text_ = [c for c in docs.columns if c.lower() not in (lang.lower(), score.lower())], free_prefix(docs) + "text"
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text).alias(text_))

    def run(batches):
        for batch in batches:
            for part, texts in textkit.slices(batch, text_):
                found = []
                for counts in _counts(texts):
                    if counts is None or model is None:
                        found.append((UNKNOWN, 0.0))
                    else:
                        p = model.probabilities(*_tf_idf(counts, model.idf))
                        found.append((model.languages[int(p.argmax())], float(p.max())))
                arrays = [part.column(i) for i in range(len(kept))] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, lang, score])

    schema = rows.drop(text_).schema.add(lang, "string").add(score, "double")
    return rows.mapInArrow(run, schema)
