"""Hard negatives by exact search of k-means inverted lists.

Each list keeps its centroid and its radius, the largest distance of a row from the centroid. For an anchor a and a list (c, r) the
Cauchy-Schwarz inequality bounds all scores in the list: a.c - |a| r <= score <= a.c + |a| r. Lists are visited by falling upper bound,
those outside a window are skipped, and an anchor is done when the next bound is strictly below its kth score. The answer is exact,
whatever the lists; better lists only spare work.

Anchors are worked on in blocks of about ``BLOCK``. A block and what it wants to visit are sent to all tasks, which scan the lists where they lie;
no vector is shuffled after the lists are written. Some lists are visited in each round, more of them from round to round.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._base import stored

#: Rows that the centroids are fitted on, at most; all rows are listed.
SAMPLE, LISTS, LLOYD = 20_000, 1024, 8
BLOCK = 6_000
#: Lists that an anchor visits in the first round, and how many times more in each round after.
FIRST, GROWTH = 8, 8
#: Anchors and rows of one matrix product.
STEP_ANCHORS, STEP_ROWS = 1024, 4096
NEVER = np.int64(1) << 62


def _exact(norm: float):
    """The type in which inner products of vectors with this largest squared norm are exact."""
    if norm >= 2.0**62:
        raise ValueError("scores do not fit in 64 bits")
    return np.float32 if norm < 2.0**24 else np.float64 if norm < 2.0**53 else np.int64


def quantised(rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(uid, key, label, q, norm): integer vectors floor(scale * x) as bytes of 32-bit numbers, and their squared norms.

    Rows with a null key, label or vector, or with a null or non-finite component, take no part. Shorter vectors count as having zeros at
    their end. Components beyond 32 bits are an error. Other columns are not read.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    dim = max(1, rows.agg(F.max(F.size(vector))).first()[0] or 0)

    def make(batches):
        for batch in batches:
            lists = batch.column("v")
            n, flat = lists.value_lengths().to_numpy(), lists.flatten()
            x = np.floor(scale * flat.to_numpy(zero_copy_only=False).astype(np.float64))
            owner = np.repeat(np.arange(len(batch)), n)
            bad = ~np.isfinite(x)
            ok = np.bincount(owner, bad, minlength=len(batch)) == 0
            q = np.zeros((len(batch), dim))
            q[owner, np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)] = np.where(bad, 0, x)
            q = q[ok]
            if len(q) and np.abs(q).max() >= 2**31:
                raise ValueError("a component does not fit in 32 bits")
            raw = q.astype("<i4").tobytes()
            data = pa.array([raw[i : i + 4 * dim] for i in range(0, len(raw), 4 * dim)], pa.binary())
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("uid").filter(keep), batch.column("key").filter(keep), batch.column("label").filter(keep), data, pa.array((q * q).sum(axis=1))], ["uid", "key", "label", "q", "norm"])

    given = rows.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return given.mapInArrow(make, "uid long, key long, label long, q binary, norm double")


def _matrix(column, dtype) -> np.ndarray:
    """Stored vectors as rows."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = b"".join(values.to_pylist())
    return np.frombuffer(raw, dtype="<i4").reshape(len(values), -1).astype(dtype) if len(values) else np.zeros((0, 1), dtype)


def centroids(points: np.ndarray, lists: int) -> np.ndarray:
    """Lloyd's iterations from distinct points."""
    points = np.unique(points, axis=0)
    c = points[np.sort(np.random.default_rng(7).choice(len(points), min(lists, len(points)), replace=False))]
    for _ in range(LLOYD):
        near = nearest(points, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, points)
        c = sums[n > 0] / n[n > 0, None]
    return c


def nearest(points: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(points[i : i + STEP_ROWS] @ c.T - half, axis=1) for i in range(0, len(points), STEP_ROWS)] or [np.zeros(0, np.int64)])


@dataclass
class Index:
    rows: DataFrame  # list, uid, key, label, q, norm; sorted by list
    centroids: np.ndarray
    radii: np.ndarray
    norm: float  # the largest squared norm


def index(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> Index:
    """Inverted lists of all rows of ``quantised``; by default about the square root of the number of rows, ``LISTS`` at most."""
    vectors = stored(vectors, "vectors")
    n, norm = vectors.agg(F.count(F.lit(1)), F.max("norm")).first()
    lists = lists or max(1, min(LISTS, round(math.sqrt(n))))
    at = F.xxhash64("uid", F.lit("sample"))
    some = vectors.where(F.pmod(at, F.lit(1 << 30)) < min(1.0, 2 * sample / max(1, n)) * (1 << 30)).orderBy(at).limit(sample).select("q").toArrow().column("q")
    c = centroids(_matrix(some, np.float64), lists) if len(some) else np.zeros((1, 1))

    def assign(batches):
        for batch in batches:
            q = _matrix(batch.column("q"), np.float64)
            near = nearest(q, c) if len(q) else np.zeros(0, np.int64)
            far = np.sqrt(((q - c[near]) ** 2).sum(axis=1)) if len(q) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(far), *batch.columns], ["list", "far", *batch.schema.names])

    listed = vectors.mapInArrow(assign, "list int, far double, uid long, key long, label long, q binary, norm double")
    # ranges of (list, uid), so a list of any size is dealt evenly, and a scan of some lists reads their files only
    listed = stored(listed.repartitionByRange("list", "uid").sortWithinPartitions("list", "uid"), "lists")
    radii = np.full(len(c), -1.0)  # no rows: no score
    for r in listed.groupBy("list").agg(F.max("far").alias("far")).collect():
        radii[r["list"]] = r["far"]
    return Index(listed, c, radii, norm or 0.0)


@dataclass
class _Block:
    """Anchors of a block with their windows; ``least`` is what a score must reach by now."""

    uid: np.ndarray
    key: np.ndarray
    label: np.ndarray
    q: np.ndarray
    low: np.ndarray  # anchors by windows
    high: np.ndarray
    least: np.ndarray
    same: bool
    k: int


def best(owner: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each owner: higher scores first, ties by smaller key."""
    order = np.lexsort((key, -score, owner))
    o = owner[order]
    first = np.searchsorted(o, o)
    return order[np.arange(len(o)) - first < k]


def _scan(lists: DataFrame, sent, wanted, dtype) -> DataFrame:
    """The best of what each task finds: (a, w, score, key)."""

    def run(batches):
        block, visits = sent.value, wanted.value
        n, windows = block.low.shape
        least = np.maximum(block.least, block.low).astype(dtype)
        high, q = block.high.astype(dtype), block.q.astype(dtype)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # anchor * windows + window, score, key

        def add(held, found):
            owner, score, key = (np.concatenate(x) for x in zip(held, found, strict=True))
            keep = best(owner, score, key, block.k)
            return owner[keep], score[keep], key[keep]

        for batch in batches:
            of, uid, key, label = (batch.column(c).to_numpy() for c in ("list", "uid", "key", "label"))
            rows = _matrix(batch.column("q"), dtype)
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for i0, i1 in zip(cuts[:-1], cuts[1:], strict=True):
                who = np.flatnonzero(visits[:, of[i0]]) if i1 > i0 else []
                for j in range(0, len(who), STEP_ANCHORS):
                    a = who[j : j + STEP_ANCHORS]
                    for i in range(i0, i1, STEP_ROWS):
                        here = slice(i, min(i1, i + STEP_ROWS))
                        s = q[a] @ rows[here].T
                        fits = (block.label[a][:, None] == label[here][None, :]) == block.same
                        if block.same:
                            fits &= block.uid[a][:, None] != uid[here][None, :]
                        for w in range(windows):
                            x, y = np.nonzero(fits & (s >= least[a, w][:, None]) & (s <= high[a, w][:, None]))
                            if len(x):
                                held = add(held, (a[x] * windows + w, s[x, y].astype(np.int64), key[here][y]))
            # what is found here already bars the rest of this task's rows
            full = np.flatnonzero(np.bincount(held[0], minlength=n * windows) == block.k)
            last = np.searchsorted(held[0], full, side="right") - 1
            least.ravel()[full] = np.maximum(least.ravel()[full], held[1][last].astype(dtype))
        yield pa.RecordBatch.from_arrays([pa.array(held[0] // max(1, windows), pa.int64()), pa.array(held[0] % max(1, windows), pa.int32()), pa.array(held[1]), pa.array(held[2])], ["a", "w", "score", "key"])

    return lists.mapInArrow(run, "a long, w int, score long, key long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy("a", "w").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)


def search(lists: Index, block: _Block) -> DataFrame:
    """The k best rows of each anchor and window: (a, w, score, key, rank), exact."""
    spark = lists.rows.sparkSession
    dtype = _exact(lists.norm)
    c, q = lists.centroids, block.q.astype(np.float64)
    middle, reach = q @ c.T, np.sqrt((q * q).sum(axis=1))[:, None] * np.maximum(lists.radii, 0)[None, :]
    slack = 1e-6 + 1e-9 * (np.abs(middle) + reach)
    upper, lower = middle + reach + slack, middle - reach - slack
    upper[:, lists.radii < 0] = -np.inf
    order = np.argsort(-upper, axis=1, kind="stable")
    visited = np.zeros(upper.shape, dtype=bool)
    n, windows = block.low.shape
    take, parts = FIRST, []
    while True:
        wanted = np.zeros(upper.shape, dtype=bool)
        for w in range(windows):  # a bound strictly below the kth score ends an anchor's visits
            wanted |= (upper >= np.maximum(block.least, block.low)[:, w, None]) & (lower <= block.high[:, w, None])
        wanted &= ~visited & (upper > -np.inf)
        sorted_ = np.take_along_axis(wanted, order, axis=1)
        np.put_along_axis(wanted, order, sorted_ & (np.cumsum(sorted_, axis=1) <= take), axis=1)
        if not wanted.any():
            break
        visited |= wanted
        some = np.flatnonzero(wanted.any(axis=0))
        rows = lists.rows if len(some) == len(lists.radii) else lists.rows.where(F.col("list").isin(some.tolist()))
        sent, visits = spark.sparkContext.broadcast(block), spark.sparkContext.broadcast(wanted)
        parts.append(stored(_ranked(_scan(rows, sent, visits, dtype), block.k).drop("rank"), "found"))
        known = parts[0]
        for p in parts[1:]:
            known = known.union(p)
        for r in _ranked(known, block.k).where(F.col("rank") == block.k).select("a", "w", "score").toArrow().to_pylist():
            block.least[r["a"], r["w"]] = max(block.least[r["a"], r["w"]], r["score"])
        sent.unpersist()
        visits.unpersist()
        take *= GROWTH
    if not parts:
        return spark.createDataFrame([], "a long, w int, score long, key long, rank int")
    known = parts[0]
    for p in parts[1:]:
        known = known.union(p)
    return _ranked(known, block.k)


def mine(lists: Index, anchors: Column, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100), block: int = BLOCK) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the listed rows that meet ``anchors`` (a condition on key and label). An anchor's positives are its best other rows of its
    label; a positive's negatives are the best rows of other labels with low * positive_score <= negative_score <= positive_score, so a
    positive of a negative score has none. Higher scores come first, ties by smaller key. All are returned where there are fewer.
    Repeated rows are rows like any other, and only the anchor's own row is not its positive. An empty table gives an empty table.
    """
    spark = lists.rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    chosen = lists.rows.where(anchors).select("uid", "key", "label", "q")
    blocks = math.ceil(chosen.count() / block)
    if not blocks:
        return spark.createDataFrame([], schema)
    chosen = stored(chosen.withColumn("block", F.pmod(F.xxhash64("uid", F.lit("block")), F.lit(blocks))).repartitionByRange("block"), "anchors")
    out = []
    for b in range(blocks):
        part = chosen.where(F.col("block") == b).toArrow().sort_by("uid")
        n = part.num_rows
        if not n:
            continue
        uid, key, label = (part.column(c).to_numpy() for c in ("uid", "key", "label"))
        every = np.full((n, 1), -NEVER)
        near = search(lists, _Block(uid, key, label, _matrix(part.column("q"), np.int64), every, -every, every.copy(), True, positives)).toArrow()
        a, rank, score, found = (near.column(c).to_numpy() for c in ("a", "rank", "score", "key"))
        # windows of one positive each; an anchor with fewer has empty ones
        bottom, top = np.full((n, positives), NEVER), np.full((n, positives), -NEVER)
        top[a, rank - 1] = score
        bottom[a, rank - 1] = -(-low[0] * score // low[1])
        bottom, top = np.where(bottom <= top, bottom, NEVER), np.where(bottom <= top, top, -NEVER)
        # one search for all windows of the block
        hard = search(lists, _Block(uid, key, label, _matrix(part.column("q"), np.int64), bottom, top, np.full((n, positives), -NEVER), False, negatives))
        pairs = pa.table({"p_a": a, "p_w": (rank - 1).astype(np.int32), "anchor_id": key[a], "positive_id": found, "positive_score": score})
        given = F.broadcast(spark.createDataFrame(pairs))  # some 30,000 rows at most
        rows = hard.join(given, (F.col("a") == F.col("p_a")) & (F.col("w") == F.col("p_w")))
        out.append(stored(rows.select("anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    union = out[0]
    for x in out[1:]:
        union = union.union(x)
    return union
