"""Exact n-gram Jaccard self-join with a prefix tree.

1. A document's set is its distinct shingles (hashes of five words). Equal sets are one *class*; only classes are joined.
2. Shingles are dealt by hash range, packed as byte strings, to count in how many classes each occurs. Shingles of one class
   alone cannot be shared and are left out. The others, rarest first, are the class's ordered set. Shingles that a sample shows to
   be in very many classes would make their range larger than a task: they are not counted, but stand last in all ordered sets,
   in an order of their own, and are dealt by classes.
3. Two similar classes share one of the first ``n - ceil(0.8 n) + 1`` shingles of either; classes whose lone shingles fill
   that prefix have no partner. The others meet in the postings of their prefix shingles.
4. In each posting all classes are first compared with the one that has the smallest share of lone shingles, as the source
   of near copies has. Classes that are connected by then need no comparison with each other; all remaining pairs of a posting
   are compared, in blocks where a posting is long. A pair counts at its first common shingle only, so what remains after that
   one in both sets must suffice.
5. A class is compared with all its candidates at once: their ordered sets are walked as paths of a prefix tree, the overlap
   so far is kept for the part shared with the path before, and a path is left when its remaining length cannot reach the
   required overlap.

Hashes have 64 bits in a set's size and digest, and 48 bits beside the hash range in the comparison.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from . import textkit
from ._base import SPACES, dropped, free_prefix, stored

SHINGLE = 5
SIMILARITY = 80  # per cent
#: Shingles that one task counts; it holds some 30 bytes for each and sorts them in PARTS parts.
RANGE_SHINGLES, PARTS = 3_000_000, 8
#: Classes of a shingle from which it is not counted in a range, how often such a one is in the sample at the mean, and the part of that
#: from which one is taken for such. At most HEAVY_SHINGLES of them are broadcast, 8 bytes each; others are counted, in larger ranges.
HEAVY, HEAVY_SAMPLE, HEAVY_SHINGLES = 750_000, 32, 1_000_000
#: What stands for the range and the number of classes of a heavy shingle.
HEAVY_RANGE, HEAVY_COUNT = -1, (1 << 31) - 1
#: Ranges up to which each is given a task of its own.
EVEN_RANGES = 100_000
#: Ranges that a task deals to; more are dealt in two steps, to some hundred of neighbouring ranges first. Shingles that a task packs at once.
FAN, PACKED = 1000, 300_000
#: Classes of one posting that are compared in one block.
BLOCK = 2000
LOW48 = np.uint64((1 << 48) - 1)


def shingle_sets(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash) of each text's distinct shingles, in order; texts of fewer than five words are one shingle."""
    bounds, codes, vocabulary = textkit.word_codes(pc.ascii_lower(texts))
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], dtype=np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.diff(bounds)
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
    owner = np.repeat(np.arange(len(texts)), n)
    with np.errstate(over="ignore"):
        if len(hashes) >= SHINGLE:
            last = len(hashes) - SHINGLE + 1
            h = textkit.mixed(sum((textkit.mixed(hashes[k : k + last]) * odd[k] for k in range(SHINGLE)), np.zeros(last, np.uint64)))
            whole = owner[:last] == owner[SHINGLE - 1 :]
            h, of = h[whole], owner[:last][whole]
        else:
            h, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((n > 0) & (n < SHINGLE))
        few = np.array([int(textkit.mixed(sum((textkit.mixed(hashes[bounds[t] + k : bounds[t] + k + 1]) * odd[k] for k in range(n[t])), np.full(1, n[t], np.uint64)))[0]) for t in short], dtype=np.uint64)
    of, h = np.concatenate([of, short]), np.concatenate([h, few])
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return of[new], h[new]


def digests(of: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit digests of each set; a digest is a sum, so the order of the hashes does not matter."""
    cuts = np.searchsorted(of, np.arange(n + 1))
    out = []
    with np.errstate(over="ignore"):
        for salt in (0x51ED270B0F1A2B3D, 0x2545F4914F6CDD1D):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textkit.mixed(h ^ np.uint64(salt)), dtype=np.uint64)])
            out.append(total[cuts[1:]] - total[cuts[:-1]])
    return np.diff(cuts), out[0].view(np.int64), out[1].view(np.int64)


def _class(d1: np.ndarray, d2: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return textkit.mixed(d1.view(np.uint64) + textkit.mixed(d2.view(np.uint64) + np.uint64(seed + 1))).view(np.int64)


def _sizes(rows: DataFrame, seed: int) -> DataFrame:
    """n, class and digests of each document, after the columns of ``rows`` but the text."""
    kept = [c for c in rows.columns if c != "text"]

    def make(part: pa.RecordBatch, texts: pa.LargeStringArray) -> pa.RecordBatch:
        n, d1, d2 = digests(*shingle_sets(texts), len(texts))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(_class(d1, d2, seed)), pa.array(d1), pa.array(d2)], [*kept, "n", "cls", "d1", "d2"])

    schema = rows.select(*kept).schema
    for c in ("n", "cls", "d1", "d2"):
        schema = schema.add(c, "long")
    return rows.mapInArrow(textkit.per_slice(make), schema)


def _even_keys(spark: SparkSession, n: int) -> np.ndarray:
    """n different numbers that Spark's hash partitioning deals to n different tasks."""
    if n > EVEN_RANGES:
        return np.arange(n, dtype=np.int32)
    rows, span = [], 16
    while len(rows) < n:  # every task is hit by some number among n * ln(n) and more
        span *= 2
        rows = spark.range(n * span).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect()
    return np.array([r["k"] for r in sorted(rows)], dtype=np.int32)


def _heavy(rows: DataFrame, seed: int, classes: int) -> np.ndarray:
    """Hashes of the shingles that a sample of the classes shows to be in more than about ``HEAVY`` of them, sorted."""
    if classes < HEAVY:
        return np.zeros(0, np.uint64)

    def run(batches):
        for batch in batches:
            for _, texts in textkit.slices(batch):
                of, h = shingle_sets(texts)
                _, d1, d2 = digests(of, h, len(texts))
                yield pa.RecordBatch.from_arrays([pa.array(_class(d1, d2, seed)[of]), pa.array(h.view(np.int64))], ["cls", "h"])

    sample = rows.select("text").where(F.pmod(F.xxhash64("text"), F.lit(HEAVY)) < HEAVY_SAMPLE)
    seen = sample.mapInArrow(run, "cls long, h long").distinct().groupBy("h").count().where(F.col("count") >= max(2, HEAVY_SAMPLE // 4))
    found = seen.orderBy(F.desc("count"), "h").limit(HEAVY_SHINGLES).select("h").toPandas()["h"].to_numpy(dtype=np.int64)
    return np.sort(found.view(np.uint64))


def _width(ranges: int) -> int:
    """Neighbouring ranges that are dealt to as one in the first step."""
    return 1 if ranges <= FAN else math.ceil(math.sqrt(ranges))


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a sorted array, and where each begins, with the end."""
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), at[1:] != at[:-1]]))
    return at[first], np.append(first, len(at))


def _pack(at: np.ndarray, cls: np.ndarray, token: np.ndarray, sub: np.ndarray | None = None):
    """(at, who, times, low, high, sub) for each value of ``at``: its classes, how many tokens each has, and the tokens' bytes."""
    order = np.lexsort((cls, at))
    at, cls, token = at[order], cls[order], token[order]
    sub = at[:0] if sub is None else sub[order]
    there, cuts = _runs(at)
    for k, i, j in zip(there.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        who, ends = _runs(cls[i:j])
        t = token[i:j]
        yield k, who.tobytes(), np.diff(ends).astype(np.uint32).tobytes(), (t & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (t >> np.uint64(32)).astype(np.uint16).tobytes(), sub[i:j].astype(np.uint32).tobytes()


DEALT = "range int, salt int, who binary, times binary, low binary, high binary, sub binary"


def _batch(rows: list[tuple], salt: int) -> pa.RecordBatch:
    at, *packed = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([salt] * len(at), pa.int32()), *(pa.array(c, pa.binary()) for c in packed)], ["range", "salt", "who", "times", "low", "high", "sub"])


def deal(batches, seed: int, keys: np.ndarray, heavy: np.ndarray, width: int, salt: int = 0):
    """Shingles of each class by hash range, packed; each class once. Heavy ones, by their place in ``heavy``, are dealt by class, to
    ranges under negative numbers. With many ranges ``range`` is that of the first step, and ``sub`` says which one in it."""
    ranges = len(keys)
    seen: set[int] = set()
    held: list[tuple] = []
    size = 0

    def packed() -> pa.RecordBatch:
        at, cls, token = (np.concatenate(x) for x in zip(*held, strict=True))
        if width == 1:
            return _batch(list(_pack(np.where(at < 0, at, keys[np.maximum(at, 0)]), cls, token)), salt)
        place = np.where(at < 0, -1 - at, at)
        return _batch(list(_pack(np.where(at < 0, -1 - place // width, place // width), cls, token, place % width)), salt)

    for batch in batches:
        for _, texts in textkit.slices(batch):
            of, h = shingle_sets(texts)
            _, d1, d2 = digests(of, h, len(texts))
            cls = _class(d1, d2, seed)
            fresh = np.zeros(len(texts), dtype=bool)
            for i in np.unique(of).tolist():
                if int(cls[i]) not in seen:
                    seen.add(int(cls[i]))
                    fresh[i] = True
            keep = fresh[of]
            of, h = of[keep], h[keep]
            at, token = ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64), h & LOW48
            if len(heavy):
                place = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
                here = heavy[place] == h
                at = np.where(here, -1 - (cls.view(np.uint64) % np.uint64(ranges)).astype(np.int64)[of], at)
                token = np.where(here, place.astype(np.uint64), token)
            held.append((at, cls[of], token))
            size += len(at)
            if size >= PACKED:
                yield packed()
                held, size = [], 0
    if size:
        yield packed()


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class, low and high part of the token, and place within the first step's range of each shingle."""
    joined = lambda c, t: np.frombuffer(b"".join(x.as_buffer() for x in table.column(c)), dtype=t)
    return np.repeat(joined("who", np.int64), joined("times", np.uint32)), joined("low", np.uint32), joined("high", np.uint16), joined("sub", np.uint32)


def _token(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    token = high.astype(np.uint64)
    token <<= np.uint64(32)
    token |= low
    return token


def _dealt(rows: DataFrame, seed: int, keys: np.ndarray, heavy: np.ndarray) -> DataFrame:
    """The packed shingles of all ranges, ``range`` being the range's key."""
    width = _width(len(keys))

    def run(batches):
        from pyspark import TaskContext

        yield from deal(batches, seed, keys, heavy, width, TaskContext.get().partitionId())

    def again(key: tuple, table: pa.Table) -> pa.Table:
        coarse, (cls, low, high, sub) = key[0].as_py(), _unpacked(table)
        sub = sub.astype(np.int64)
        at = -1 - ((-1 - coarse) * width + sub) if coarse < 0 else keys[coarse * width + sub]
        return pa.Table.from_batches([_batch(list(_pack(at, cls, _token(low, high))), 0)])

    out = rows.select("text").mapInArrow(run, DEALT)
    return out if width == 1 else out.groupBy("range", F.pmod("salt", F.lit(width)).alias("part")).applyInArrow(again, DEALT)


def _common(dealt: DataFrame, keys: np.ndarray) -> DataFrame:
    """For each class the shingles that other classes have too, as (number of classes, range, token), in that order.

    What a range finds is packed by buckets of classes, in two steps where there are many, so neither step makes a row for each class and
    range, nor for each bucket and range.
    """
    ranges = len(keys)
    width = _width(ranges)
    found_in = "bucket int, salt int, place binary, cls binary, tokens binary, df binary"

    def rows(bucket: np.ndarray, place: np.ndarray, cls: np.ndarray, token: np.ndarray, df: np.ndarray, salt: int) -> pa.Table:
        order = np.argsort(bucket, kind="stable")
        there, cuts = _runs(bucket[order])
        cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
        columns = [cut(x[order].astype(t)) for x, t in ((place, np.int32), (cls, np.int64), (token, np.int64), (df, np.int32))]
        return pa.Table.from_arrays([pa.array(there, pa.int32()), pa.array(np.full(len(there), salt), pa.int32()), *columns], ["bucket", "salt", "place", "cls", "tokens", "df"])

    def read(table: pa.Table) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(x.as_buffer() for x in table.column(c)), dtype=t) for c, t in (("place", np.int32), ("cls", np.int64), ("tokens", np.int64), ("df", np.int32))]

    def bucket_of(cls: np.ndarray) -> np.ndarray:
        return (cls.view(np.uint64) % np.uint64(ranges)).astype(np.int64)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        at = key[0].as_py()
        whole, low, high, _ = _unpacked(table)
        found = []
        for part in range(PARTS):  # sorted in parts, as sorting takes several times the memory of the input
            here = low % PARTS == part
            cls, token = whole[here], _token(low[here], high[here]).view(np.int64)
            order = np.lexsort((cls, token))
            cls, token = cls[order], token[order]
            new = np.ones(len(token), dtype=bool)
            new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
            cls, token = cls[new], token[new]
            _, cuts = _runs(token)
            df = np.full(len(token), HEAVY_COUNT) if at < 0 else np.repeat(np.diff(cuts), np.diff(cuts))
            shared = df >= 2
            found.append((cls[shared], token[shared], df[shared]))
        cls, token, df = (np.concatenate(x) for x in zip(*found, strict=True))
        bucket = bucket_of(cls)
        return rows(keys[bucket] if width == 1 else bucket // width, np.full(len(cls), max(at, HEAVY_RANGE)), cls, token, df, at)

    def again(key: tuple, table: pa.Table) -> pa.Table:
        place, cls, token, df = read(table)
        return rows(keys[bucket_of(cls)], place, cls, token, df, 0)

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        place, cls, token, df = read(table)
        order = np.lexsort((token, place, df, cls))
        who, cuts = _runs(cls[order])
        parts = pa.StructArray.from_arrays([pa.array(df[order]), pa.array(place[order]), pa.array(token[order])], ["df", "range", "token"])
        return pa.Table.from_arrays([pa.array(who), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), parts)], ["cls", "ordered"])

    even = lambda df, c: (df.repartition(ranges, c) if ranges <= EVEN_RANGES else df).groupBy(c)
    packed = even(dealt, "range").applyInArrow(count, found_in)
    if width > 1:
        packed = packed.groupBy("bucket", F.pmod("salt", F.lit(width)).alias("part")).applyInArrow(again, found_in)
    return even(packed, "bucket").applyInArrow(gather, "cls long, ordered array<struct<df:int,range:int,token:bigint>>")


def required(a: Column, b: Column) -> Column:
    """Whether an overlap of ``o`` suffices is 180 * o >= 80 * (a + b); this is the right side."""
    return SIMILARITY * (a + b)


def walk(probe: np.ndarray, paths: list[np.ndarray], need: list[int]) -> list[int]:
    """The overlap of ``probe`` (sorted) with each path, or -1 where it cannot reach ``need``.

    Paths come in lexicographic order, as in a walk of their prefix tree; counts up to the branching point are kept.
    """
    out = []
    counts = np.zeros(1, dtype=np.int64)  # overlap by depth on the current path
    last = np.zeros(0, dtype=np.int64)
    for path, least in zip(paths, need, strict=True):
        n = min(len(last), len(path), len(counts) - 1)
        differ = np.flatnonzero(last[:n] != path[:n])
        depth = int(differ[0]) if len(differ) else n
        counts = counts[: depth + 1]
        while depth < len(path) and counts[-1] + len(path) - depth >= least:
            part = path[depth : depth + 64]
            at = np.searchsorted(probe, part)
            hit = probe[np.minimum(at, len(probe) - 1)] == part if len(probe) else np.zeros(len(part), bool)
            counts = np.concatenate([counts, counts[-1] + np.cumsum(hit)])
            depth += len(part)
        last = path
        out.append(int(counts[-1]) if depth == len(path) and counts[-1] >= least else -1)
    return out


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("a_n"), F.col("tokens").alias("a_tokens"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("b_n"), F.col("tokens").alias("b_tokens"))

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)
            need = -(-SIMILARITY * (batch.column("a_n").to_numpy() + batch.column("b_n").to_numpy()) // (100 + SIMILARITY))
            list_a, list_b = batch.column("a_tokens"), batch.column("b_tokens")
            path = lambda i: list_b[i].values.to_numpy(zero_copy_only=False)
            ok = np.zeros(len(a), dtype=bool)
            for probe in np.unique(a):
                rows = sorted(np.flatnonzero(a == probe).tolist(), key=lambda i: path(i).astype(">i8").tobytes())
                ok[rows] = np.array(walk(np.sort(list_a[rows[0]].values.to_numpy(zero_copy_only=False)), [path(i) for i in rows], [int(need[i]) for i in rows])) >= 0
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "a_n", "b_n", "a_tokens", "b_tokens").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(cls, root): the smallest class that each linked class is connected with.

    Each round takes the smallest root among a class and its neighbours and then the root of that root, until nothing
    changes; roots are written to the shared folder after each round.
    """
    edges = stored(links.union(links.select("b", "a")).distinct(), "edges")
    step = stored(edges.groupBy(F.col("a").alias("cls")).agg(F.least(F.col("cls"), F.min("b")).alias("root")), "roots")
    while True:
        roots = step.select("cls", "root")
        near = edges.join(roots, edges["b"] == roots["cls"]).groupBy("a").agg(F.min("root").alias("near"))
        least = roots.join(near, roots["cls"] == near["a"]).select("cls", F.col("root").alias("old"), F.least("root", "near").alias("r"))
        jump = roots.select(F.col("cls").alias("j_cls"), F.col("root").alias("j_root"))
        after = stored(least.join(jump, least["r"] == jump["j_cls"], "left").select("cls", "old", F.least("r", "j_root").alias("root")), "roots")
        dropped(step)
        step = after
        if not step.where(F.col("old") != F.col("root")).limit(1).count():
            dropped(edges)
            return step.select("cls", "root")


def _candidates(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """All pairs of a posting that are not connected by ``roots`` and whose lengths allow a link."""
    known = postings.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = known.groupBy("range", "token").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") != F.col("high"))
    known = known.join(mixed.select("range", "token", "size"), ["range", "token"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    known = known.withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    known = known.select("range", "token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "n", "left", "root")
    x, y = known.alias("x"), known.alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("range", "token", "i", "j")]
    fits = (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root")) & ((F.col("x.i") == F.col("x.j")) | (F.col("x.block") != F.col("y.block")))
    fits &= (100 + SIMILARITY) * F.least("x.left", "y.left") >= required(F.col("x.n"), F.col("y.n"))
    return x.join(y, on[0] & on[1] & on[2] & on[3] & fits).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()


def _linked(rows: DataFrame, every_link: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The sizes of all rows (key, text, and columns that are carried along), the classes, their links, and the roots of linked classes.

    With ``every_link`` all candidate pairs are compared; else those that are connected already are not, as components need no more.
    """
    seed = 0
    while True:  # a class is a 64-bit number; should two sets have the same one, all are numbered anew
        sizes = stored(_sizes(rows, seed), "sizes")
        classes = sizes.where(F.col("n") > 0).groupBy("cls").agg(F.max("n").alias("n"), F.min("key").alias("first"), F.min("d1").alias("l1"), F.max("d1").alias("h1"), F.min("d2").alias("l2"), F.max("d2").alias("h2"))
        classes = stored(classes, "classes")
        if not classes.where((F.col("l1") != F.col("h1")) | (F.col("l2") != F.col("h2"))).limit(1).count():
            break
        dropped(sizes, classes)
        seed += 1
    classes = classes.select("cls", "n", "first")
    total, count = classes.agg(F.sum("n"), F.count(F.lit(1))).first()
    keys = _even_keys(rows.sparkSession, max(1, math.ceil((total or 0) / RANGE_SHINGLES)))
    common = _common(_dealt(rows, seed, keys, _heavy(rows, seed, count)), keys)

    # the ordered set: rarest first; what is missing from n are lone shingles, which come before all others
    m = F.size("ordered").cast("long")
    prefix = F.col("n") - F.ceil(F.col("n") * SIMILARITY / 100) + 1
    sets = common.join(classes.select("cls", "n"), "cls").select("cls", "n", m.alias("m"), (prefix - (F.col("n") - m)).cast("int").alias("reach"), "ordered")
    written = sets = stored(sets.where(F.col("reach") > 0), "sets")
    # left: shingles of the set from this one on, the most that can be shared if this one is the first shared
    postings = sets.select("cls", "n", "m", F.posexplode_outer(F.slice("ordered", F.lit(1), F.col("reach"))).alias("nth", "t"))
    postings = postings.select("cls", "n", (F.col("m") - F.col("nth")).alias("left"), ((F.col("n") - F.col("m")) / F.col("n")).alias("lone"), "t.range", "t.token")
    sets = sets.select("cls", "n", F.transform("ordered", lambda x: F.xxhash64(x["df"], x["range"], x["token"])).alias("tokens"))

    if every_link:
        none = classes.select("cls", F.col("cls").alias("root")).limit(0)
        links = stored(_verified(_candidates(postings, none), sets), "links")
        dropped(written)
        return sizes, classes, links, components(links)
    hubs = postings.groupBy("range", "token").agg(F.min(F.struct("lone", "cls", "n", "left")).alias("hub"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1).select("range", "token", "hub")
    fits = (100 + SIMILARITY) * F.least("left", "hub.left") >= required(F.col("n"), F.col("hub.n"))
    star = postings.join(hubs, ["range", "token"]).where((F.col("cls") != F.col("hub.cls")) & fits).select(F.col("hub.cls").alias("a"), F.col("cls").alias("b")).distinct()
    links = stored(_verified(star, sets), "links")
    roots = components(links)
    more = stored(_verified(_candidates(postings, roots), sets), "links")
    dropped(written)
    if more.limit(1).count():
        links = links.union(more)
        roots = components(links)
    return sizes, classes, links, roots


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", count_links: bool = False) -> DataFrame:
    """One row per document: ``key``, n_shingles and component_id (the smallest key connected by links).

    With ``count_links`` there is also n_links, the number of different sets that the document's set is linked with directly; all
    candidate pairs are compared for that. Documents without words have no shingles and no links; they, like those alone, are their own component. Rows with
    equal sets are always connected. Null keys count as no key: their component has the smallest other key, or null. Other columns are not
    read, whatever their names. An empty table gives an empty table.
    """
    sizes, classes, links, roots = _linked(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), count_links)
    rooted = classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = rooted.join(least, "root").select(F.col("cls").alias("c"), "component_id")
    if count_links:
        degree = links.select(F.col("a").alias("of")).union(links.select("b")).groupBy("of").agg(F.count(F.lit(1)).alias("n_links"))
        found = found.join(degree, F.col("c") == F.col("of"), "left").drop("of")
    found = stored(found, "components")
    out = sizes.join(found, (F.col("cls") == F.col("c")) & (F.col("n") > 0), "left")
    more = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"), *more)


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` per component, whole: the one with the smallest key, then the smallest digest of the row; null keys come last.

    A component is known by its root class, so rows that share a key stay apart unless they are linked. Rows without words
    are their own component and all stay. A row is known by two 64-bit digests of all its columns; equal rows count as one.
    """
    w = free_prefix(docs)
    r1_, r2_, k1_, k2_ = (w + n for n in ("r1", "r2", "k1", "k2"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    # nulls do not change a hash, so their places are hashed too; nested columns, maps among them, are hashed as JSON
    flat = [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else c for c, f in zip(own, docs.schema, strict=True)]
    content = [*flat, *(c.isNull() for c in own)]
    marks = [F.xxhash64(*content).alias(r1_), F.xxhash64(F.lit(1), *content).alias(r2_)]
    marked = docs.select("*", *marks)
    rows = marked.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(r1_).alias("r1"), F.col(r2_).alias("r2"))
    sizes, _, _, roots = _linked(rows)
    sizes = sizes.where(F.col("n") > 0)
    # by class before by root, so that a large group is never dealt as rows
    least = sizes.groupBy("cls").agg(F.min(F.struct(F.col("key").isNull(), "key", "r1", "r2")).alias("row"))
    least = least.join(roots, "cls", "left").groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("row").alias("row"))
    least = least.select(F.col("row.r1").alias(k1_), F.col("row.r2").alias(k2_))
    blank = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES)) == ""
    worded = docs.where(~blank).select("*", *marks)
    if sizes.groupBy("r1", "r2").count().where("count > 1").limit(1).count():
        worded = worded.dropDuplicates([r1_, r2_])
    worded = worded.join(least, (F.col(r1_) == F.col(k1_)) & (F.col(r2_) == F.col(k2_)), "left_semi")
    return worded.select(*own).union(docs.where(blank))
