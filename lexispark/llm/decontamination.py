"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

A window of a document has as many words as a benchmark item. Its fingerprint is the SimHash of its shingles (five words),
each counted as often as it occurs. Fingerprints meet those of items of the same size through the blocks of a
multi-index (24 by default), which by the pigeonhole principle finds every pair within a Hamming distance of one less; the exact
weighted Jaccard similarity of the shingles decides. At a similarity of 0.8 distances are about 9.7 with a deviation of 2.9, so hardly
any similar window lies beyond a radius of 23; with 64 blocks of one bit all but opposite fingerprints meet, and none is lost.

A window can only be similar if nearly all of its shingles are the item's, so of any few adjacent shingles of such a window one
is shared. It is therefore enough to look at every ``stride``-th shingle of a document to find all places where similar
windows can lie; only those places are fingerprinted. Everything up to the last aggregate is row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import free_prefix, stored, words

SHINGLE = 5
SIMILARITY = 80  # per cent
BITS, BLOCKS = 64, 24
#: Benchmarks of up to so many shingles are broadcast: 16 bytes for a shingle, its item's size and overhead in the table of shingles, and
#: 8 in its item's, which some 40 bytes a block and item join; larger benchmarks are joined by shuffle.
BROADCAST_SHINGLES = 500_000


def _shingles(w: Column, width: int, step: int = 1) -> Column:
    """Hashes of every ``step``-th run of ``width`` words; empty if there are fewer words."""
    starts = F.sequence(F.lit(0), F.size(w) - width, F.lit(step))
    run = F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))
    return F.when(F.size(w) >= width, run).otherwise(F.array().cast("array<bigint>"))


def sure_run(n: int) -> int:
    """Adjacent shingles of which at least one is shared in any window that is similar to an item of n shingles.

    A similar window has g of 80 to 100 per cent of n shingles and misses at most m of them, which leaves a shared run
    of at least (g - m) / (m + 1).
    """
    least = n
    for g in range(math.ceil(n * SIMILARITY / 100), n + 1):
        shared = math.ceil(SIMILARITY * (g + n) / (100 + SIMILARITY))
        m = g - shared
        if m >= 0:
            least = min(least, math.ceil(shared / (m + 1)))
    return max(1, least)


def simhash(shingles: Column, planes: int) -> Column:
    """The 64-bit SimHash of an array of hashes: bit b is set if more than half of the hashes have it.

    The 64 counts are kept bit-sliced: plane p holds bit p of every count, so one hash is added by ``planes`` additions with carry.
    """

    def add(acc: Column, h: Column) -> Column:
        carry, out = h, []
        for p in range(planes):
            c = acc[f"c{p}"]
            out.append(c.bitwiseXOR(carry).alias(f"c{p}"))
            carry = c.bitwiseAND(carry)
        return F.struct(*out)

    half = F.floor(F.size(shingles) / 2).cast("long")

    def majority(acc: Column) -> Column:
        more, same = F.lit(0).cast("long"), F.lit(-1).cast("long")
        for p in reversed(range(planes)):
            c, t = acc[f"c{p}"], -(F.shiftright(half, p).bitwiseAND(F.lit(1).cast("long")))
            more = more.bitwiseOR(same.bitwiseAND(c).bitwiseAND(F.bitwise_not(t)))
            same = same.bitwiseAND(F.bitwise_not(c.bitwiseXOR(t)))
        return more

    zero = F.struct(*(F.lit(0).cast("long").alias(f"c{p}") for p in range(planes)))
    return F.aggregate(shingles, zero, add, majority)


def _shared(a: Column, b: Column) -> Column:
    """The size of the intersection of two multisets of hashes."""
    times = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    slow = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(slow)


def _blocks(fingerprint: Column, blocks: int) -> list[Column]:
    """A fingerprint in blocks of nearly equal numbers of bits."""
    cuts = [k * BITS // blocks for k in range(blocks + 1)]
    return [F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) for a, b in zip(cuts, cuts[1:], strict=False)]


def _with_words(places: DataFrame, base: DataFrame) -> DataFrame:
    """Places with the words of their documents, of which those of one key and text count once."""
    texts = base.select(F.col("key").alias("b_key"), F.col("digest").alias("b_digest"), "w").dropDuplicates(["b_key", "b_digest"])
    return places.join(texts, F.col("key").eqNullSafe(F.col("b_key")) & (F.col("digest") == F.col("b_digest"))).drop("b_key", "b_digest")


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """One row for each document and item that a window of the document is similar to.

    Returns ``key``, ``item``, digest (xxhash64 of the text, to tell rows without or with the same key apart), similarity of
    the best window, its start (in words from 0), n_words and hamming distance. Words are lower-cased and separated by
    ASCII white space. An item of fewer than five words is one shingle; items without words and null texts match nothing. A
    document shorter than an item is one window. Repeated documents of one key and text give one row; repeated item ids are
    one item each text. Empty tables give an empty result. The radius of the fingerprints is one less than ``blocks`` (1 to 64).
    """
    n = F.size("w")
    wanted = items.select(F.col(item).alias("item"), words(F.lower(F.col(item_text))).alias("w")).where(n > 0).distinct()
    wanted = wanted.select("item", "w", n.alias("n"), F.least(n, F.lit(SHINGLE)).alias("width"))
    sizes = [(r["n"], r["items"]) for r in wanted.groupBy("n").agg(F.count(F.lit(1)).alias("items")).collect()]  # one row for each size
    key_type, item_type = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    out = [F.col("key").alias(key), F.col("item").alias(item), "digest", "similarity", "start", "n_words", "hamming"]
    if not sizes:
        empty = docs.sparkSession.createDataFrame([], f"key {key_type}, item {item_type}, digest long, similarity double, start int, n_words int, hamming int")
        return empty.select(*out)
    small = sum(k * i for k, i in sizes) <= BROADCAST_SHINGLES
    hint = F.broadcast if small else (lambda x: x)
    most = max(k for k, _ in sizes)
    planes = most.bit_length()
    base = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("digest"), words(F.lower(F.col(text))).alias("w"))

    found = None
    for width in sorted({min(k, SHINGLE) for k, _ in sizes}):
        stride = min(sure_run(k - width + 1) for k, _ in sizes if min(k, SHINGLE) == width)
        its = wanted.where(F.col("width") == width).select("item", "n", F.xxhash64("item", "w").alias("i_id"), _shingles(F.col("w"), width).alias("i_shingles"))
        its = its.withColumn("i_print", simhash(F.col("i_shingles"), planes))
        grams = its.select(F.explode("i_shingles").alias("h"), "n").distinct()
        # an item's fingerprint goes by each block; its shingles are sent once
        index = its.select("i_id", F.col("n").alias("i_n"), "i_print", F.posexplode(F.array(*_blocks(F.col("i_print"), blocks))).alias("i_k", "i_block"))

        # outer, as Spark would otherwise filter by the size of the array first, and compute it twice for that
        held = ["w"] if small else []
        places = base.withColumn("hs", _shingles(F.col("w"), width, stride)).select("key", "digest", *held, F.posexplode_outer("hs").alias("nth", "h"))
        places = places.join(hint(grams), "h").select("key", "digest", *held, "n", (F.col("nth") * stride).alias("at"))
        if not small:  # only the places are dealt by shingle; the words come back by document
            places = _with_words(places.distinct(), base)
        # the starts of all windows that hold this shingle, and the words that they span
        first = F.greatest(F.lit(0), F.col("at") - F.col("n") + width)
        last = F.greatest(first, F.least(F.col("at"), F.size("w") - F.col("n")))
        places = places.select("key", "digest", "n", first.alias("first"), last.alias("last"), F.slice("w", first + 1, last - first + F.col("n")).alias("span"))
        places = places.withColumn("hs", _shingles(F.col("span"), width)).withColumn("start", F.explode_outer(F.sequence("first", "last")))
        windows = places.select("key", "digest", "n", "start", F.least(F.col("n"), F.size("span")).alias("n_words"), F.slice("hs", F.col("start") - F.col("first") + 1, F.col("n") - width + 1).alias("shingles"))
        if not small:  # fingerprints are met apart from the shingles, so a window is made once
            windows = stored(windows.dropDuplicates(["key", "digest", "n", "start"]), "windows")
        windows = windows.withColumn("print", simhash(F.col("shingles"), planes))

        held = ["n_words", "shingles"] if small else []
        probes = windows.select("key", "digest", "n", "start", *held, "print", F.posexplode(F.array(*_blocks(F.col("print"), blocks))).alias("k", "block"))
        distance = F.bit_count(F.col("print").bitwiseXOR(F.col("i_print")))
        agree = F.coalesce(*(F.when(x == y, F.lit(k)) for k, (x, y) in enumerate(zip(_blocks(F.col("print"), blocks), _blocks(F.col("i_print"), blocks), strict=True))))
        pairs = probes.join(hint(index), (F.col("n") == F.col("i_n")) & (F.col("k") == F.col("i_k")) & (F.col("block") == F.col("i_block")))
        pairs = pairs.where((distance < blocks) & (agree == F.col("k")))  # a pair is taken up in the first block that agrees
        pairs = pairs.select("key", "digest", "n", "start", *held, "i_id", distance.alias("hamming"))
        if not small:
            same = [F.col(f"p.{c}").eqNullSafe(F.col(f"v.{c}")) for c in ("key", "digest", "n", "start")]
            pairs = pairs.alias("p").join(windows.alias("v"), same[0] & same[1] & same[2] & same[3]).select("p.*", "v.n_words", "v.shingles")
        pairs = pairs.join(hint(its.select(F.col("i_id").alias("of"), "item", "i_shingles")), F.col("i_id") == F.col("of"))
        pairs = pairs.select("key", "digest", "item", "start", "n_words", "hamming", _shared(F.col("shingles"), F.col("i_shingles")).alias("shared"), (F.size("shingles") + F.size("i_shingles")).alias("both"))
        pairs = pairs.where((100 + SIMILARITY) * F.col("shared") >= SIMILARITY * F.col("both"))
        found = pairs if found is None else found.unionByName(pairs)

    best = F.max(F.struct((F.col("shared") / (F.col("both") - F.col("shared"))).alias("similarity"), (-F.col("start")).alias("start"), F.col("n_words").alias("n_words"), (-F.col("hamming")).alias("hamming")))
    found = found.groupBy("key", "digest", "item").agg(best.alias("b"))
    return found.select("key", "digest", "item", "b.similarity", (-F.col("b.start")).alias("start"), "b.n_words", (-F.col("b.hamming")).alias("hamming")).select(*out)


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """The rows of ``docs`` without a leaked item, all columns, whatever their names; repeated and null keys are told apart by their texts.

    Null and empty texts have no item and stay; repeated rows stay or go together; an empty table, or no items, change nothing.
    """
    w = free_prefix(docs)
    bad = leaks(docs, items, key, text, item, item_text, blocks).select(F.col(key).alias(w + "key"), F.col("digest").alias(w + "digest")).distinct()
    return docs.join(bad, F.col(key).eqNullSafe(F.col(w + "key")) & (F.xxhash64(text) == F.col(w + "digest")), "left_anti")
