"""Sharding by vector bin packing of bytes, tokens and rows.

Documents of one group (equal texts by default) go to one shard. Groups are packed as *atoms*: a group that is large
against a shard is an atom of its own (in pieces, if it has more bytes than a whole shard), all others fall by hash
into a fixed number of atoms per shard. Only the atoms' sums reach the driver, and their count is bounded by
``n_shards * atoms_per_shard`` plus ``3 * n_shards * (atoms_per_shard + pieces_per_shard + 1)``, whatever the input's size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import stored, words

DIMENSIONS = ("size", "tokens", "rows")
#: Parts of a shard whose rows are numbered apart.
PARTS = 256


def pack_vectors(vectors: np.ndarray, n_bins: int) -> np.ndarray:
    """The bin of each vector: largest vectors first, each into the bin where its dot product with the residual capacity is highest.

    A capacity is a bin's even share of every dimension. Bins where the whole vector fits come first, then bins where its
    first dimension (bytes, which shards must share evenly) fits; where that fits nowhere, the bin with the most room in it takes
    the vector. Ties go to the lowest bin.
    """
    total = vectors.sum(axis=0).astype(float)
    share = np.where(total > 0, total / n_bins, 1.0)
    scaled = vectors / share
    residual = np.ones((n_bins, vectors.shape[1]))
    bins = np.zeros(len(vectors), dtype=np.int64)
    for k in np.lexsort((np.arange(len(vectors)), -scaled.max(axis=1))):
        left = residual - scaled[k]
        whole, first = (left >= -1e-9).all(axis=1), left[:, 0] >= -1e-9
        if first.any():
            at = int(np.argmax(np.where(whole if whole.any() else first, residual @ scaled[k], -np.inf)))
        else:
            at = int(np.argmax(left[:, 0]))
        bins[k] = at
        residual[at] = left[at]
    return bins


def shard(
    docs: DataFrame, n_shards: int = 24, text: str = "text", key: str = "doc_id", group: Column | None = None, atoms_per_shard: int = 256, pieces_per_shard: int = 4
) -> DataFrame:
    """One row per document: ``key``, size (UTF-8 bytes plus 8), text_crc32, tokens, shard and slot (gapless from 0 in a shard).

    Shards have nearly equal bytes; tokens and rows are balanced as far as that allows. A group stays in one shard unless it has
    more bytes than an even share of all; such a one is split by a hash of key and text, so rows that are equal in both stay together.
    A null text has the size, tokens and checksum of an empty one and belongs to the same group. Null and repeated keys
    are rows like any other. Other columns of ``docs`` are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    rows = stored(
        docs.select(
            F.col(key).alias("key"),
            (F.octet_length(t) + 8).cast("long").alias("size"),
            F.crc32(t.cast("binary")).cast("long").alias("text_crc32"),
            F.size(words(t)).cast("long").alias("tokens"),
            F.unhex(F.md5((group if group is not None else t).cast("binary"))).alias("digest"),
        ),
        "sizes",
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*sums).first()
    out = ["key", "size", "text_crc32", "tokens"]
    if not total["rows"]:
        return rows.select(F.col("key").alias(key), *out[1:], F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)

    even = [max(1.0, (total[d] or 0) / n_shards) for d in DIMENSIONS]
    share = F.greatest(*(F.col(d) / F.lit(e) for d, e in zip(DIMENSIONS, even, strict=True)))
    large = rows.groupBy("digest").agg(*sums).where((F.col("rows") > 1) & (share >= 1 / atoms_per_shard))
    first, hot = n_shards * atoms_per_shard, []
    for r in sorted(large.select("digest", (F.col("size") / F.lit(even[0])).alias("bytes")).collect()):  # at most 3 * n_shards * atoms_per_shard groups can be so large
        pieces = int(np.ceil(r["bytes"] * pieces_per_shard)) if r["bytes"] > 1 else 1
        hot.append((r["digest"], first, pieces))
        first += pieces
    hot = spark.createDataFrame(hot, "h_digest binary, h_first long, h_pieces int")
    # a hash of key and digest deals a large group's rows to its pieces
    atom = F.when(F.col("h_first").isNotNull(), F.col("h_first") + F.pmod(F.xxhash64("key", "digest"), F.col("h_pieces"))).otherwise(
        F.pmod(F.xxhash64("digest"), F.lit(n_shards * atoms_per_shard))
    )
    # the part is a hash of its own, so a group in one atom is numbered in many parts
    part = F.pmod(F.xxhash64(F.lit("part"), "key", "digest"), F.lit(PARTS))
    rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("h_digest"), "left").withColumns({"atom": atom, "part": part}).drop("h_digest", "h_first", "h_pieces", "digest")
    atoms = sorted(rows.groupBy("atom").agg(*sums).collect())
    bins = pack_vectors(np.array([[a[d] for d in DIMENSIONS] for a in atoms], dtype=float), n_shards)
    placed = F.broadcast(spark.createDataFrame([(a["atom"], b) for a, b in zip(atoms, bins.tolist(), strict=True)], "p_atom long, shard int"))
    rows = rows.join(placed, F.col("atom") == F.col("p_atom")).drop("atom", "p_atom")
    filled, starts = [0] * n_shards, []
    for r in sorted(rows.groupBy("shard", "part").count().collect()):  # n_shards * PARTS at most
        starts.append((r["shard"], r["part"], filled[r["shard"]]))
        filled[r["shard"]] += r["count"]
    starts = F.broadcast(spark.createDataFrame(starts, "s_shard int, s_part long, start long"))
    rows = rows.withColumn("nth", F.expr("row_number() over (partition by shard, part order by key, text_crc32, size)"))
    rows = rows.join(starts, (F.col("shard") == F.col("s_shard")) & (F.col("part") == F.col("s_part")))
    return rows.select(F.col("key").alias(key), *out[1:], "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"))
