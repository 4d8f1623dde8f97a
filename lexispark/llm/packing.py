"""Packing of token sequences into fixed-size bins by conflict-constrained best fit.

Documents longer than a bin are cut into pieces. Pieces are dealt by hash into packing groups of about ``GROUP_ROWS``, and each
group is packed on its own, longest piece first. Open bins are ordered by residual; each carries a bitmap of the
duplicate clusters and bitmaps of the sources that it holds. The search starts at the smallest residual that holds the
piece and goes on to the next larger one until a bin is found that the piece does not conflict with.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import ascii_lower, stored, words

CAPACITY = 2048
PER_SOURCE = 2
GROUP_ROWS = 20_000


class Shelf:
    """Bins of one residual and the same full sources, oldest first.

    For each cluster it keeps the place before which all bins hold the cluster; a bin leaves a shelf when something is put into it, so
    that place only moves on, and no bin is looked at twice for a cluster.
    """

    def __init__(self) -> None:
        self.bins: list[list | None] = []
        self.places: dict[int, int] = {}
        self.first = self.left = 0

    def add(self, b: list) -> None:
        self.bins.append(b)
        self.left += 1

    def take(self, cluster: int) -> list | None:
        """The oldest bin that does not hold the cluster."""
        bins = self.bins
        while self.first < len(bins) and bins[self.first] is None:
            self.first += 1
        k = max(self.first, self.places.get(cluster, 0))
        while k < len(bins) and (bins[k] is None or bins[k][1] & cluster):
            k += 1
        if cluster:
            self.places[cluster] = k
        if k == len(bins):
            return None
        b, bins[k] = bins[k], None
        self.left -= 1
        if len(bins) > 64 and self.left * 2 < len(bins):
            self.bins, self.first, self.places = [x for x in bins if x is not None], 0, {}
        return b


class Bins:
    """Open bins by residual, and those of one residual by their bitmaps of full sources, so a source that many bins already hold is skipped at once."""

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source, self.count = capacity, per_source, 0
        self.levels: dict[int, dict[int, Shelf]] = {}  # residual -> full sources -> bins
        self.open = 0  # bit r: a bin has residual r

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset of a piece; source and cluster are single bits, cluster 0 if nothing else is in it."""
        rest = self.open >> size << size
        while rest:
            low = rest & -rest
            residual = low.bit_length() - 1
            level = self.levels[residual]
            for full, shelf in level.items():
                if not full & source and (b := shelf.take(cluster)):
                    if not shelf.left:
                        del level[full]
                        if not level:
                            del self.levels[residual]
                            self.open ^= low
                    return self._put(b, residual, size, source, cluster)
            rest ^= low
        self.count += 1
        return self._put([self.count - 1, 0, [0] * self.per_source], self.capacity, size, source, cluster)

    def _put(self, b: list, residual: int, size: int, source: int, cluster: int) -> tuple[int, int]:
        b[1] |= cluster
        for k, plane in enumerate(b[2]):  # plane k: sources with more than k pieces here
            if not plane & source:
                b[2][k] |= source
                break
        if left := residual - size:
            self.levels.setdefault(left, {}).setdefault(b[2][-1], Shelf()).add(b)
            self.open |= 1 << left
        return b[0], self.capacity - residual


def pack_group(pieces: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Best fit, longest piece first; ties by all columns, so the result does not depend on the order of arrival."""
    pieces = pieces.sort_values(["n_tokens", "key", "piece", "source", "cluster"], ascending=[False, True, True, True, True], na_position="last", kind="stable")
    source = pd.factorize(pieces["source"], use_na_sentinel=False)[0]
    often = pieces["cluster"].duplicated(keep=False)
    cluster = pd.factorize(pieces["cluster"].where(often))[0]  # -1: nothing to conflict with
    bins = Bins(capacity, per_source)
    found = [bins.place(n, 1 << s, 1 << c if c >= 0 else 0) for n, s, c in zip(pieces["n_tokens"].tolist(), source.tolist(), cluster.tolist(), strict=True)]
    pieces["bin"], pieces["offset"] = [f[0] for f in found], [f[1] for f in found]
    return pieces


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    n_tokens: Column | None = None,
    cluster: Column | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per piece: ``key``, piece (from 0), start (first token), n_tokens, source, bin (unique over all), offset in the bin.

    No bin holds more than ``capacity`` tokens, more than ``per_source`` pieces of a source, or two pieces of a duplicate
    cluster (by default texts that are equal but for A-Z case; pieces of one document count as one cluster too; near copies only
    count as one where ``cluster`` says so). Token counts are words unless ``n_tokens`` is given. Null and blank texts have 0 tokens
    and give no row. A null source is a source of its own; null keys and repeated rows are rows like any other, dealt to the groups by
    their place in the table. Long texts are cut into pieces. Other columns are not read. An empty table gives an empty table.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        F.col(source).cast("string").alias("source"),
        (n_tokens if n_tokens is not None else F.size(words(t))).cast("int").alias("total"),
        (cluster if cluster is not None else F.xxhash64(ascii_lower(t))).cast("long").alias("cluster"),
    ).where(F.col("total") > 0)
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # equal rows go to different groups
    rows = stored(rows, "lengths")  # texts are read once; the number of groups follows the pieces
    last = F.floor((F.col("total") - 1) / capacity).cast("int")
    groups = max(1, math.ceil((rows.agg(F.sum(last.cast("long") + 1)).first()[0] or 0) / group_rows))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("n_tokens", F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity))
    rows = rows.withColumn("pack_group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("long")).drop("total", "row")
    kind = rows.schema["key"].dataType.simpleString()

    def packed(pieces: pd.DataFrame) -> pd.DataFrame:
        return pack_group(pieces, capacity, per_source)

    out = rows.groupBy("pack_group").applyInPandas(packed, f"key {kind}, source string, cluster long, piece int, n_tokens int, pack_group long, bin long, offset long")
    return out.select(
        F.col("key").alias(key),
        "piece",
        (F.col("piece").cast("long") * capacity).alias("start"),
        F.col("n_tokens").cast("long").alias("n_tokens"),
        "source",
        (F.col("pack_group") * F.lit(1 << 32) + F.col("bin")).alias("bin"),
        "offset",
    )
