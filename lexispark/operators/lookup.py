"""What a query needs of the search index: rows by the places of terms, ranges of rows by threes of signs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.index import BLOCK, folded
from . import cql
from .filters import Filters
from .patterns import AllOf, AnyOf, Need

#: Rows or blocks of a query up to which they come to the driver, and ranges of row ids that a scan is given.
KEYED, RANGES = 20_000, 64
#: Threes of a literal that are looked up; a term this many times as frequent as the rarest is not looked up beside it.
THREES, FREQUENT = 8, 64


@dataclass(frozen=True)
class Index:
    """Counted terms, their places and the threes of signs of stored corpora."""

    token_stats: DataFrame
    postings: DataFrame
    grams: DataFrame


def ranges(ids: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold all ids (sorted); the widest gaps are left out."""
    gaps = sorted(range(1, len(ids)), key=lambda k: ids[k - 1] - ids[k])[: most - 1]
    cuts = [0, *sorted(k for k in gaps if ids[k] - ids[k - 1] > 1), len(ids)]
    return [(ids[i], ids[j - 1]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)] if ids else []


def within(found: list[tuple[str, int]], width: int = 1) -> Column:
    """A condition on corpus and row ids that the scan can push to the files' pages; ids count ``width`` rows each."""
    by: dict[str, list[int]] = {}
    for corpus, k in found:
        by.setdefault(corpus, []).append(k)
    parts = []
    for corpus, ids in sorted(by.items()):
        spans = [F.col("row_id").between(a * width, (b + 1) * width - 1) for a, b in ranges(sorted(set(ids)))]
        parts.append((F.col("corpus_id") == corpus) & reduce(lambda x, y: x | y, spans))
    return reduce(lambda x, y: x | y, parts) if parts else F.lit(False)


def _threes(text: str) -> list[str]:
    """Some threes of a literal that cover it evenly; a literal of fewer signs has none."""
    text = folded(text)
    all_ = list(dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2)))
    step = max(1, len(all_) / THREES)
    return [all_[int(k * step)] for k in range(min(THREES, len(all_)))]


def _terms(need: Need) -> object:
    """The need in threes of signs: a set of which all must occur, ("all" or "any", parts), or None."""
    if need is None:
        return None
    if isinstance(need, str):
        return frozenset(_threes(need)) or None
    parts = [_terms(n) for n in need.needs]
    if isinstance(need, AnyOf):
        return None if any(p is None for p in parts) else ("any", tuple(parts))
    parts = [p for p in parts if p is not None]
    return ("all", tuple(parts)) if parts else None


def _named(terms: object) -> set[str]:
    return set(terms) if isinstance(terms, frozenset) else set().union(*(_named(p) for p in terms[1]))


def blocks(index: Index, need: Need, filters: Filters) -> DataFrame | None:
    """(corpus_id, block) of the blocks that hold all threes of a need; None if it has none."""
    terms = _terms(need)
    if terms is None:
        return None
    entries = index.grams.where(filters.predicate(("corpus_id",)) & F.col("gram").isin(sorted(_named(terms))))
    held = entries.groupBy("corpus_id", "part").agg(F.collect_list(F.struct("gram", "blocks")).alias("held"))

    def of(three: str) -> Column:
        # a corpus that grew by batches has an entry for each
        return F.flatten(F.transform(F.filter("held", lambda x: x["gram"] == three), lambda x: x["blocks"]))

    def having(t: object) -> Column:
        if isinstance(t, frozenset):
            return reduce(F.array_intersect, map(of, sorted(t)))
        return reduce(F.array_intersect if t[0] == "all" else F.array_union, map(having, t[1]))

    return held.select("corpus_id", F.explode(F.array_distinct(having(terms))).alias("block"))


def near(utterances: DataFrame, index: Index, need: Need, filters: Filters) -> DataFrame:
    """The utterances without the ranges of rows that cannot hold a need; all of them, if it says nothing or is met nearly everywhere."""
    found = blocks(index, need, filters)
    if found is None:
        return utterances
    some = found.limit(KEYED + 1).collect()
    return utterances if len(some) > KEYED else utterances.where(within([(r["corpus_id"], r["block"]) for r in some], BLOCK))


def places(index: Index, kind: str, term: Column, filters: Filters) -> DataFrame:
    """(corpus_id, row_id, at): where a term stands."""
    entries = index.postings.where(filters.predicate(("corpus_id",)) & (F.col("kind") == kind) & (F.col("term") == term))
    return entries.select("corpus_id", F.explode(F.arrays_zip("rows", "at")).alias("x")).select("corpus_id", F.col("x.rows").alias("row_id"), "x.at")


def rows_with(index: Index, kind: str, term: Column, filters: Filters) -> DataFrame:
    """(corpus_id, row_id) of the rows that hold a term; a row's places all lie in one entry."""
    entries = index.postings.where(filters.predicate(("corpus_id",)) & (F.col("kind") == kind) & (F.col("term") == term))
    return entries.select("corpus_id", F.explode(F.array_distinct("rows")).alias("row_id"))


def count(index: Index, kind: str, term: Column, filters: Filters) -> int:
    counted = index.token_stats.where(filters.predicate(("corpus_id",)) & (F.col("kind") == kind) & (F.col("term") == term))
    return counted.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]


def only(utterances: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """The utterances of given keys (corpus_id, row_id), of which there are at most ``most``; all utterances, if that is too many.

    Few keys come to the driver and make ranges of rows, so the scan reads their pages. More lie on nearly all pages, and joining them would
    shuffle the corpus with all its tokens: whoever asks then looks at the rows for what they must hold.
    """
    if most > KEYED:
        return utterances
    found = [(r["corpus_id"], r["row_id"]) for r in keys.collect()]
    return utterances.where(within(found)).join(F.broadcast(utterances.sparkSession.createDataFrame(found, "corpus_id string, row_id long")), ["corpus_id", "row_id"], "left_semi")


def by_terms(index: Index, terms: list[tuple[str, Column]], filters: Filters) -> tuple[DataFrame, int] | None:
    """(corpus_id, row_id) of the rows that hold all terms, and how many there are at most; None without terms.

    The rarest term drives; terms that are far more frequent are left to whoever looks at the rows.
    """
    if not terms:
        return None
    counted = sorted(((count(index, kind, term, filters), k) for k, (kind, term) in enumerate(terms)))
    least = counted[0][0]
    keys = rows_with(index, *terms[counted[0][1]], filters)
    for n, k in counted[1:]:
        if n <= FREQUENT * least:
            keys = keys.join(rows_with(index, *terms[k], filters), ["corpus_id", "row_id"], "left_semi")
    return keys, least


def pairs(index: Index, elements: list[cql.Element], layer: str, tagged: bool, filters: Filters) -> DataFrame | None:
    """Matches of two exact tokens with a gap, from their places alone: (corpus_id, row_id, ordinal, s, e); None for other patterns."""
    gap = cql.gap_of(elements, tagged)
    if gap is None:
        return None
    (k1, _, t1), (k2, _, t2) = cql.required([elements[0], elements[-1]], layer, tagged)
    first = places(index, k1, t1, filters).withColumnRenamed("at", "s")
    last = places(index, k2, t2, filters).withColumnRenamed("at", "t")
    found = first.join(last, ["corpus_id", "row_id"]).where((F.col("t") - F.col("s") - 1).between(*gap))
    nth = F.row_number().over(W.partitionBy("corpus_id", "row_id").orderBy("s", "t")) - 1
    return found.select("corpus_id", "row_id", nth.cast("int").alias("ordinal"), "s", (F.col("t") + 1).alias("e"))
