"""The search index of a stored corpus: where each term stands, and which blocks of rows hold which three signs in a row.

``postings`` has for each term (a token, lemma or tag) the rows and token places where it stands, in order; ``grams`` has for each
three signs the blocks of ``BLOCK`` row ids that hold them. Each task writes the entries of its own rows as a sorted file, so a look-up reads
the pages of its terms only, in each file, and writing shuffles nothing. The entries of a term are split by ranges of rows, so none of them grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LOWER, UPPER

#: Row ids of a block, blocks of an entry of ``grams``, and tokens by which ``postings`` are split into ranges of rows.
BLOCK, BLOCKS, TOKENS = 1024, 65_536, 2_000_000
#: Signs that are cut into threes at once, pairs (three signs, block) and places of a kind that a task holds, and those that it gives at once.
SIGNS, PAIRS, PLACES, EMITTED = 1_000_000, 4_000_000, 4_000_000, 500_000


def _lists(first: np.ndarray, stop: int, *values: np.ndarray) -> list[pa.ListArray]:
    """Lists of values from each of ``first`` up to the next one, the last up to ``stop``."""
    offsets = pa.array(np.append(first, stop) - first[0], pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(v[first[0] : stop])) for v in values]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def postings(utterances: DataFrame, tokens: int, last_row: int) -> DataFrame:
    """(kind, term, part, rows, at): every place of every term; rows and places of an entry are parallel and in order.

    Each task gathers the places of its own rows, so nothing is shuffled; a term and part has an entry for each task, or for each ``PLACES`` of one, that holds it.
    """
    width = last_row // max(1, -(-tokens // TOKENS)) + 1
    kinds = (("raw", "tokens", "normalized"), ("provided", "provided", "normalized"), ("lemma", "provided", "lemma"), ("pos", "provided", "pos"))

    def entries(kind: str, held: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        terms, row, at = zip(*held, strict=True)
        coded = pa.concat_arrays(terms).dictionary_encode()
        code, row, at = coded.indices.to_numpy(), np.concatenate(row), np.concatenate(at)
        order = np.lexsort((at, row, code))
        code, row, at = code[order], row[order], at[order]
        part = row // width
        first = _starts(code, part)
        start = 0
        while start < len(first):
            end = max(start + 1, int(np.searchsorted(first, first[start] + EMITTED)))
            some, stop = first[start:end], int(first[end]) if end < len(first) else len(code)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(some)), coded.dictionary.take(pa.array(code[some])).cast(pa.string()), pa.array(part[some]), *_lists(some, stop, row, at)], ["kind", "term", "part", "rows", "at"])
            start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {kind: [] for kind, _, _ in kinds}
        size = dict.fromkeys(held, 0)
        for batch in batches:
            ids = batch.column("row_id").to_numpy()
            for kind in held:
                lists = batch.column(kind)
                n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                terms, ends = lists.flatten(), np.cumsum(n)
                at = (np.arange(len(terms)) - np.repeat(ends - n, n)).astype(np.int32)
                known = pc.is_valid(terms).to_numpy(zero_copy_only=False)
                held[kind].append((terms.drop_null().cast(pa.large_string()), np.repeat(ids, n)[known], at[known]))
                size[kind] += len(held[kind][-1][1])
                if size[kind] > PLACES:
                    yield from entries(kind, held[kind])
                    held[kind], size[kind] = [], 0
        for kind, rest in held.items():
            if size[kind]:
                yield from entries(kind, rest)

    layers = utterances.select("row_id", *(F.col(f"{layer}.{field}").alias(kind) for kind, layer, field in kinds))
    return layers.mapInArrow(run, "kind string, term string, part long, rows array<long>, at array<int>").sortWithinPartitions("kind", "term", "part")


def _threes(texts: pa.LargeStringArray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (three signs as one number, block) of texts; A-Z count as a-z."""
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    points = np.where((points >= 65) & (points <= 90), points + 32, points)
    n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), n)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = owner[:-2] == owner[2:]
    code = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[whole]
    return _distinct(code, block[owner[:-2][whole]])


def _distinct(code: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((block, code))
    code, block = code[order], block[order]
    first = _starts(code, block)
    return code[first], block[first]


def grams(utterances: DataFrame) -> DataFrame:
    """(gram, part, blocks): blocks of rows whose form or original form holds three signs, A-Z lower-cased, in a row.

    Nothing is shuffled, as in ``postings``: there is an entry for each task that holds the three, and tasks whose rows lie in the same block each name it.
    """

    def entries(code: np.ndarray, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = block // BLOCKS
        first = _starts(code, part)
        for i in range(0, len(first), 50_000):
            some = first[i : i + 50_000]
            stop = first[i + 50_000] if i + 50_000 < len(first) else len(code)
            text = [chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF) for c in code[some].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(part[some]), *_lists(some, stop, block)], ["gram", "part", "blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = merged = 0
        for batch in batches:
            for c in ("form", "other"):
                texts = pc.fill_null(batch.column(c).cast(pa.large_string()), "")
                block = batch.column("row_id").to_numpy() // BLOCK
                ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
                start = 0
                while start < len(texts):
                    stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SIGNS, side="right")))
                    held.append(_threes(texts.slice(start, stop - start), block[start:stop]))
                    size += len(held[-1][0])
                    start = stop
                    if size > merged + PAIRS:
                        held = [_distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                        size = merged = len(held[0][0])
        if held:
            yield from entries(*_distinct(*(np.concatenate(x) for x in zip(*held, strict=True))))

    rows = utterances.select("row_id", "form", F.when(F.col("original_form") != F.col("form"), F.col("original_form")).alias("other"))
    return rows.mapInArrow(run, "gram string, part long, blocks array<long>").sortWithinPartitions("gram", "part")


def folded(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))
