"""Vectorised text handling for Arrow batches: bounded slices, words as codes, characters as code points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about this many bytes (one text at least), whatever the size of an Arrow batch.
SLICE_BYTES = 2 << 20
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, pa.LargeStringArray]]:
    """Parts of a batch with their texts, null ones as empty."""
    texts = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        part = pa.concat_arrays([texts.slice(start, stop - start)])  # a copy of its own, so offsets start at 0
        yield batch.slice(start, stop - start), part
        start = stop


def per_slice(make: Callable[[pa.RecordBatch, pa.LargeStringArray], pa.RecordBatch]):
    """A function for mapInArrow that applies ``make`` to each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                yield make(part, texts)

    return run


def buffer(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets between them."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_codes(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(offsets of each text's words, code of each word, the words by code); words are separated by ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    flat = lists.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)[real]
    encoded = flat.filter(pa.array(real)).dictionary_encode()
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
    return offsets, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_pylist()


def between(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``marks`` from each offset to the next."""
    total = np.zeros(len(marks) + 1, dtype=np.int64)
    np.cumsum(marks, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def code_points(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and the offsets between texts."""
    data, offsets = buffer(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate([[0], np.cumsum(between((data & 0xC0) != 0x80, offsets))])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
