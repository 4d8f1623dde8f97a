"""Language-model scores of texts by a class-based bigram model (Brown).

P(word | word before) = P(class | class before) * P(word | class). The classes come from exchange clustering: each word may move to the class that
raises the likelihood of the training text most.

1. Words are counted over all training texts, by 64-bit hashes.
2. The ``FREQUENT`` most frequent words get their followers and forerunners as one row each, from all training texts.
3. In each round every such word's profile (how often each class stands before and after it) is made anew, and half of the words may
   move, all at once, against the transitions of the round before. A round that does not raise the likelihood is taken back.
4. All other words take the class in which their neighbours' classes are likeliest, by the first order of the same gain.
5. Words that were seen once stand for unknown ones: where they occur an unknown word is expected. An unknown word is a class of its own.

So probabilities are of one more type than there are words, as in the base model, and sum to 1 after every word. What goes through
the driver is bounded by parameters: the frequent words, the matrix of classes, and the table of the ``SENT`` most frequent words.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from ._base import dropped, stored

#: Words that are exchanged, classes, and rounds at most.
FREQUENT, CLASSES, ROUNDS = 16_384, 96, 6
#: Words whose class and count are sent to all tasks, the most frequent ones (at most so many, 18 bytes each); others are joined by shuffle.
SENT = 1 << 21
#: Rows of neighbours are merged in this many groups; occurrences of other words in groups of about so many.
NEIGHBOUR_GROUPS, GROUP_WORDS = 256, 1_000_000
#: Tasks whose parts of a group are merged at once, and groups that a task deals to; beyond either, groups are dealt in two steps.
MERGED, FAN = 1000, 1000
#: Weight of class frequencies in the transitions, and of the base model in the mixture.
PRIOR, BASE_PART = 5.0, 0.02
#: Bytes of text that are hashed at once, and pairs that a task collects before it merges them.
CHUNK, HELD = 4 << 20, 2_000_000
END = np.uint64(0x454E44)

_LONG = 64
_BYTES = textkit.mixed(np.arange(1, 256 * _LONG + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(_LONG, 256)
_BYTES[:, 65:91] = _BYTES[:, 97:123]  # A-Z as a-z
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word by its bytes and their places."""
    n = ends - starts
    total = np.cumsum(n)
    place = np.arange(total[-1] if len(total) else 0) - np.repeat(total - n, n)
    values = _BYTES[place % _LONG, data[np.repeat(starts, n) + place]]
    if len(n) and n.max() > _LONG:
        far = np.flatnonzero(place >= _LONG)
        values[far] = textkit.mixed(values[far] + (place[far] // _LONG).astype(np.uint64))
    return textkit.mixed(np.add.reduceat(values, total - n)) if len(n) else np.zeros(0, np.uint64)


def hashed_words(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, A-Z lower-cased, each text followed by ``END``; and the offsets between texts."""
    data, offsets = textkit.buffer(texts)
    word = np.zeros(len(data) + 2, dtype=bool)
    word[1:-1] = ~_IS_SPACE[data]
    fresh = np.zeros(len(data) + 2, dtype=bool)
    fresh[offsets + 1] = True  # a text starts anew
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | fresh[1:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | fresh[2:])) + 1
    parts, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        parts.append(_hash_words(data, starts[i:j], ends[i:j]))
        i = j
    before = np.searchsorted(starts, offsets)  # words before each text
    out = np.full(len(starts) + len(texts), END)
    if parts:
        owner = np.repeat(np.arange(len(texts)), np.diff(before))
        out[np.arange(len(starts)) + owner] = np.concatenate(parts)
    return out, before + np.arange(len(texts) + 1)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


class _Sums:
    """Counts by key, merged when many have come together."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.merged = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > self.merged + HELD:
            self.parts = [self.total()]
            self.size = self.merged = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return _summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, n): the words of all texts, the end of a text among them."""

    def run(batches):
        sums = _Sums()
        for batch in batches:
            for _, part in textkit.slices(batch):
                sums.add(hashed_words(part)[0].view(np.int64))
        keys, n = sums.total()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["h", "n"])

    return texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass
class Frequent:
    """The most frequent words, sorted by hash, with their places by frequency. A word that is not among them has the id ``size``, the end of a
    text (which is what stands before a text, too) the id after."""

    hashes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray  # by id

    @property
    def size(self) -> int:
        return len(self.hashes)

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.size, dtype=np.int64)
        if self.size:
            at = np.minimum(np.searchsorted(self.hashes, h), self.size - 1)
            out = np.where(self.hashes[at] == h, self.ids[at], out)
        return np.where(h == END, self.size + 1, out)


def frequent(counts: DataFrame, most: int = FREQUENT) -> Frequent:
    top = counts.where(F.col("h") != int(END.view(np.int64))).orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    return Frequent(h[order], order, n)


def _before(values: np.ndarray, offsets: np.ndarray, first: int) -> np.ndarray:
    """What stands before each token; ``first`` at the start of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[offsets[:-1]] = first
    return out


def _dealt(packed: DataFrame, parts: int, groups: int, merge: Callable, schema: str, finish: Callable, final: str) -> DataFrame:
    """Packed parts of groups to one table a group.

    ``packed`` has grp, salt (the task) and byte strings. With many tasks or groups, grp is a coarse one, and its parts of some tasks each are
    merged and dealt to the groups by ``merge``; so no task gets all parts of a large group, and none makes a row for each group.
    """
    if two_steps(parts, groups):
        packed = packed.groupBy("grp", F.pmod("salt", F.lit(math.ceil(parts / MERGED))).alias("s")).applyInArrow(merge, schema)
    return packed.groupBy("grp").applyInArrow(finish, final)


def two_steps(parts: int, groups: int) -> bool:
    return parts > MERGED or groups > FAN


def _joined(t: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in t.column(column)), dtype=kind)


def _packed(grp: np.ndarray, salt: int, **columns: np.ndarray) -> pa.RecordBatch:
    """One row for each group, with the columns' values as bytes."""
    order = np.argsort(grp, kind="stable")
    there, first = np.unique(grp[order], return_index=True)
    cuts = np.append(first, len(grp)).tolist()
    cut = lambda x: pa.array([x[i:j].tobytes() for i, j in itertools.pairwise(cuts)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(np.full(len(there), salt), pa.int32()), *(cut(x[order]) for x in columns.values())], ["grp", "salt", *columns])


def neighbours(texts: DataFrame, words: Frequent, groups: int = NEIGHBOUR_GROUPS) -> DataFrame:
    """(id, after, after_n, before, before_n) of the frequent words and of the two ids beyond: what follows and precedes them, how often."""
    span = words.size + 2

    def pack(keys: np.ndarray, n: np.ndarray, salt: int) -> pa.RecordBatch:
        """Keys are (side, id, other id): the other one follows the id (side 0) or precedes it (side 1)."""
        return _packed(keys // span % span % groups, salt, keys=keys.astype("<i8"), times=n.astype("<i8"))

    def run(batches):
        from pyspark import TaskContext

        sums = _Sums()
        for batch in batches:
            for _, part in textkit.slices(batch):
                h, offsets = hashed_words(part)
                ids = words.of(h)
                sums.add(_before(ids, offsets, words.size + 1) * span + ids)
        keys, n = sums.total()
        left, right = keys // span, keys % span
        yield pack(np.concatenate([keys, span * span + right * span + left]), np.concatenate([n, n]), TaskContext.get().partitionId())

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([pack(*_summed(_joined(t, "keys", "<i8"), _joined(t, "times", "<i8")), key[1].as_py())])

    def finish(key: tuple, t: pa.Table) -> pa.Table:
        keys, n = _summed(_joined(t, "keys", "<i8"), _joined(t, "times", "<i8"))
        ids = np.unique(keys // span % span)
        columns = [pa.array(ids, pa.int32())]
        for side in (0, 1):
            here = keys // (span * span) == side
            cuts = pa.array(np.append(np.searchsorted(keys[here] // span % span, ids), here.sum()), pa.int32())
            columns += [pa.ListArray.from_arrays(cuts, pa.array(keys[here] % span, pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(n[here], pa.int64()))]
        return pa.Table.from_arrays(columns, ["id", "after", "after_n", "before", "before_n"])

    schema = "grp int, salt int, keys binary, times binary"
    packed = texts.select("text").mapInArrow(run, schema)
    return _dealt(packed, texts.rdd.getNumPartitions(), groups, merge, schema, finish, "id int, after array<int>, after_n array<long>, before array<int>, before_n array<long>")


def _phi(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(n: np.ndarray) -> float:
    """The part of the training text's log likelihood that depends on the classes: pairs of classes against single ones."""
    return float(_phi(n).sum() - _phi(n.sum(axis=0)).sum() - _phi(n.sum(axis=1)).sum())


def gains(n: np.ndarray, classes: int, own: int, before: np.ndarray, after: np.ndarray, twice: float) -> np.ndarray:
    """How the likelihood changes when a word moves from class ``own`` to each of the first ``classes``.

    ``n`` counts pairs of classes; ``before`` and ``after`` count the classes beside the word, without the word itself, which follows itself
    ``twice`` times.
    """
    c1, c0 = after.sum() + twice, before.sum() + twice
    bare = n.copy()  # without the word
    bare[own] -= after
    bare[:, own] -= before
    bare[own, own] -= twice
    rows, columns = n.sum(axis=1), n.sum(axis=0)
    rows[own] -= c1
    columns[own] -= c0
    g, f = np.flatnonzero(after), np.flatnonzero(before)
    b = np.arange(classes)
    right, left = bare[np.ix_(b, g)], bare[np.ix_(f, b)]
    change = (_phi(right + after[g]) - _phi(right)).sum(axis=1) + (_phi(left + before[f][:, None]) - _phi(left)).sum(axis=0)
    # a class's pair with itself changes by both sides at once
    self_ = bare[b, b]
    change += _phi(self_ + after[b] + before[b] + twice) - _phi(self_ + after[b]) - _phi(self_ + before[b]) + _phi(self_)
    change -= _phi(rows[b] + c1) - _phi(rows[b]) + _phi(columns[b] + c0) - _phi(columns[b])
    return change - change[own]


def _profiles(batch: pa.RecordBatch, classes: np.ndarray, kinds: int):
    """(id, before, after, twice) of each row: classes beside the word, without the word itself."""
    ids = batch.column("id").to_numpy()
    lists = [(batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy(), batch.column(f"{c}_n").values.to_numpy()) for c in ("before", "after")]
    for k, x in enumerate(ids.tolist()):
        sides, twice = [], 0.0
        for offsets, other, n in lists:
            o, m = other[offsets[k] : offsets[k + 1]], n[offsets[k] : offsets[k + 1]].astype(float)
            itself = o == x
            twice = float(m[itself].sum())
            sides.append(np.bincount(classes[o], np.where(itself, 0, m), minlength=kinds))
        yield x, sides[0], sides[1], twice


def transitions(beside: DataFrame, classes: np.ndarray, kinds: int) -> np.ndarray:
    """How often each class follows each other one."""

    def run(batches):
        total = np.zeros((kinds, kinds))
        for batch in batches:
            for x, _, after, twice in _profiles(batch, classes, kinds):
                total[classes[x]] += after
                total[classes[x], classes[x]] += twice
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at])], ["cell", "n"])

    out = np.zeros(kinds * kinds)
    for r in beside.select("id", "before", "before_n", "after", "after_n").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(kinds, kinds)


def exchange(beside: DataFrame, words: Frequent, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of all ids: 0 to classes - 1 of the frequent words, then one of the other words and one of the end."""
    kinds = classes + 2
    now = np.append(np.arange(words.size) % classes, [classes, classes + 1])
    n = transitions(beside, now, kinds)
    value = likelihood(n)
    for turn in range(rounds):
        given, pairs = now.copy(), n

        def move(batches, given=given, pairs=pairs, turn=turn):
            for batch in batches:
                found = []
                for x, before, after, twice in _profiles(batch, given, kinds):
                    if x < words.size and (_turn(x) + turn) % 2 == 0:
                        found.append((x, int(np.argmax(gains(pairs, classes, int(given[x]), before, after, twice)))))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32())], ["id", "cls"])

        moved = beside.mapInArrow(move, "id int, cls int").toArrow()
        then = now.copy()
        then[moved.column("id").to_numpy()] = moved.column("cls").to_numpy()
        n2 = transitions(beside, then, kinds)
        if (better := likelihood(n2)) > value:
            done = turn > 1 and better - value < 1e-4 * abs(value)
            now, n, value = then, n2, better
            if done:
                break
        elif turn:
            break
    return now


def _turn(x: int) -> int:
    """0 or 1 for each id, neighbours in frequency apart by chance."""
    return int(textkit.mixed(np.array([x], dtype=np.uint64))[0] & np.uint64(1))


def _log_share(n: np.ndarray, axis: int) -> np.ndarray:
    """Logarithms of n's shares along an axis, each cell with a hundredth more."""
    m = n + 0.01
    return np.log(m / m.sum(axis=axis, keepdims=True))


def place_others(texts: DataFrame, words: Frequent, classes: np.ndarray, n: np.ndarray, k: int, groups: int) -> DataFrame:
    """All words but the frequent ones, one row each: (h, n, cls) and the classes beside them (left, right, times: a pair of classes and how often)."""
    parts = texts.rdd.getNumPartitions()
    coarse = math.ceil(math.sqrt(groups)) if two_steps(parts, groups) else groups

    def pack(h: np.ndarray, pair: np.ndarray, times: np.ndarray, salt: int, among: int) -> pa.RecordBatch:
        grp = (textkit.mixed(h) % np.uint64(groups)).astype(np.int64) % among
        return _packed(grp, salt, h=h, pair=pair.astype("<u4"), times=times.astype("<i8") if times.max(initial=0) > 255 else times.astype("u1"))

    def unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, pair of classes and times, equal ones together, in order."""
        h, pair = _joined(t, "h", "<u8"), _joined(t, "pair", "<u4")
        width = [len(a.as_buffer()) * 4 // len(b.as_buffer()) for a, b in zip(t.column("times"), t.column("pair"), strict=True)]
        times = np.concatenate([np.frombuffer(x.as_buffer(), "<i8" if w == 8 else "u1").astype(np.int64) for x, w in zip(t.column("times"), width, strict=True)])
        order = np.lexsort((pair, h))
        h, pair, times = h[order], pair[order], times[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (pair[1:] != pair[:-1])]))
        return h[first], pair[first].astype(np.int64), np.add.reduceat(times, first)

    def run(batches):
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId()
        held, size = [], 0
        for batch in batches:
            for _, part in textkit.slices(batch):
                h, offsets = hashed_words(part)
                c = classes[words.of(h)]
                here = np.flatnonzero(c == k)  # never the last token, which is an end
                held.append((h[here], _before(c, offsets, k + 1)[here] << 16 | c[here + 1]))
                size += len(here)
                if size > HELD:
                    yield pack(*(np.concatenate(x) for x in zip(*held, strict=True)), np.ones(size, np.int64), salt, coarse)
                    held, size = [], 0
        if size:
            yield pack(*(np.concatenate(x) for x in zip(*held, strict=True)), np.ones(size, np.int64), salt, coarse)

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([pack(*unpack(t), key[1].as_py(), groups)])

    # log P(class | class before) + log P(class after | class) - log(size of the class)
    forward, size = _log_share(n, 1), np.log(n.sum(axis=1)[:k] + 1)
    enter, leave = forward[:, :k], forward[:k].T

    def finish(key: tuple, t: pa.Table) -> pa.Table:
        h, pair, times = unpack(t)
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
        total, ends = np.add.reduceat(times, first), np.append(first[1:], len(h))
        best, i = np.zeros(len(first), dtype=np.int64), 0
        while i < len(first):  # some words at once
            j = max(i + 1, int(np.searchsorted(ends, first[i] + 50_000, side="right")))
            a, b = first[i], ends[j - 1]
            fit = np.add.reduceat((enter[pair[a:b] >> 16] + leave[pair[a:b] & 0xFFFF]) * times[a:b, None], first[i:j] - a, axis=0)
            best[i:j] = np.argmax(fit - total[i:j, None] * size, axis=1)
            i = j
        cuts = pa.array(np.append(first, len(h)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x, kind)) for x, kind in ((pair >> 16, pa.int32()), (pair & 0xFFFF, pa.int32()), (times, pa.int64()))]
        return pa.Table.from_arrays([pa.array(h[first].view(np.int64)), pa.array(total, pa.int64()), pa.array(best, pa.int32()), *lists], ["h", "n", "cls", "left", "right", "times"])

    schema = "grp int, salt int, h binary, pair binary, times binary"
    final = "h long, n long, cls int, left array<int>, right array<int>, times array<long>"
    return _dealt(texts.select("text").mapInArrow(run, schema), parts, groups, merge, schema, finish, final)


@dataclass
class Model:
    """``words``: (h, n, cls) of all words but the end. Classes: 0 to k - 1 of words, k of the end, k + 1 of unknown words."""

    words: DataFrame
    n_words: int
    ends: int
    tokens: int
    k: int
    step: np.ndarray  # P(class | class before)
    sizes: np.ndarray  # occurrences of all words of a class

    @property
    def types(self) -> int:
        return self.n_words + (self.ends > 0)

    def base(self, n: np.ndarray) -> np.ndarray:
        """The base model's probability of a word seen n times."""
        return (n + 0.5) / (self.tokens + 0.5 * (self.types + 1))

    def probability(self, before: np.ndarray, cls: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of a word of class ``cls`` seen n times after one of class ``before``."""
        inside = np.where(cls < self.k, n / np.maximum(1, self.sizes[np.minimum(cls, self.k - 1)]), 1.0)
        return (1 - BASE_PART) * self.step[before, cls] * inside + BASE_PART * self.base(n)


def fit(texts: DataFrame, classes: int = CLASSES, most: int = FREQUENT, rounds: int = ROUNDS) -> Model:
    """A model of all texts (column ``text``), whole.

    Null and empty texts are an end alone. Without any text all words are unknown. Repeated rows count as often as they occur.
    """
    k, kinds = classes, classes + 2
    counts = stored(word_counts(texts), "counts")
    is_end = F.col("h") == int(END.view(np.int64))
    n_words, tokens, ends = counts.agg(F.count(F.when(~is_end, 1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(is_end, F.col("n"))), F.lit(0))).first()
    words = frequent(counts, most)
    beside = stored(neighbours(texts, words), "neighbours")
    cls = exchange(beside, words, classes, rounds)
    n = transitions(beside, cls, kinds)
    dropped(beside)
    rest = tokens - ends - int(words.counts.sum())
    placed = stored(place_others(texts, words, cls, n, k, max(1, math.ceil(rest / GROUP_WORDS))), "others")
    dropped(counts)

    # transitions of the other words by the classes they have now; the last column and row of kinds + 1 are of words seen once
    def cells(batches):
        total = np.zeros((kinds + 1) ** 2)
        for batch in batches:
            own = np.repeat(batch.column("cls").to_numpy(), batch.column("left").value_lengths().to_numpy())
            once = np.repeat(batch.column("n").to_numpy() == 1, batch.column("left").value_lengths().to_numpy())
            left, right, times = (batch.column(c).flatten().to_numpy() for c in ("left", "right", "times"))
            side = kinds + 1
            for x, y, keep in ((left, own, None), (own, right, None), (left, np.full(len(own), kinds), once), (np.full(len(own), kinds), right, once)):
                w = times if keep is None else times * keep
                total += np.bincount(x * side + y, w, minlength=side * side)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["cell", "n"])

    more = np.zeros((kinds + 1) ** 2)
    for r in placed.mapInArrow(cells, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        more[r["cell"]] = r["n"]
    sizes = np.zeros(k)
    np.add.at(sizes, cls[: words.size], words.counts)
    for r in placed.groupBy("cls").agg(F.sum("n").alias("n")).collect():
        sizes[r["cls"]] += r["n"]
    step = _steps(n, more.reshape(kinds + 1, kinds + 1), k)
    top = counts.sparkSession.createDataFrame(pa.table({"h": words.hashes.view(np.int64), "n": words.counts[words.ids], "cls": cls[words.ids].astype(np.int32)}))
    return Model(top.unionByName(placed.select("h", "n", "cls")), n_words, ends, tokens, k, step, sizes)


def _steps(n: np.ndarray, more: np.ndarray, k: int) -> np.ndarray:
    """P(class | class before) over word classes, the end and the unknown.

    ``n`` has the pairs of frequent words (class k: any other word, k + 1: the end), ``more`` those of the other words by their own class,
    once for each side, and of words seen once (k + 2).
    """
    other, end, once = k, k + 1, k + 2
    at = [*range(k), end, once]
    full = np.zeros((k + 2, k + 2))
    plain = [*range(k), end]
    full[: k + 1, : k + 1] = n[np.ix_(plain, plain)] + more[np.ix_(plain, plain)]
    # two other words in a row: of one it is known what class the other side has
    share = full[:k, :k] + 1e-9
    full[:k, :k] += more[:k, other][:, None] * share / share.sum(axis=1, keepdims=True)
    full[: k + 1, k + 1] = more[plain, once]
    full[k + 1] = more[once][at]
    prior = full.sum(axis=0) + 0.5
    return (full + PRIOR * prior / prior.sum()) / (full.sum(axis=1, keepdims=True) + PRIOR)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", sent: int = SENT) -> DataFrame:
    """One row per document: ``key``, n_tokens, n_known, base_score, score (log10 probabilities) and perplexity (of a token, by score).

    Null and empty texts are an end alone. Repeated rows and null keys are rows like any other, long texts are scored whole, other columns are
    not read; an empty table gives an empty table. Of the most frequent words at most ``sent`` go to all tasks; what they leave open is joined by shuffle.
    """
    # by steps of an eighth of a doubling, so that no task orders all words
    step = F.floor(8 * F.log2("n")).cast("int")
    least, room = 1 << 30, sent
    for r in sorted(model.words.groupBy(step.alias("step")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    table = model.words.where(step >= least).toArrow()
    h, n, c = table.column("h").to_numpy().view(np.uint64), table.column("n").to_numpy(), table.column("cls").to_numpy()
    order = np.argsort(h)
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((h[order], n[order], c[order].astype(np.uint16)))
    k, end, unknown = model.k, model.k, model.k + 1
    open_ = len(h) < model.n_words  # words that the table leaves out
    light = Model(None, model.n_words, model.ends, model.tokens, k, model.step, model.sizes)

    def look(part: pa.LargeStringArray | np.ndarray):
        """Hash, class, count of each token of texts, and whether it is in the table; and the offsets. Of hashes the middle three."""
        hashes, n_, cls_ = known.value
        x, offsets = (part, None) if isinstance(part, np.ndarray) else hashed_words(part)
        distinct, back = np.unique(x, return_inverse=True)
        at = np.minimum(np.searchsorted(hashes, distinct), max(0, len(hashes) - 1))
        hit = hashes[at] == distinct if len(hashes) else np.zeros(len(distinct), bool)
        cls = np.where(hit, cls_[at], unknown) if len(hashes) else np.full(len(distinct), unknown)
        num = np.where(hit, n_[at], 0) if len(hashes) else np.zeros(len(distinct), np.int64)
        is_end = distinct == END
        cls, num, hit = np.where(is_end, end, cls), np.where(is_end, light.ends, num), hit | is_end
        found = cls[back].astype(np.int64), num[back], hit[back]
        return found if offsets is None else (x, *found, offsets)

    def sums(batches):
        for batch in batches:
            for rows, part in textkit.slices(batch):
                _, cls, num, hit, offsets = look(part)
                before = _before(cls, offsets, end)
                whole = hit & _before(hit, offsets, True) if open_ else np.ones(len(cls), bool)
                terms = np.where(whole, np.log10(light.probability(before, cls, num)), 0.0)
                base = np.where(hit | (not open_), np.log10(light.base(num)), 0.0)
                total = lambda x, offsets=offsets: np.add.reduceat(x, offsets[:-1]) if len(x) else x
                arrays = [pa.array(np.diff(offsets), pa.int64()), pa.array(textkit.between(num > 0, offsets), pa.int64()), pa.array(total(base)), pa.array(total(terms))]
                yield pa.RecordBatch.from_arrays([rows.column("uid"), rows.column("key"), *arrays], ["uid", "key", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(sums, f"uid long, key {kind}, n_tokens long, n_known long, base_score double, score double")
    if open_:
        left = _left_open(rows, model.words.where(step < least), look, light)
        out = out.join(left, F.col("uid") == F.col("r_uid"), "left")
        both = lambda c: (F.col(c) + F.coalesce(f"r_{c}", F.lit(0))).alias(c)
        out = out.select("uid", "key", "n_tokens", both("n_known"), both("base_score"), both("score"))
    return out.select(F.col("key").alias(key), "n_tokens", "n_known", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def _left_open(rows: DataFrame, words: DataFrame, look: Callable, light: Model) -> DataFrame:
    """Sums by uid over the tokens that the table does not know, and over those after such ones; ``words`` has the others that there are.

    Equal terms of a document come as one row, which names the open word and the one beside it: that one is looked up again at the end, and
    joined too only where both are open. The open words are rare where they were learnt, so no key is a large part of all rows.
    """
    k = light.k
    unknown = k + 1
    schema = "r_uid long, key long, beside long, side int, times int"

    def terms(batches):
        for batch in batches:
            for part, texts in textkit.slices(batch):
                x, _, _, hit, offsets = look(texts)
                h = x.view(np.int64)
                old, before = _before(hit, offsets, True), _before(h, offsets, END.view(np.int64))
                at = np.flatnonzero(~hit | ~old)
                owner = np.searchsorted(offsets, at, side="right") - 1
                side = np.where(hit[at], 1, np.where(old[at], 0, 2))  # open: the word, the one before, both
                key, beside = np.where(side == 1, before[at], h[at]), np.where(side == 1, h[at], before[at])
                order = np.lexsort((beside, key, side, owner))
                owner, side, key, beside = owner[order], side[order], key[order], beside[order]
                new = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]) | (beside[1:] != beside[:-1]) | (side[1:] != side[:-1]) | (owner[1:] != owner[:-1])]))
                times = np.diff(np.append(new, len(key)))
                arrays = [pa.array(part.column("uid").to_numpy()[owner[new]]), pa.array(key[new]), pa.array(beside[new]), pa.array(side[new], pa.int32()), pa.array(times, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["r_uid", "key", "beside", "side", "times"])

    listed = lambda of, n, cls: words.select(F.col("h").alias(of), F.col("n").alias(n), F.col("cls").alias(cls))
    found = stored(rows.mapInArrow(terms, schema).join(listed("key", "n", "cls"), "key", "left"), "open words")
    both = found.where(F.col("side") == 2).join(listed("beside", "b_n", "b_cls"), "beside", "left")
    found = found.where(F.col("side") < 2).withColumns({"b_n": F.lit(None).cast("long"), "b_cls": F.lit(None).cast("int")}).unionByName(both)

    def add(batches):
        for batch in batches:
            uid, beside, side, times = (batch.column(c).to_numpy() for c in ("r_uid", "beside", "side", "times"))
            filled = lambda c, value, batch=batch: pc.fill_null(batch.column(c), value).to_numpy().astype(np.int64)
            n, cls = filled("n", 0), filled("cls", unknown)
            c2, n2, hit = look(beside.view(np.uint64))
            c2, n2 = np.where(hit, c2, filled("b_cls", unknown)), np.where(hit, n2, filled("b_n", 0))
            # side 1: the open word stands before, and the other one is scored
            before, word, seen = np.where(side == 1, cls, c2), np.where(side == 1, c2, cls), np.where(side == 1, n2, n)
            s, base = times * np.log10(light.probability(before, word, seen)), np.where(side == 1, 0.0, times * np.log10(light.base(seen)))
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(times * ((side != 1) & (seen > 0)), pa.int64()), pa.array(base), pa.array(s)], ["r_uid", "r_n_known", "r_base_score", "r_score"])

    sums = found.select("r_uid", "beside", "side", "times", "n", "cls", "b_n", "b_cls").mapInArrow(add, "r_uid long, r_n_known long, r_base_score double, r_score double")
    return sums.groupBy("r_uid").agg(*(F.sum(c).alias(c) for c in ("r_n_known", "r_base_score", "r_score")))


def learnt_from(key: Column) -> Column:
    """Whether crc32 of the id as text does not leave 1 modulo 5; rows without an id are not learnt from."""
    return key.isNotNull() & (F.crc32(key.cast("string").cast("binary")) % 5 != 1)
