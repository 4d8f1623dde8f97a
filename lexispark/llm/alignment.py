"""Alignment of two tokenizers' tokens of the same text, and how often their ids go together.

A text (with one space before it) is a string of bytes; each byte gets a label: none, an end of an A token, an end of a B token, or both.
A regular expression cuts the labels into spans up to each *both*; a span's label counts say how many A and B tokens form a group.

Neither tokenizer joins a character other than white space with a space after it, so a text is cut at such places and each distinct
*piece* is tokenised and aligned once; a text's tokens and groups are those of its pieces in order. Where the bytes of a piece's tokens
are not the piece's, the text is done whole.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from ._base import stored

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: How the byte-level tokenizer splits a text before its merges (a fixed value of it).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces end where a space follows another sign than white space.
PIECE = re.compile(r"\s*\S+(?:(?! )\s+\S*)*|\s+")
SPANS = re.compile(rb"[.AB]*X")
#: Pieces that a worker remembers; it starts anew beyond.
REMEMBERED = 1 << 17
#: Pairs of ids whose counts are sent to all tasks, the most frequent ones (16 bytes each); the others are joined by shuffle.
BROADCAST_PAIRS = 1 << 21
#: Products of group sizes beyond which a group's links are counted by distinct ids.
WIDE = 4096
B_BITS = 20


def _unicode_bytes() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Tokenizers:
    """Both encoders, the bytes of each id, and the ids' digits as they stand in a digest."""

    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    space: int

    @staticmethod
    @lru_cache(maxsize=1)
    def of(byte_bpe: bytes, piece_bpe: bytes) -> Tokenizers:
        import sentencepiece
        import tiktoken

        given = json.loads(byte_bpe)["model"]
        letter = _unicode_bytes()
        special = {t["content"] for t in json.loads(byte_bpe)["added_tokens"]}
        ranks = {bytes(letter[c] for c in t): k for t, k in given["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in given["merges"]]
        if any(given["vocab"]["".join(m)] != 256 + k for k, m in enumerate(merges)):
            raise ValueError("the byte-level vocabulary is not in the order of its merges")
        a = tiktoken.Encoding("given", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        a_bytes = [b""] * (max(ranks.values()) + 1)
        for t, k in ranks.items():
            a_bytes[k] = t
        b_bytes = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in range(b.get_piece_size())]
        if len(b_bytes) > 1 << B_BITS:
            raise ValueError(f"more than {1 << B_BITS} pieces")
        return Tokenizers(a, b, a_bytes, b_bytes, b.piece_to_id("▁"))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places starts[k], starts[k] + 1, ..., counts[k] of them, for each k."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)])


class Pieces:
    """What is known of the pieces met so far, by their numbers."""

    def __init__(self, tokenizers: Tokenizers) -> None:
        self.t = tokenizers
        self.lengths = [np.array([len(x) for x in v], dtype=np.int64) for v in (tokenizers.a_bytes, tokenizers.b_bytes)]
        n = max(map(len, self.lengths))
        self.digits = [[f"{k}{sep}".encode() for k in range(n)] for sep in ",|;"]
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flawed: set[int] = set()
        self.digest: list[bytes] = []
        # flat columns and where each piece begins in them: token ids, groups (bytes, A tokens, B tokens), links (pair, times)
        self.flat = {c: np.zeros(0, np.int64) for c in ("a", "b", "bytes", "n_a", "n_b", "pair", "times")}
        self.at = {c: np.zeros(1, np.int64) for c in ("a", "b", "group", "link")}

    def numbers(self, pieces: list[str]) -> list[int]:
        """Numbers of pieces; new ones are tokenised and aligned."""
        index, known = self.index, len(self.index)
        out = [index.setdefault(p, len(index)) for p in pieces]
        if len(index) > known:
            self._learn(list(itertools.islice(reversed(index), len(index) - known))[::-1])
        return out

    def _learn(self, new: list[str]) -> None:
        t = self.t
        ids = [[t.a.encode_ordinary(p) for p in new], [x if len(p) > 1 else [t.space] for p, x in zip(new, t.b.encode([p[1:] for p in new], num_threads=1), strict=True)]]
        raw = [p.encode() for p in new]
        good = [b"".join([t.a_bytes[i] for i in a]) == r == b"".join([t.b_bytes[i] for i in b]) for a, b, r in zip(*ids, raw, strict=True)]
        for k in [k for k, ok in enumerate(good) if not ok]:
            self.flawed.add(len(self.digest) + k)
            ids[0][k], ids[1][k], raw[k] = [], [], b""
        size = np.array([len(r) for r in raw], dtype=np.int64)
        counts = [np.array([len(x) for x in v], dtype=np.int64) for v in ids]
        flat = [np.fromiter(itertools.chain.from_iterable(v), np.int64, int(c.sum())) for v, c in zip(ids, counts, strict=True)]
        ends = [np.cumsum(n[f]) for n, f in zip(self.lengths, flat, strict=True)]

        labels = np.full(int(size.sum()), ord("."), np.uint8)
        labels[ends[0] - 1] = ord("A")
        both = labels[ends[1] - 1] == ord("A")
        labels[ends[1] - 1] = np.where(both, ord("X"), ord("B"))
        spans = np.fromiter(map(len, SPANS.findall(labels.tobytes())), np.int64)
        stops = np.cumsum(spans)
        here = [np.diff(np.concatenate([[0], np.cumsum((labels == ord(x)) | (labels == ord("X")))[stops - 1]])) if len(stops) else np.zeros(0, np.int64) for x in "AB"]
        groups = np.diff(np.searchsorted(stops, np.concatenate([[0], np.cumsum(size)]), side="right"))

        # the digest: A ids of a group, then its B ids, each with the sign that follows
        of = [np.repeat(np.arange(len(spans)), n) for n in here]
        before = [np.concatenate([[0], np.cumsum(n)]) for n in here]
        text: list[bytes] = [b""] * (len(flat[0]) + len(flat[1]))
        for k, sep, place in ((0, 1, np.arange(len(flat[0])) + before[1][of[0]]), (1, 2, np.arange(len(flat[1])) + before[0][of[1] + 1])):
            last = np.zeros(len(flat[k]), dtype=bool)
            last[before[k][1:] - 1] = True
            for i, at, end in zip(flat[k].tolist(), place.tolist(), last.tolist(), strict=True):
                text[at] = self.digits[sep if end else 0][i]
        cuts = _offsets(counts[0] + counts[1]).tolist()
        self.digest += [b"".join(text[i:j]) for i, j in itertools.pairwise(cuts)]

        self._links(flat, here, np.repeat(np.arange(len(new)), groups), len(new))
        for c, v in (("a", flat[0]), ("b", flat[1]), ("bytes", spans), ("n_a", here[0]), ("n_b", here[1])):
            self.flat[c] = np.concatenate([self.flat[c], v])
        for c, n in (("a", counts[0]), ("b", counts[1]), ("group", groups)):
            self.at[c] = np.concatenate([self.at[c], self.at[c][-1] + np.cumsum(n)])

    def _links(self, flat: list[np.ndarray], here: list[np.ndarray], piece: np.ndarray, n: int) -> None:
        """Distinct pairs of each new piece with their occurrences."""
        begin = [np.cumsum(x) - x for x in here]
        product = here[0] * here[1]
        slim = np.flatnonzero(product <= WIDE)
        count = product[slim]
        k = np.repeat(np.arange(len(slim)), count)
        within = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
        width = here[1][slim][k]
        a, b = flat[0][begin[0][slim][k] + within // width], flat[1][begin[1][slim][k] + within % width]
        owner, pair, times = [piece[slim][k]], [a << B_BITS | b], [np.ones(len(k), np.int64)]
        for g in np.flatnonzero(product > WIDE).tolist():
            (ua, na), (ub, nb) = (np.unique(f[s[g] : s[g] + h[g]], return_counts=True) for f, s, h in zip(flat, begin, here, strict=True))
            pair.append((ua[:, None] << B_BITS | ub[None, :]).ravel())
            times.append((na[:, None] * nb[None, :]).ravel())
            owner.append(np.full(len(pair[-1]), piece[g]))
        owner, pair, times = (np.concatenate(x) for x in (owner, pair, times))
        order = np.lexsort((pair, owner))
        owner, pair, times = owner[order], pair[order], times[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(pair)), bool), (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])]))
        self.flat["pair"] = np.concatenate([self.flat["pair"], pair[first]])
        self.flat["times"] = np.concatenate([self.flat["times"], np.add.reduceat(times, first) if len(first) else times])
        self.at["link"] = np.concatenate([self.at["link"], self.at["link"][-1] + np.cumsum(np.bincount(owner[first], minlength=n))])

    def of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all texts and the offsets between texts; a text that either tokenizer does not give back has none."""
        if len(self.index) > REMEMBERED:
            self.forget()
        lists = [PIECE.findall(f" {x}") if x else [] for x in texts]
        cuts = _offsets(np.array([len(x) for x in lists], dtype=np.int64))
        found = self.numbers(list(itertools.chain.from_iterable(lists)))
        if self.flawed and not self.flawed.isdisjoint(found):
            for k, (i, j) in enumerate(itertools.pairwise(cuts.tolist())):
                lists[k] = found[i:j]
                if not self.flawed.isdisjoint(lists[k]):
                    lists[k] = [p for p in self.numbers([f" {texts[k]}"]) if p not in self.flawed]
            cuts = _offsets(np.array([len(x) for x in lists], dtype=np.int64))
            found = list(itertools.chain.from_iterable(lists))
        return np.array(found, dtype=np.int64), cuts

    def column(self, name: str, at: str, found: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A flat column over all texts, and the offsets between texts."""
        counts = np.diff(self.at[at])[found]
        return self.flat[name][ragged(self.at[at][:-1][found], counts)], _offsets(counts)[cuts]

    def links(self, found: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, occurrences) of the distinct pairs of each text."""
        n = len(self.digest)
        own, often = np.unique(np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)) * n + found, return_counts=True)
        text, piece = own // max(1, n), own % max(1, n)
        counts = np.diff(self.at["link"])[piece]
        places = ragged(self.at["link"][:-1][piece], counts)
        key, at = np.unique((np.repeat(text, counts) << (2 * B_BITS)) | self.flat["pair"][places], return_inverse=True)
        times = np.bincount(at, self.flat["times"][places] * np.repeat(often, counts), minlength=len(key)).astype(np.int64)
        return key >> (2 * B_BITS), key & ((1 << (2 * B_BITS)) - 1), times


@lru_cache(maxsize=1)
def _pieces(byte_bpe: bytes, piece_bpe: bytes) -> Pieces:
    return Pieces(Tokenizers.of(byte_bpe, piece_bpe))


def _files(byte_bpe: str, piece_bpe: str) -> tuple[bytes, bytes]:
    with open(byte_bpe, "rb") as a, open(piece_bpe, "rb") as b:
        return a.read(), b.read()


def _list(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """One row per document: ``key``, a_ids, b_ids (token ids in order) and groups (end: byte offset after the group in space + text; n_a, n_b: its tokens).

    Null and empty texts, and texts that the tokens of either tokenizer do not give back byte by byte, have empty lists. Repeated rows and
    null keys are rows like any other, long texts are aligned whole, other columns are not read; an empty table gives an empty table.
    The tokenizers' files are read by the driver and sent to the tasks.
    """
    files = _files(byte_bpe, piece_bpe)

    def make(part: pa.RecordBatch, texts: pa.LargeStringArray) -> pa.RecordBatch:
        known = _pieces(*files)
        found, cuts = known.of_texts(texts.to_pylist())
        ids = [_list(*known.column(c, c, found, cuts), pa.int32()) for c in "ab"]
        size, offsets = known.column("bytes", "group", found, cuts)
        total = np.concatenate([[0], np.cumsum(size)])
        ends = total[1:] - np.repeat(total[offsets[:-1]], np.diff(offsets))
        parts = [ends, *(known.column(c, "group", found, cuts)[0] for c in ("n_a", "n_b"))]
        groups = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in parts], ["end", "n_a", "n_b"])
        return pa.RecordBatch.from_arrays([part.column("key"), *ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), groups)], ["key", "a_ids", "b_ids", "groups"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(textkit.per_slice(make), f"key {kind}, a_ids array<int>, b_ids array<int>, groups array<struct<end:int,n_a:int,n_b:int>>")
    return out.withColumnRenamed("key", key)


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """One row per document as of ``align``, with its groups as counts, digest and links.

    Columns: uid (a number of the row), ``key``, n_a, n_b, n_groups, n_links, groups_sha256, pairs (distinct linked ids, A * 2**20 + B)
    and times (occurrences of each). The result is written to the shared folder, as links are read twice.
    """
    files = _files(byte_bpe, piece_bpe)

    def make(part: pa.RecordBatch, texts: pa.LargeStringArray) -> pa.RecordBatch:
        known = _pieces(*files)
        found, cuts = known.of_texts(texts.to_pylist())
        counts = [textkit.between(np.diff(known.at[c])[found], cuts) for c in ("a", "b", "group")]
        digest, pieces, ends = known.digest, found.tolist(), cuts.tolist()
        hashes = [hashlib.sha256(b"".join([digest[p] for p in pieces[i:j]])[:-1]).hexdigest() if i < j else "" for i, j in itertools.pairwise(ends)]
        owner, pair, times = known.links(found, cuts)
        offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
        links = textkit.between(times, offsets)
        arrays = [part.column("uid"), part.column("key"), *(pa.array(c, pa.int64()) for c in (*counts, links)), pa.array(hashes, pa.string()), _list(pair, offsets, pa.int64()), _list(times, offsets, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["uid", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(textkit.per_slice(make), f"uid long, key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")
    return stored(out.withColumnRenamed("key", key), "linked")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, a, b, docs, best): in how many documents each pair of ids is linked, and whether no other pair of the A id is in more."""
    counts = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    counts = stored(counts.select("pair", F.shiftright("pair", B_BITS).alias("a"), F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b"), "docs"), "pairs")
    # one row for each id of the A vocabulary, so this side is small whatever the corpus
    top = counts.groupBy(F.col("a").alias("t_a")).agg(F.max("docs").alias("t_docs"))
    return counts.join(F.broadcast(top), F.col("a") == F.col("t_a")).select("pair", "a", "b", "docs", (F.col("docs") == F.col("t_docs")).alias("best"))


def with_counts(links: DataFrame, counts: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """Append n_best (links whose pair is the best of its A id) and count_sum (documents of the pair, over links) to rows of ``linked``.

    The ``most`` frequent pairs are looked up in a table sent to all tasks. Each other pair is in few documents; those are
    joined by shuffle and added by row.
    """
    spark: SparkSession = links.sparkSession
    table = counts.select("pair", "docs", "best").orderBy(F.desc("docs"), "pair").limit(most).toArrow()
    pair, docs, best = (table.column(c).to_numpy() for c in ("pair", "docs", "best"))
    order = np.argsort(pair)
    sent = spark.sparkContext.broadcast((pair[order], docs[order], best[order]))

    def look(batch: pa.RecordBatch):
        keys, n, top = sent.value
        flat = batch.column("pairs").flatten().to_numpy()
        at = np.minimum(np.searchsorted(keys, flat), max(0, len(keys) - 1))
        return flat, batch.column("times").flatten().to_numpy(), keys[at] == flat, n[at], top[at]

    def total(batches):
        for batch in batches:
            kept = [batch.column(c) for c in columns]
            if sent.value[0].size:
                _, times, known, n, top = look(batch)
                offsets = np.concatenate([[0], np.cumsum(batch.column("pairs").value_lengths().to_numpy())])
                sums = [textkit.between(x, offsets) for x in (times * (known & top), times * n * known)]
            else:
                sums = [np.zeros(len(batch), np.int64)] * 2
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.int64()) for x in sums)], [*columns, "n_best", "count_sum"])

    columns = [c for c in links.columns if c not in ("pairs", "times")]
    out = links.mapInArrow(total, links.select(*columns).schema.add("n_best", "long").add("count_sum", "long"))
    if table.num_rows < most:
        return out

    def others(batches):
        for batch in batches:
            flat, times, known, _, _ = look(batch)
            owner = np.repeat(batch.column("uid").to_numpy(), batch.column("pairs").value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(x[~known]) for x in (owner, flat, times)], ["r_uid", "pair", "r_times"])

    left = links.mapInArrow(others, "r_uid long, pair long, r_times long").join(counts.select("pair", "docs", "best"), "pair")
    left = left.groupBy("r_uid").agg(F.sum(F.when(F.col("best"), F.col("r_times")).otherwise(0)).alias("r_best"), F.sum(F.col("r_times") * F.col("docs")).alias("r_sum"))
    out = out.join(left, F.col("uid") == F.col("r_uid"), "left")
    return out.select(*columns, (F.col("n_best") + F.coalesce("r_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("r_sum", F.lit(0))).alias("count_sum"))
