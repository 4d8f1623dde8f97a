"""Token alignment against a slow one by the tokenizers themselves."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from cases import PROSE, SCHEMA, no_documents, odd_documents

from lexispark.llm import alignment, queries

ODD = [
    " lead  two   three ", "tail \n", "\n \n x \n", "a\tb \t c", "don't it's 1234567 12,5", "　wide　 space  nbsp", "▁ piece mark", "nul\x00 \x1c x\x85 y", "<|endoftext|> <s> </s> <unk> <0x41>", " ", "  ", "\n",
    "é ﬁ ﬂ ᄒᆞ 한국어 中文 \U0001f600\U0001f468‍\U0001f469", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "=" * 700 + " " * 300 + "x", PROSE, PROSE * 400, "▁", "x▁y z",
]


@pytest.fixture(scope="module")
def slow():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    letter = alignment._unicode_bytes()

    def tokens(text):
        if not text:
            return [], []
        x = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = f" {text}".encode()
        return (x, y) if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else ([], [])

    def groups(text):
        x, y = tokens(text)
        out, i, j = [], 0, 0
        while i < len(x):
            a_, b_, m, n = [x[i][0]], [y[j][0]], len(x[i][1]), len(y[j][1])
            i, j = i + 1, j + 1
            while m != n:
                if m < n:
                    a_.append(x[i][0])
                    m, i = m + len(x[i][1]), i + 1
                else:
                    b_.append(y[j][0])
                    n, j = n + len(y[j][1]), j + 1
            out.append((m, a_, b_))
        return out

    return groups


def _expected(rows, groups):
    found = [(k, groups(t)) for k, t in rows]
    links = [Counter((a, b) for _, x, y in g for a in x for b in y) for _, g in found]
    docs = Counter(p for c in links for p in c)
    best = {}
    for (a, _), n in docs.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (k, g), c in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for _, x, y in g)
        sha = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out.append((k, sum(len(x) for _, x, _ in g), sum(len(y) for _, _, y in g), len(g), sum(c.values()), sum(n for (a, b), n in c.items() if docs[a, b] == best[a]), sum(n * docs[p] for p, n in c.items()), sha))
    return sorted(out, key=str)


def _rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def _documents(spark):
    more = spark.createDataFrame([(100 + k, t, None, None, None) for k, t in enumerate(ODD)], SCHEMA)
    return odd_documents(spark, extra=True).unionByName(more, allowMissingColumns=True)


@pytest.mark.parametrize("most", [1 << 21, 40, 1])
def test_equals_the_slow_alignment(spark, slow, most):
    docs = _documents(spark)
    links = alignment.linked(docs)
    got = _rows(alignment.with_counts(links, alignment.pair_counts(links), most))
    assert got == _expected([tuple(r) for r in docs.select("doc_id", "text").collect()], slow)


def test_groups_are_the_slow_ones(spark, slow):
    for r in alignment.align(_documents(spark).where("doc_id >= 100")).collect():
        want = slow(ODD[r.doc_id - 100])
        assert list(r.a_ids) == [i for _, x, _ in want for i in x] and list(r.b_ids) == [i for _, _, y in want for i in y]
        ends = [sum(n for n, _, _ in want[: k + 1]) for k in range(len(want))]
        assert [tuple(g) for g in r.groups] == [(e, len(x), len(y)) for e, (_, x, y) in zip(ends, want, strict=True)]


def test_wide_groups_count_by_distinct_ids(spark, slow, monkeypatch):
    known = alignment.Pieces(alignment.Tokenizers.of(*alignment._files(alignment.BYTE_BPE, alignment.PIECE_BPE)))
    monkeypatch.setattr(alignment, "WIDE", 1)
    found, cuts = known.of_texts(ODD)
    owner, pair, times = known.links(found, cuts)
    for k, text in enumerate(ODD):
        want = Counter((a << alignment.B_BITS) | b for _, x, y in slow(text) for a in x for b in y)
        assert dict(zip(pair[owner == k].tolist(), times[owner == k].tolist(), strict=True)) == want


def test_forgetting_changes_nothing(spark):
    files = alignment._files(alignment.BYTE_BPE, alignment.PIECE_BPE)
    known = alignment.Pieces(alignment.Tokenizers.of(*files))
    first = known.column("a", "a", *known.of_texts(ODD))[0]
    known.forget()
    known.of_texts(ODD[5:])
    assert known.column("a", "a", *known.of_texts(ODD))[0].tolist() == first.tolist()


def test_query_on_the_tables(spark, slow):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert _rows(queries.op11_token_alignment(spark, sf)) == _expected(rows, slow)


def test_empty_table(spark):
    links = alignment.linked(no_documents(spark))
    assert alignment.with_counts(links, alignment.pair_counts(links)).count() == 0
    assert alignment.align(no_documents(spark)).count() == 0
