"""Sentences, bundles and display segments against folds over one row after the other."""

import random
import re

from samples import utterances

from lexispark.operators import explore, merge, segments

END = r"[.!?。？！]+(?:\s*[ㅋㅎㅜㅠ]+)?[\"')\]}”’]*$"
REACTION = r"[.!?。？！ㅋㅎㅜㅠ\s]+"


def slow_sentences(rows):
    """Groups as lists of (id, text, label) with what came late apart."""
    groups, is_open = [], False
    for uid, who, seq, text, label in rows:
        text = text.strip()
        if not text:
            continue
        same = bool(groups) and groups[-1]["who"] == who
        if not same:
            is_open = False
        short = bool(re.fullmatch(REACTION, text))
        if same and (is_open or short):
            g = groups[-1]
            late = not is_open
        else:
            g, late = {"who": who, "from": seq, "text": "", "ids": [], "labels": [], "late": [], "to": seq}, False
            groups.append(g)
        glue = short and g["text"] and re.fullmatch(r"[.!?。？！]+[ㅋㅎㅜㅠ]*", text)
        g["text"] += text if glue or not g["text"] else f" {text}"
        g["ids"].append(uid)
        (g["late"] if late else g["labels"]).append(label)
        g["end"] = seq
        if not late:
            g["to"] = seq
            is_open = not re.search(END, text)
    out = []
    for g in groups:
        labels = [g["labels"][0], g["labels"][-1]]
        label = " - ".join(labels) if all(labels) and labels[0] != labels[1] else labels[0] or labels[1]
        for x in g["late"]:
            label = f"{label} - {x}" if label and x and label != x else label or x
        span = str(g["from"]) if g["from"] == g["to"] else f"{g['from']}-{g['to']}"
        out.append((g["who"], g["from"], g["end"], len(g["ids"]), re.sub(r"\s+", " ", g["text"]), label, f"{g['who']}:{span}:{'|'.join(g['ids'])}"))
    return out


def slow_bundles(groups):
    out, held = [], []
    for who, a, z, n, text, label, name in groups:
        short = len(text) <= 35 or len(text.split()) <= 7
        fits = held and short and held[0][0] == who and sum(h[3] for h in held) + n <= 6 and len(" ".join([*(h[4] for h in held), text])) <= 180
        if held and not fits:
            out.append(held)
            held = []
        held.append((who, a, z, n, text, label, name))
        if not short:
            out.append(held)
            held = []
    return [(h[0][0], h[0][1], h[-1][2], sum(x[3] for x in h), len(h), " ".join(x[4] for x in h)) for h in [*out, *([held] if held else [])]]


def test_against_folds(spark):
    rnd = random.Random(2)
    texts = ["so it goes", "well.", "ㅋㅋ", "!", "?! ㅎㅎ", "...", "", "he said \"no.\"", "한 번 더", "a rather long remark that goes on and on without end or any point at all, as some do!", "ㅠ"]
    rows, want, want_bundles = [], {}, {}
    for d in range(60):
        doc = f"d{d:02}"
        mine = [(doc, rnd.choice("ab"), rnd.choice(texts), rnd.choice([None, "t1", "t2"]), *rnd.choice([(None, None), (1.0, 2.5), (3.0, None)])) for _ in range(rnd.randint(0, 25))]
        start = len(rows)
        rows += mine
        label = lambda r: r[3] or ("" if r[4] is None else f"{r[4]:.2f}s" if r[5] is None else f"{r[4]:.2f}-{r[5]:.2f}s")
        want[doc] = slow_sentences([(f"{doc}.{start + k}", r[1], start + k, r[2], label(r)) for k, r in enumerate(mine, 1)])
        want_bundles[doc] = slow_bundles(want[doc])
    groups = merge.sentences(utterances(spark, rows)).cache()
    got, bundles = {d: [] for d in want}, {d: [] for d in want}
    for r in groups.orderBy("doc_id", "group").collect():
        got[r["doc_id"]].append((r["speaker_id"], r["start_sequence"], r["end_sequence"], r["utterance_count"], r["text"], r["time_label"], r["id"]))
    assert got == want
    for r in merge.bundles(groups).orderBy("doc_id", "bundle").collect():
        bundles[r["doc_id"]].append((r["speaker_id"], r["start_sequence"], r["end_sequence"], r["utterance_count"], r["sentence_count"], r["text"]))
    assert bundles == want_bundles
    assert merge.bundles(groups.limit(0)).count() == 0


def test_speaker_columns(spark):
    rows = utterances(spark, [("d", "a", "one"), ("d", "b", "two"), ("d", "x", "three")])
    got = [(r["a"], r["b"]) for r in explore.speaker_columns(rows, ["a", "b"]).orderBy("sequence").collect()]
    assert got == [("one", None), (None, "two"), ("three", None)]
    assert [r[-1] for r in explore.speaker_columns(rows, []).orderBy("sequence").collect()] == ["one", "two", "three"]


def slow_cut(text):
    """One sign after the other."""
    ends, laughs, out, buffer, i = ".!?。？！", "ㅋㅎㅜㅠ", [], "", 0
    text = text.replace("\r", "")
    at = lambda k: text[k] if 0 <= k < len(text) else ""

    def word(k):
        a = max(text.rfind(c, 0, k + 1) for c in " \n\t") + 1
        z = min([p for p in (text.find(c, k) for c in " \n\t") if p >= 0] or [len(text)])
        return a, z

    while i < len(text):
        c, push = text[i], False
        if c == "\n":
            push = True
        elif c == "/":
            address = "://" in text[word(i)[0] : i] or (at(i - 1) == ":" and at(i + 1) == "/") or (at(i - 1) == "/" and at(i - 2) == ":")
            if address:
                buffer += c
            elif at(i + 1) == "/":
                while at(i + 1) == "/":
                    i += 1
                push = True
            elif at(i - 1) != ":" and not (at(i - 1).isdigit() and at(i + 1).isdigit()):
                push = True
            else:
                buffer += c
        else:
            buffer += c
            a, z = word(i)
            if c in ends and "://" not in text[a:z] and not (c == "." and at(i - 1).isdigit() and at(i + 1).isdigit()):
                while at(i + 1) and at(i + 1) in ends:
                    i += 1
                    buffer += text[i]
                k = i + 1
                while at(k) and at(k) in " \t":
                    k += 1
                if at(k) and at(k) in laughs:
                    buffer += text[i + 1 : k]
                    i = k - 1
                while at(i + 1) and at(i + 1) in laughs:
                    i += 1
                    buffer += text[i]
                push = True
            elif c in laughs:
                while at(i + 1) and at(i + 1) in laughs:
                    i += 1
                    buffer += text[i]
                push = at(i + 1) != "" and at(i + 1) not in "\n/" + ends
        if push:
            out.append(buffer)
            buffer = ""
        i += 1
    out.append(buffer)
    return [x.strip() for x in out if x.strip()] or [text]


def test_segments_random():
    rnd = random.Random(4)
    parts = ["a", "b ", "1", "2", "/", "//", ".", "!", "?", "ㅋ", "ㅠㅠ", "\n", " ", "\t", "http://x", "://", ":", "나", "...", "3.5"]
    for _ in range(6000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert segments.cut(text) == slow_cut(text), repr(text)


def test_illegible(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(segments.illegible(F.lit("가□□나□")).alias("x")).first()["x"]
    assert [(p["part"], p["gap"]) for p in got] == [("가", False), ("□□", True), ("나", False), ("□", True)]
