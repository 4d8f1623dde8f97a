"""Display segments: a text cut at line ends, slashes and sentence ends."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that end a sentence; the first one may also stand in a number.
ENDS = ".!?。？！"
LAUGHS = "ㅋㅎㅜㅠ"
#: A web address with the word around it.
_ADDRESS = re.compile(r"[^ \n\t]*?(://)[^ \n\t]*")
#: Where a text may be cut: line ends, slashes that are no part of a fraction or of ``:/``, sentence ends, and laughter before more text.
_BREAK = re.compile(rf"\n|//+|(?<!:)(?:(?<![0-9])/|/(?![0-9]))|(?:(?<![0-9])\.|\.(?![0-9])|[{ENDS[1:]}])[{ENDS}]*(?:[ \t]*[{LAUGHS}]+)?|[{LAUGHS}]+(?=[^\r\n/{ENDS}{LAUGHS}])")


def cut(text: str) -> list[str]:
    """The segments of a text; a text without any is one segment. Points never cut a word with an address, slashes not from its ``://`` on."""
    text = (text or "").replace("\r", "")
    words = [(m.start(), m.start(1), m.end()) for m in _ADDRESS.finditer(text)]
    found, start, at, k = [], 0, 0, 0
    while m := _BREAK.search(text, at):
        sign = m[0][0]
        while k < len(words) and words[k][2] <= m.start():
            k += 1
        inside = k < len(words) and words[k][0] <= m.start()
        if inside and (sign in ENDS or (sign == "/" and m.start() >= words[k][1])):
            at = m.start() + 1
            continue
        found.append(text[start : m.start() if sign in "\n/" else m.end()])
        start = at = m.end()
    found.append(text[start:])
    return [x.strip() for x in found if x.strip()] or [text]


def _cut_batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(cut)


def display_segments(text: Column) -> Column:
    return F.pandas_udf(_cut_batches, "array<string>")(text)


def illegible(text: Column) -> Column:
    """Runs of the sign for what could not be read in a source, apart from the text between them: ``array<struct<part, gap>>``."""
    parts = F.regexp_extract_all(text, F.lit("\u25a1+|[^\u25a1]+"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(p.alias("part"), p.startswith("\u25a1").alias("gap")))
