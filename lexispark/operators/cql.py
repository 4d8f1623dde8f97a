"""Token patterns: a sequence of ``[]``, ``[text="v"]``, ``[lemma~"r"]``, ``[pos="v"]``, each with an optional ``{n}`` or ``{n,m}``.

A pattern is parsed on the driver and compiled to one column expression, so matching is row by row inside the scan's stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized
from .patterns import compiled


@dataclass(frozen=True)
class Element:
    least: int
    most: int
    field: str | None = None
    op: str | None = None
    value: str | None = None

    def fits(self, token: Column, tagged: bool = True) -> Column:
        """Whether a token meets the condition; missing lemmas and tags, as of all raw tokens, are read as blank."""
        if self.field is None:
            return F.lit(True)
        held = token["normalized"] if self.field == "text" else F.coalesce(token[self.field], F.lit("")) if tagged else F.lit("")
        if self.op == "~":
            return held.rlike(java_regex(self.value))
        return held == (normalized(F.lit(self.value)) if self.field == "text" else F.lit(self.value))


def java_regex(pattern: str) -> str:
    """A search pattern in Java's spelling; raises ValueError if it is not valid."""
    from pyspark.sql import SparkSession

    out = compiled(pattern)[0]
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(out)
        except Exception as e:
            raise ValueError(f"not a regular expression: {pattern}") from e
    return out


class _Reader:
    """A pattern's signs from left to right."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def next(self) -> str:
        return self.text[self.at : self.at + 1]

    def skip_blank(self) -> None:
        while self.next().isspace():
            self.at += 1

    def fail(self, what: str):
        raise ValueError(f"not a token pattern: {what} at {self.at + 1} of {self.text!r}")

    def take(self, sign: str) -> None:
        if self.next() != sign:
            self.fail(f"no {sign}")
        self.at += 1

    def number(self) -> int:
        start = self.at
        while self.next() in tuple("0123456789"):
            self.at += 1
        return int(self.text[start : self.at]) if self.at > start else self.fail("no number")

    def word(self, options: tuple[str, ...]) -> str:
        for option in options:
            if self.text.startswith(option, self.at):
                self.at += len(option)
                return option
        return self.fail(f"none of {', '.join(options)}")

    def quoted(self, end: int) -> str:
        """The value between quotes; a backslash before a quote makes it a part of the value."""
        self.take('"')
        out = ""
        while self.at < end and self.next() != '"':
            if self.text.startswith('\\"', self.at):
                self.at += 1
            out += self.next()
            self.at += 1
        self.take('"')
        return out

    def counts(self) -> tuple[int, int]:
        if self.next() != "{":
            return 1, 1
        self.at += 1
        least = most = self.number()
        if self.next() == ",":
            self.at += 1
            most = self.number()
        self.take("}")
        return (least, most) if least <= most else self.fail("the second number is smaller")

    def element(self) -> Element:
        self.take("[")
        end = self.text.find("]", self.at)  # no value can hold one
        if end < 0:
            self.fail("no ]")
        self.skip_blank()
        field = op = value = None
        if self.at < end:
            field = self.word(("text", "lemma", "pos"))
            self.skip_blank()
            op = self.word(("=", "~"))
            self.skip_blank()
            value = self.quoted(end)
            self.skip_blank()
        if self.at != end:
            self.fail("no ]")
        self.at = end + 1
        return Element(*self.counts(), field, op, value)


def parse(query: str) -> list[Element]:
    """The elements of a pattern; raises ValueError if it is none."""
    reader, found = _Reader(query), []
    reader.skip_blank()
    while reader.next():
        found.append(reader.element())
        reader.skip_blank()
    return found or reader.fail("no element")


def layer_of(elements: list[Element], source: str | None) -> str:
    """The token layer that a pattern needs: what was asked for, else the provided one for lemma or tag conditions."""
    if source:
        return "provided" if source == "provided" else "tokens"
    return "provided" if any(e.field in ("lemma", "pos") for e in elements) else "tokens"


def _extended(state: Column, element: Element, tokens: Column, n: Column, tagged: bool) -> Column:
    """All ways to lengthen the partial matches ``state`` by one element."""
    to = lambda m, c: F.struct(m["s"].alias("s"), (m["e"] + c).alias("e"))
    if (element.least, element.most) == (1, 1):
        here = F.filter(state, lambda m: (m["e"] < n) & element.fits(F.get(tokens, m["e"]), tagged))
        return F.transform(here, lambda m: to(m, 1))
    counts = F.sequence(F.lit(element.least), F.lit(element.most))

    def longer(m: Column) -> Column:
        if element.field is None:
            fits = F.filter(counts, lambda c: m["e"] + c <= n)
        else:
            fits = F.filter(counts, lambda c: (m["e"] + c <= n) & F.forall(F.slice(tokens, m["e"] + 1, c), lambda t: element.fits(t, tagged)))
        return F.transform(fits, lambda c: to(m, c))

    return F.flatten(F.transform(state, longer))


def matches(elements: list[Element], tokens: Column, tagged: bool) -> Column:
    """All ways to match, as ``array<struct<s, e>>``: by start, then by the elements' counts; overlaps and repeats stay."""
    n = F.size(tokens)
    starts = F.slice(F.sequence(F.lit(0), n), F.lit(1), n)
    if (elements[0].least, elements[0].most) == (1, 1):  # only where the first element fits
        starts = F.filter(starts, lambda i: elements[0].fits(F.get(tokens, i), tagged))
        state, elements = F.transform(starts, lambda i: F.struct(i.alias("s"), (i + 1).alias("e"))), elements[1:]
    else:
        state = F.transform(starts, lambda i: F.struct(i.alias("s"), i.alias("e")))
    for element in elements:
        state = _extended(state, element, tokens, n, tagged)
    return state


def required(elements: list[Element], layer: str, tagged: bool) -> list[tuple[str, str, Column]]:
    """The exact terms that every match holds, as (kind of term, field of the layer, term)."""
    out = []
    for e in elements:
        if e.least > 0 and e.op == "=" and e.value and (e.field == "text" or tagged):
            text = e.field == "text"
            kind = ("provided" if layer == "provided" else "raw") if text else e.field
            out.append((kind, "normalized" if text else e.field, normalized(F.lit(e.value)) if text else F.lit(e.value)))
    return out


def anchors(elements: list[Element], layer: str, tagged: bool) -> Column:
    """A necessary condition that is cheap: each exact element that must occur has a token."""
    out = F.lit(True)
    for _, field, term in required(elements, layer, tagged):
        out = out & F.array_contains(f"{layer}.{field}", term)
    return out


def gap_of(elements: list[Element], tagged: bool) -> tuple[int, int] | None:
    """For a pattern of two exact tokens with any tokens between them: how many at least and at most."""
    ends = [elements[0], elements[-1]]
    if len(elements) not in (2, 3) or any((e.least, e.most, e.op) != (1, 1, "=") or not e.value or not (e.field == "text" or tagged) for e in ends):
        return None
    if len(elements) == 2:
        return 0, 0
    return (elements[1].least, elements[1].most) if elements[1].field is None else None


def search(utterances: DataFrame, query: str, source: str | None = None) -> DataFrame:
    """One row per match: all columns of ``utterances`` with ``ordinal`` (of the match in its utterance), ``s`` and ``e`` (token positions)."""
    elements = parse(query)
    layer = layer_of(elements, source)
    tagged = layer == "provided"
    found = utterances.where(anchors(elements, layer, tagged)).withColumn("_m", matches(elements, F.col(layer), tagged))
    # outer, as Spark would otherwise filter by the size of the array first, and compute it twice for that
    found = found.select(*utterances.columns, F.posexplode_outer("_m").alias("ordinal", "_x")).where(F.col("_x").isNotNull())
    return found.select(*utterances.columns, "ordinal", "_x.s", "_x.e")
