"""Keyword-in-context search: by token, by substring, by regular expression, by token pattern."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded_like, normalized
from ..scratch import filesystem, new_folder, remove
from . import cql, lookup, patterns
from .filters import Filters
from .lookup import Index

ORDER = ("corpus_id", "row_id", "ordinal")
RESULT = ("corpus_id", "doc_id", "utterance_id", "speaker_id", "sequence", "form", "original_form", "topic", "category", "year", "time", "start", "end", "note", "speaker_age", "speaker_sex", "speaker_occupation")
#: The columns of an exported file, and where they come from.
CSV = {
    "corpusName": "corpus_name", "corpusId": "corpus_id", "docId": "doc_id", "utteranceId": "utterance_id", "speakerId": "speaker_id", "sequence": "sequence", "year": "year", "category": "category", "topic": "topic",
    "time": "time", "start": "start", "end": "end", "speakerSex": "speaker_sex", "speakerAge": "speaker_age", "speakerOccupation": "speaker_occupation", "kwicLeft": "left", "kwicHit": "hit", "kwicRight": "right",
    "form": "form", "originalForm": "original_form", "note": "note",
}


@dataclass(frozen=True)
class Request:
    query: str
    mode: str = "text"  # text, regex or cql
    field: str = "form"  # form or original_form
    context: int = 7
    limit: int = 100
    offset: int = 0
    filters: Filters = Filters()
    #: The cursor of the page before; with it the search starts behind that page, and ``offset`` counts from there.
    after: str | None = None


@dataclass
class Page:
    """One page of results, whether there are more, warnings, and the cursor that the next page starts from."""

    rows: DataFrame | None
    has_more: bool = False
    warnings: list[str] = field(default_factory=list)
    cursor: str | None = None


def cursor_of(row) -> str:
    """A result's place in the order of all results, as an opaque text."""
    return base64.urlsafe_b64encode(json.dumps([row[c] for c in ORDER]).encode()).decode()


def behind(cursor: str) -> Column:
    """Whether a result comes after a cursor; ranges of corpus and row ids, which the scan can use. Raises ValueError if it is none."""
    try:
        corpus, row, nth = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        row, nth = int(row), int(nth)
    except (ValueError, TypeError) as e:
        raise ValueError(f"not a cursor: {cursor!r}") from e
    same = F.col("corpus_id") == corpus
    return (F.col("corpus_id") > corpus) | (same & (F.col("row_id") > row)) | (same & (F.col("row_id") == row) & (F.col("ordinal") > nth))


@dataclass
class Hits:
    """All rows that a request finds, in no order, and how their contexts are cut; that is done for the rows of a page only."""

    rows: DataFrame
    layer: str
    #: Whether a token is the one that is shown; None where the rows have the span (s, e) already.
    shown: object
    context: int
    #: The keys of all rows, where the index has them: ORDER, and the span if the rows have it.
    keys: DataFrame | None = None

    def in_context(self, rows: DataFrame) -> DataFrame:
        """Append left, hit and right (arrays of surfaces); without a token to show the whole form is the hit."""
        tokens = F.col(self.layer)
        if self.shown is not None:
            at = F.array_position(F.transform(tokens, lambda t: F.coalesce(self.shown(t), F.lit(False))), True).cast("int")
            rows = rows.withColumn("_at", at)
            rows = rows.withColumns({"s": F.when(F.col("_at") > 0, F.col("_at") - 1).otherwise(0), "e": F.when(F.col("_at") > 0, F.col("_at")).otherwise(F.greatest(F.size(tokens), F.lit(1)))})
        return kwic(rows, tokens, F.col("s"), F.col("e"), self.context)


def kwic(rows: DataFrame, tokens: Column, s: Column, e: Column, context: int) -> DataFrame:
    words = F.transform(tokens, lambda t: t["surface"])
    real = (F.size(tokens) > 0) & (s < e)
    none = F.array().cast("array<string>")
    left = F.slice(words, F.greatest(s - context, F.lit(0)) + 1, F.least(s, F.lit(context)))
    whole = F.array(F.when(F.col("form") != "", F.col("form")).otherwise(F.col("original_form")))
    return rows.withColumns(
        {"left": F.when(real, left).otherwise(none), "hit": F.when(real, F.slice(words, s + 1, e - s)).otherwise(whole), "right": F.when(real, F.slice(words, e + 1, F.lit(context))).otherwise(none)}
    )


def term_exists(token_stats: DataFrame, word: Column) -> bool:
    """Whether any token, lemma or tag of any corpus equals the term: one look at the counted terms."""
    return bool(token_stats.where(F.col("term") == word).limit(1).count())


def matched(utterances: DataFrame, token_stats: DataFrame, request: Request, index: Index | None = None) -> tuple[Hits | None, list[str]]:
    """What a request finds, not paged, with ``ordinal`` (of a match in its utterance), and warnings. None: nothing was searched.

    With an index only those utterances are looked at that it cannot rule out, and the keys of whole tokens and pairs of tokens are found
    by their places alone; the result is the same. Utterances are scanned and never joined by shuffle.
    """
    query, f = request.query.strip(), request.filters
    if not query:
        return None, ["the query is blank"]
    rows = f.apply(utterances)
    one = lambda found, shown, keys=None: Hits(found.withColumn("ordinal", F.lit(0)), f.layer, shown, request.context, keys)
    if request.mode == "cql":
        try:
            elements = cql.parse(query)
        except ValueError as e:
            return None, [str(e)]
        layer = cql.layer_of(elements, None if f.source == "raw" and any(x.field in ("lemma", "pos") for x in elements) else f.source)
        return _by_tokens(rows, query, elements, layer, request, index), []
    if request.mode == "regex":
        try:
            pattern = cql.java_regex(query)
        except ValueError as e:
            return None, [str(e)]
        if index:
            rows = lookup.near(rows, index, patterns.compiled(query)[1], f)
        return one(rows.where(F.col(request.field).rlike(pattern)), lambda t: t["surface"].rlike(pattern) | t["normalized"].rlike(pattern)), []
    word = normalized(F.lit(query))
    holds = lambda t: t["normalized"].contains(word)
    if term_exists(token_stats, word):
        found = lambda rows: rows.where(F.array_contains(f"{f.layer}.normalized", word))
        if not index:
            return one(found(rows), holds), []
        keys = lookup.rows_with(index, f.kind, word, f)
        if f.only_corpus:
            return one(found(rows), holds, keys.withColumn("ordinal", F.lit(0))), []
        return one(found(lookup.only(rows, keys, lookup.count(index, f.kind, word, f))), holds), []
    if len(query) < 3:
        return None, ["the query is shorter than three characters and no token"]
    if index:
        rows = lookup.near(rows, index, patterns.like_need(query), f)
    return one(rows.where(folded_like(F.col(request.field), query)), holds), []


def _by_tokens(rows: DataFrame, query: str, elements: list[cql.Element], layer: str, request: Request, index: Index | None) -> Hits:
    """The matches of a token pattern."""
    tagged, f, source = layer == "provided", request.filters, layer if layer == "provided" else "raw"
    if index:
        if f.only_corpus and (found := lookup.pairs(index, elements, layer, tagged, f)) is not None:
            return Hits(cql.search(rows, query, source), layer, None, request.context, found)
        driven = lookup.by_terms(index, [(kind, term) for kind, _, term in cql.required(elements, layer, tagged)], f)
        if driven is not None:
            rows = lookup.only(rows, *driven)
    return Hits(cql.search(rows, query, source), layer, None, request.context)


#: Rows of a page up to which its keys come to the driver, some 50 bytes each.
KEYED_ROWS = 20_000


def page(utterances: DataFrame, token_stats: DataFrame, request: Request, index: Index | None = None) -> tuple[Hits | None, DataFrame | None, list[str]]:
    """The rows of a request's page and one more, in order, with contexts that are cut after the page was chosen.

    The page is chosen by keys alone, so the scan reads just what the request looks at; the rows themselves are then read by their
    ids, which lie close together in the files.
    """
    hits, warnings = matched(utterances, token_stats, request, index)
    if hits is None:
        return None, None, warnings
    span = [c for c in ("s", "e") if hits.shown is None]
    found = hits.rows if hits.keys is None else hits.keys
    if request.after is not None:
        found = found.where(behind(request.after))
    chosen = found.select(*ORDER, *span).orderBy(*ORDER).offset(request.offset).limit(request.limit + 1)
    if request.limit < KEYED_ROWS:
        found = chosen.collect()
        chosen = utterances.sparkSession.createDataFrame(found, chosen.schema)
        utterances = utterances.where(lookup.within([(r["corpus_id"], r["row_id"]) for r in found])) if found else utterances.limit(0)
        chosen = F.broadcast(chosen)
    rows = hits.in_context(utterances.join(chosen, ["corpus_id", "row_id"]))
    return hits, rows.select("row_id", *RESULT, "ordinal", "left", "hit", "right").orderBy(*ORDER), warnings


def search(utterances: DataFrame, token_stats: DataFrame, request: Request, index: Index | None = None) -> Page:
    """One page of results. A page is what its reader sees, so its rows (``limit`` and one more) come to the driver."""
    hits, rows, warnings = page(utterances, token_stats, request, index)
    if hits is None:
        return Page(None, False, warnings)
    found = rows.collect()
    more = len(found) > request.limit
    return Page(utterances.sparkSession.createDataFrame(found[: request.limit], rows.schema), more, warnings, cursor_of(found[request.limit - 1]) if more and request.limit else None)


def export_rows(hits: Hits, corpora: DataFrame) -> DataFrame:
    """All results as the columns of an export, with the contexts joined by spaces, and the columns of their order.

    ``corpora`` (corpus_id, name) is the catalog, which has one row for each corpus.
    """
    named = hits.in_context(hits.rows).join(F.broadcast(corpora.select(F.col("corpus_id").alias("_id"), F.col("name").alias("corpus_name"))), F.col("corpus_id") == F.col("_id"), "left")
    value = lambda c: F.concat_ws(" ", c) if c in ("left", "hit", "right") else F.coalesce(F.col(c).cast("string"), F.lit(""))
    numbers = {c: F.when(F.col(c) == F.floor(c), F.floor(c).cast("string")).otherwise(F.col(c).cast("string")) for c in ("start", "end")}
    return named.select(*ORDER, *(F.coalesce(numbers[c], F.lit("")).alias(k) if c in numbers else value(c).alias(k) for k, c in CSV.items()))


def csv_field(text: Column) -> Column:
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def export_csv(hits: Hits, corpora: DataFrame, path: str) -> int:
    """Write all results, in order, as one CSV file with a byte-order mark, a header and CRLF line ends; returns the rows.

    What is found is written once, so that the corpus is searched once; a sort looks at its input twice. The executors write the lines
    in parts, which are then put together as bytes, so the driver holds none of them.
    """
    spark = hits.rows.sparkSession
    folder = new_folder(spark)
    line = F.concat(F.concat_ws(",", *(csv_field(F.col(f"`{k}`")) for k in CSV)), F.lit("\r"))
    export_rows(hits, corpora).select(*ORDER, line.alias("value")).write.parquet(f"{folder}/found")
    found = spark.read.parquet(f"{folder}/found")
    found.orderBy(*ORDER).select("value").write.text(f"{folder}/lines")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs, target = filesystem(spark, path)
    source, at = filesystem(spark, f"{folder}/lines")
    parts = sorted(s.getPath().toString() for s in source.listStatus(at) if s.getPath().getName().startswith("part-"))
    out = fs.create(target, True)
    try:
        out.write(bytearray(("﻿" + ",".join(CSV) + "\r\n").encode()))
        for part in parts:
            stream = source.open(jvm.org.apache.hadoop.fs.Path(part))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            finally:
                stream.close()
    finally:
        out.close()
    n = found.count()
    remove(spark, folder)
    return n
