"""Registered queries of the importer: the driver's tables are written as corpus files, ingested, and what is stored is returned."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import filesystem, new_folder
from ..sources import names
from ..sources.loose import parse_loose
from ..sources.store import Store
from .queries import register


#: Utterances of a written file, about: a file is parsed whole, so what a task holds must not grow with the tables.
FILE_ROWS = 500


def file_count(rows: DataFrame) -> int:
    """How many files hold the utterances ``rows``."""
    return max(1, -(-rows.count() // FILE_ROWS))


def ingested(rows: DataFrame | list[DataFrame], kind: str, **options) -> Store:
    """Write rows as files of a kind, one JSON object or text a file, and ingest them. Of several frames the files of the first come first."""
    parts = rows if isinstance(rows, list) else [rows]
    spark = parts[0].sparkSession
    folder = new_folder(spark)
    for k, part in enumerate(parts, 1):
        writer = part.write.option("maxRecordsPerFile", 1) if kind in ("json", "text") else part.write
        # tasks put their files in place, not the driver one by one: the folder is new, so nobody reads it before
        writer = writer.option("mapreduce.fileoutputcommitter.algorithm.version", 2)
        writer.options(**options).format(kind).save(f"{folder}/corpus/{k}" if isinstance(rows, list) else f"{folder}/corpus")
    store = Store(spark, f"{folder}/store")
    record = store.ingest(f"{folder}/corpus")
    if record["status"] != "ready":
        raise ValueError(record["error"])
    return store


def conversations(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet")


def turn_id() -> Column:
    return F.concat_ws(".", F.lit("C"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))


def talks(spark: SparkSession, d: str, turns: str = "true") -> DataFrame:
    """One JSON document for each conversation (or for some of its turns), with given tokens."""
    words = F.filter(F.split("text", r"[ \n]+", -1), lambda w: w != "")
    tokens = F.transform(words, lambda w: F.struct(w.alias("orth"), F.concat(F.lit("x"), w).alias("lexeme"), F.length(w).cast("string").alias("tag")))
    said = F.struct(F.col("turn").alias("turn"), turn_id().alias("id"), F.col("role").alias("speaker_id"), F.col("text").alias("form"), tokens.alias("words"))
    rows = conversations(spark, d).where(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("utterance"))
    who = F.array(*(F.struct(F.lit(r).alias("id"), F.lit(a).alias("age"), F.lit(s).alias("sex")) for r, a, s in (("user", "20", "F"), ("assistant", "", "M"))))
    about = F.struct(F.concat(F.lit("talk "), F.col("conv_id").cast("string")).alias("title"), F.concat(F.lit("topic"), (F.col("conv_id") % 5).cast("string")).alias("topic"), who.alias("speaker"))
    return rows.select("conv_id", F.col("conv_id").cast("string").alias("id"), about.alias("metadata"), "utterance")


def in_files(docs: DataFrame, files: int, by: Column, **metadata: Column) -> DataFrame:
    """JSON files of documents, about so many for all kinds ``by`` together; ``metadata`` may name the kind, k."""
    fields = [c for c in docs.columns if c != "conv_id"]
    rows = docs.groupBy(by.alias("k"), F.pmod(F.xxhash64("conv_id"), F.lit(files)).alias("file")).agg(F.collect_list(F.struct(*fields)).alias("document"))
    return rows.select(F.struct(*(v.alias(k) for k, v in metadata.items())).alias("metadata"), "document")


_TALK_WORDS = "list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '')"


@register(
    "ingest_dialogue_json",
    f"""SELECT CAST(conv_id AS VARCHAR) AS doc_id, 'C.' || conv_id || '.' || turn AS utterance_id, role AS speaker_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS sequence, text AS form, 'topic' || (conv_id % 5) AS topic,
  'k' || (conv_id % 4) AS category, '2020' AS year, CASE role WHEN 'user' THEN '20' ELSE '' END AS speaker_age, CASE role WHEN 'user' THEN 'F' WHEN 'assistant' THEN 'M' ELSE '' END AS speaker_sex,
  CAST(len({_TALK_WORDS}) AS INT) AS n_tokens, array_to_string(list_transform({_TALK_WORDS}, lambda w: 'x' || w || '/' || length(w)), ' ') AS given FROM conversations""",
)
def ingest_dialogue_json(spark, d):
    files = file_count(conversations(spark, d))
    rows = in_files(talks(spark, d), -(-files // 4), F.col("conv_id") % 4, category=F.concat(F.lit("k"), F.col("k").cast("string")), year=F.lit(2020))
    said = ingested(rows, "json").table("utterances")
    given = F.array_join(F.transform("provided", lambda t: F.concat_ws("/", t["lemma"], t["pos"])), " ")
    return said.select("doc_id", "utterance_id", "speaker_id", "sequence", "form", "topic", "category", "year", "speaker_age", "speaker_sex", F.size("tokens").alias("n_tokens"), given.alias("given"))


#: Documents of a file of nested ones, which have some five utterances each.
NESTED_DOCS = FILE_ROWS // 5


@register(
    "ingest_nested_json",
    "SELECT (conv_id % 4) || '.' || (CAST(dense_rank() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id) AS VARCHAR)) AS doc_id, 'C.' || conv_id || '.' || turn AS utterance_id, 'topic' || (conv_id % 5) AS topic, 'outer' AS category, '1999' AS year FROM conversations",
)
def ingest_nested_json(spark, d):
    """Inner documents are numbered by their place in an outer one, which has several files: those of its later files have their ids."""
    k, file = (F.col("conv_id") % 4).alias("k"), F.floor(F.col("conv_id") / (4 * NESTED_DOCS)).alias("file")
    counted = conversations(spark, d).select("conv_id").distinct().groupBy(k, file).agg(F.count(F.lit(1)).alias("n"))
    before = counted.select("k", "file", F.coalesce(F.sum("n").over(W.partitionBy("k").orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = talks(spark, d).select("conv_id", F.struct(F.col("conv_id").alias("order"), "metadata", "utterance").alias("doc"))
    outer = inner.groupBy(k, file).agg(F.array_sort(F.collect_list("doc")).alias("document")).join(F.broadcast(before), ["k", "file"])
    name = lambda i: F.when(F.col("before") > 0, F.concat_ws(".", F.col("k").cast("string"), (F.col("before") + i + 1).cast("string")))
    numbered = F.transform("document", lambda x, i: x.withField("id", name(i)))
    outer = outer.withColumn("document", numbered)
    outer = outer.select(F.struct(F.lit("1999").alias("year"), F.lit("file").alias("category")).alias("metadata"), F.array(F.struct(F.col("k").cast("string").alias("id"), F.struct(F.lit("outer").alias("category")).alias("metadata"), "document")).alias("document"))
    return ingested(outer, "json").table("utterances").select("doc_id", "utterance_id", "topic", "category", "year")


@register(
    "ingest_stream",
    """SELECT CAST(conv_id AS VARCHAR) AS doc_id, count(*) AS utterance_count, CAST(1 AS BIGINT) AS first_sequence, greatest(count(*) FILTER (WHERE turn < 2), count(*) FILTER (WHERE turn >= 2)) AS last_sequence, count(DISTINCT role) AS speaker_count,
  sum(len(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda w: w <> ''))) AS n_tokens FROM conversations GROUP BY conv_id""",
)
def ingest_stream(spark, d):
    """Conversations that arrive in two batches, each a part of all of them: the counts of the second are added to those of the first."""
    folder = new_folder(spark)
    store = Store(spark, f"{folder}/store")
    files = max(8, file_count(conversations(spark, d)) // 2)  # each batch has a half of the turns
    for name, turns in (("a", "turn < 2"), ("b", "turn >= 2")):
        rows = in_files(talks(spark, d, turns), files, F.lit(1), category=F.lit("k"), year=F.lit(2020))
        rows.write.option("maxRecordsPerFile", 1).json(f"{folder}/corpus/{name}")
        store.follow(f"{folder}/corpus", "talks", f"{folder}/checkpoint")
    tokens = store.table("utterances").groupBy("doc_id").agg(F.sum(F.size("tokens")).alias("n_tokens"))
    return store.table("document_stats").join(tokens, "doc_id").select("doc_id", "utterance_count", "first_sequence", "last_sequence", "speaker_count", "n_tokens")


@register("ingest_first_wins", "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS doc_id, 'talk ' || conv_id AS title, 'first' AS category, 'user' AS speaker_id, '20' AS age FROM conversations")
def ingest_first_wins(spark, d):
    """Documents and speakers that come again in a later file, otherwise described, are those of the first one."""
    docs = talks(spark, d)
    other = F.struct(F.lit("another title").alias("title"), F.lit("t").alias("topic"), F.transform("metadata.speaker", lambda s: F.struct(s["id"].alias("id"), F.lit("99").alias("age"), s["sex"].alias("sex"))).alias("speaker"))
    again = docs.select("conv_id", "id", other.alias("metadata"), F.slice("utterance", 1, 0).alias("utterance"))
    files = file_count(conversations(spark, d))
    store = ingested([in_files(rows, files, F.lit(1), category=F.lit(name)) for name, rows in (("first", docs), ("second", again))], "json")
    who = store.table("speakers").where("speaker_id = 'user'").select("doc_id", "speaker_id", "age")
    return store.table("documents").select("doc_id", "title", "category").join(who, "doc_id")


def items(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").where("text is not null")


_CLEAN = "trim(regexp_replace(text, '[ \\n]+', ' ', 'g'))"


@register(
    "ingest_paragraph_json",
    f"SELECT 'P' || item_id AS doc_id, CASE n WHEN 1 THEN 'P' || item_id || '.1' ELSE 'P' || item_id || '.paragraph.3' END AS utterance_id, CAST(n AS BIGINT) AS sequence, {_CLEAN} AS form, '2019' AS year, '문단 말뭉치' AS category FROM benchmark, (VALUES (1), (3)) t(n)",
)
def ingest_paragraph_json(spark, d):
    """Paragraphs with tags and entities, a blank one between them, and one without an id."""
    coded = F.concat(F.lit("<p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("e"), F.lit("&#x65;")), F.lit("<br/> </p>"))
    part = lambda form, i=None: F.struct(F.lit(i).cast("string").alias("id") if i is None else i.alias("id"), form.alias("form"))
    name = F.concat(F.lit("P"), F.col("item_id").cast("string"))
    rows = items(spark, d).select(name.alias("id"), F.struct(F.lit("20190102").alias("date")).alias("metadata"), F.array(part(coded, F.concat(name, F.lit(".1"))), part(F.lit(" ")), part(F.col("text"))).alias("paragraph"))
    files = rows.groupBy((F.xxhash64("id") % 3).alias("k")).agg(F.collect_list(F.struct("id", "metadata", "paragraph")).alias("document")).select("document")
    return ingested(files, "json").table("utterances").select("doc_id", "utterance_id", "sequence", "form", "year", "category")


@register(
    "ingest_sentence_json",
    f"SELECT 'root:S' || item_id AS doc_id, 'root:S' || item_id || '.sentence.1' AS utterance_id, {_CLEAN} AS form, 'k > deep' AS category, 'q' AS speaker_id, '40' AS speaker_age, '[{{\"formCount\":1,\"formRange\":{{\"firstId\":\"a\",\"lastId\":\"a\"}}}}]' AS inference FROM benchmark",
)
def ingest_sentence_json(spark, d):
    """Sentences with inferences from context: ids within the file's, speakers given by objects, inferences without their forms."""
    who = F.struct(F.lit("q").alias("dis_speaker_id"))
    about = F.struct(F.array(F.struct(who.alias("id"), F.lit("40").alias("age"))).alias("speaker"))
    inference = F.array(F.struct(F.array(F.struct(F.lit("a").alias("id"))).alias("form")))
    doc = F.struct(F.concat(F.lit("S"), F.col("item_id").cast("string")).alias("id"), about.alias("metadata"), F.array(F.struct(F.col("text").alias("form"), who.alias("dis_speaker_id"))).alias("sentence"), inference.alias("CI"))
    files = items(spark, d).groupBy((F.col("item_id") % 3).alias("k")).agg(F.collect_list(doc).alias("document"))
    files = files.select(F.lit("root").alias("id"), F.struct(F.lit("k").alias("category"), F.array(F.lit("deep")).alias("annotation_level")).alias("metadata"), "document")
    store = ingested(files, "json")
    said = store.table("utterances").select("doc_id", "utterance_id", "form", "category", "speaker_id", "speaker_age")
    return said.join(store.table("documents").select("doc_id", F.replace(F.get_json_object("metadata", "$.contextInference"), F.lit(" "), F.lit("")).alias("inference")), "doc_id")


@register(
    "ingest_web_json",
    "SELECT 'W' || item_id AS doc_id, 'W' || item_id || '.s' || n AS utterance_id, text AS form, '웹 말뭉치' AS category, '웹 문서' AS topic, CASE n WHEN 1 THEN 1 ELSE 0 END AS n_remarks FROM benchmark, (VALUES (1), (2)) t(n)",
)
def ingest_web_json(spark, d):
    name = F.concat(F.lit("W"), F.col("item_id").cast("string"))
    sentence = lambda n: F.struct(F.concat(name, F.lit(f".s{n}")).alias("id"), F.col("text").alias("form"))
    doc = F.struct(name.alias("id"), F.array(sentence(1), sentence(2)).alias("sentence"), F.array(F.struct(F.concat(name, F.lit(".s1")).alias("expression_id"), F.lit("x").alias("kind"))).alias("immoral_expression"))
    files = items(spark, d).groupBy((F.col("item_id") % 3).alias("k")).agg(F.collect_list(doc).alias("document")).select("document")
    said = ingested(files, "json").table("utterances")
    return said.select("doc_id", "utterance_id", "form", "category", "topic", F.json_array_length(F.get_json_object("metadata", "$.immoralExpression")).alias("n_remarks"))


@register(
    "ingest_paraphrase_json",
    f"SELECT 'a.b' AS doc_id, 'a.b.' || item_id || '.paraphrase.' || n AS utterance_id, {_CLEAN} AS form, '유사 문장 말뭉치' AS category, CAST(row_number() OVER (ORDER BY item_id, n) AS BIGINT) AS sequence FROM benchmark, (VALUES (1), (3)) t(n)",
)
def ingest_paraphrase_json(spark, d):
    """All documents are one, by their ids; blank paraphrases are left out of its running numbers."""
    form = lambda c: F.struct(c.alias("form"))
    one = F.struct(F.col("item_id").alias("order"), F.concat(F.lit("a.b."), F.col("item_id").cast("string")).alias("sentence_id"), F.array(form(F.col("text")), form(F.lit(" ")), form(F.col("text"))).alias("paraphrases"))
    files = items(spark, d).groupBy(F.lit(1).alias("k")).agg(F.array_sort(F.collect_list(one)).alias("data")).select("data")
    return ingested(files, "json").table("utterances").select("doc_id", "utterance_id", "form", "category", "sequence")


CSV = {"header": True, "quote": '"', "escape": '"'}


def as_table(rows: DataFrame, files: int, *order: str) -> DataFrame:
    """The stored utterances of rows that are written as so many tables, each with a range of the first column of their order, which is the
    document's: a document's sentences are numbered within a file."""
    parts = rows.repartitionByRange(files, order[0]).sortWithinPartitions(*order)
    return ingested(parts.drop(*(c for c in order if c.startswith("_"))), "csv", **CSV).table("utterances")


@register(
    "ingest_sentence_table",
    f"SELECT 'C.' || conv_id AS doc_id, 'C.' || conv_id || '.' || turn AS utterance_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS sequence, {_CLEAN} AS form, '2019' AS year, '문장 말뭉치' AS category, 'topic' || (conv_id % 5) AS topic, CASE role WHEN 'user' THEN 'S' ELSE 'text' END AS speaker_id, CASE role WHEN 'user' THEN '50' ELSE '' END AS speaker_age FROM conversations",
)
def ingest_sentence_table(spark, d):
    """Documents by sentence ids, and speakers as loose JSON."""
    who = F.when(F.col("role") == "user", F.lit("{id: 'S', age: 50, /* and */}"))
    rows = conversations(spark, d).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), turn_id().alias("sentence_id"), F.col("text").alias("sentence"), F.lit("20191231").alias("date"), F.concat(F.lit("topic"), (F.col("conv_id") % 5).cast("string")).alias("topic"), who.alias("speaker"))
    return as_table(rows, file_count(rows), "_c", "_t").select("doc_id", "utterance_id", "sequence", "form", "year", "category", "topic", "speaker_id", "speaker_age")


@register(
    "ingest_annotation_table",
    f"SELECT 'C.' || conv_id AS doc_id, 'C.' || conv_id || '.' || turn AS utterance_id, {_CLEAN} AS form, '1' AS note, array_to_string(list_transform({_TALK_WORDS}, lambda w, i: 'x' || w || '/' || i), ' ') AS given FROM conversations",
)
def ingest_annotation_table(spark, d):
    """A row for each word; consecutive rows of a sentence are one utterance with its given tokens. The first two of them repeat the sentence: if all
    did, a file would grow with the square of a sentence's length."""
    words = F.filter(F.split("text", r"[ \n]+", -1), lambda w: w != "")
    rows = conversations(spark, d).select("conv_id", "turn", "text", F.posexplode(words).alias("at", "word"))
    number = (F.col("at") + 1).cast("string")
    rows = rows.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("at").alias("_a"), turn_id().alias("sentence_id"), F.when(F.col("at") < 2, F.col("text")).alias("sentence"), number.alias("word_id"), F.col("word").alias("word_form"), number.alias("label"), F.concat(F.lit("x"), "word").alias("lemma"))
    given = F.array_join(F.transform("provided", lambda t: F.concat_ws("/", t["lemma"], t["pos"])), " ")
    return as_table(rows, file_count(conversations(spark, d)), "_c", "_t", "_a").select("doc_id", "utterance_id", "form", "note", given.alias("given"))


@register(
    "ingest_paraphrase_table",
    f"SELECT 'a.b' AS doc_id, 'a.b.' || item_id || '.paraphrase.' || CASE item_id % 2 WHEN 1 THEN CAST(item_id AS VARCHAR) ELSE CAST(row_number() OVER (ORDER BY item_id) AS VARCHAR) END AS utterance_id, {_CLEAN} AS form, 'by hand' AS note FROM benchmark",
)
def ingest_paraphrase_table(spark, d):
    rows = items(spark, d).select(F.col("item_id").alias("_i"), F.concat(F.lit("a.b."), F.col("item_id").cast("string")).alias("sentence_id"), F.col("text").alias("form"), F.lit("by hand").alias("generation"), F.when(F.col("item_id") % 2 == 1, F.col("item_id").cast("string")).alias(" "))
    # the unnamed column: Spark writes its name as a blank, which the header then trims
    # one table, as all its sentences are one document's and numbered on; the benchmark has some hundred items
    return as_table(rows.withColumnRenamed(" ", ""), 1, "_i").select("doc_id", "utterance_id", "form", "note")


@register(
    "ingest_judgement_table",
    "SELECT 'L.' || doc_id AS doc_id, 'L.' || doc_id || '.s.1' AS utterance_id, '문법성 판단 말뭉치' AS category, 'acceptability=' || quality || CASE toxic WHEN 1 THEN ', annotation=*' ELSE '' END AS note FROM (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id)",
)
def ingest_judgement_table(spark, d):
    rows = spark.read.parquet(f"{d}/labels.parquet").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    name = F.concat(F.lit("L."), F.col("doc_id").cast("string"))
    rows = rows.select(F.col("doc_id").alias("_d"), name.alias("document_id"), F.concat(name, F.lit(".s.1")).alias("sent_id"), F.col("quality").alias("acceptability_label"), F.when(F.col("toxic") == 1, "*").alias("source_annotation"), F.concat(F.lit("Sentence "), name).alias("sentence"))
    return as_table(rows, file_count(rows), "_d").select("doc_id", "utterance_id", "category", "note")


@register(
    "ingest_letters",
    f"SELECT 'W' || conv_id AS author, CAST(1600 + conv_id % 300 AS VARCHAR) AS year, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS sequence, {_CLEAN} AS form, 'page=' || turn AS note, '역사 말뭉치' AS category FROM conversations",
)
def ingest_letters(spark, d):
    """Letters in XML as Spark writes it, so with all escapes that it makes."""
    sent = F.struct(F.col("turn").alias("_page"), F.col("text").alias("_VALUE"))
    said = conversations(spark, d)
    rows = said.repartition(file_count(said), "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(sent)).alias("sent"))
    number = F.col("conv_id").cast("string")
    rows = rows.select(number.alias("_n"), F.concat(F.lit("W"), number).alias("_writer"), F.concat((F.lit(1600) + F.col("conv_id") % 300).cast("string"), F.lit(" A.D.")).alias("_year"), "sent")
    store = ingested(rows, "xml", rootTag="doc", rowTag="letter")
    about = store.table("documents").select("doc_id", "author")
    return store.table("utterances").join(about, "doc_id").select("author", "year", "sequence", "form", "note", "category")


@register(
    "ingest_tei",
    f"""SELECT 'talk ' || conv_id AS title, CAST(1 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS sequence, array_to_string({_TALK_WORDS}, ' ') AS form, 'tag=p, date=1993/06/0' || (turn % 9 + 1) || ', page=' || turn AS note, array_to_string(list_transform({_TALK_WORDS}, lambda w: 'x' || length(w) || '/NNG s/XSN'), ' ') AS given, '21세기 세종계획' AS category
FROM conversations UNION ALL SELECT DISTINCT 'talk ' || conv_id, CAST(1 AS BIGINT), 'opening', 'tag=head', '', '21세기 세종계획' FROM conversations""",
)
def ingest_tei(spark, d):
    """Analysed texts: a source before each paragraph, whose date and page hold for it, and lines of id, surface and morphemes."""
    words = F.filter(F.split("text", r"[ \n]+", -1), lambda w: w != "")
    line = lambda w, i: F.concat(F.lit("AB-"), i.cast("string"), F.lit("\t"), F.replace(w, F.lit("&"), F.lit("&")), F.lit("\tx"), F.length(w).cast("string"), F.lit("__01/NNG + s/XSN"))
    block = F.concat(F.lit("<source><date>1993/06/0"), (F.col("turn") % 9 + 1).cast("string"), F.lit("</date><page>"), F.col("turn").cast("string"), F.lit("</page></source>\n<p>\n"), F.array_join(F.transform(words, line), "\n"), F.lit("\n</p>"))
    rows = conversations(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("blocks"))
    text = F.concat(F.lit("<tei.2><title>talk "), F.col("conv_id").cast("string"), F.lit("</title><head>opening</head>\n"), F.array_join(F.transform("blocks", lambda x: x["b"]), "\n"), F.lit("\n</tei.2>"))
    store = ingested(rows.select(text.alias("value")), "text")
    about = store.table("documents").select("doc_id", "title")
    given = F.array_join(F.transform("provided", lambda t: F.concat_ws("/", t["lemma"], t["pos"])), " ")
    return store.table("utterances").join(about, "doc_id").select("title", "sequence", "form", "note", given.alias("given"), "category")


@register(
    "source_dedupe",
    """, s AS (SELECT n_nationkey AS k, CAST(2000 + n_nationkey AS VARCHAR) AS y FROM nation), p AS (
  SELECT '/in/NIKL_NEWSPAPER_' || y || '_CSV.zip' AS path FROM s UNION ALL SELECT '/in/NIKLNEWSPAPER_' || y || '_v1.zip' FROM s WHERE k % 3 = 0 UNION ALL SELECT '/in/NIKL_MESSENGER_' || k || CASE k % 2 WHEN 0 THEN '_JSON' ELSE '_CSV' END || '.zip' FROM s)
SELECT path FROM p WHERE path NOT LIKE '%MESSENGER%CSV%' AND NOT (path LIKE '%NEWSPAPER%CSV%' AND EXISTS (SELECT 1 FROM p q WHERE q.path LIKE '%NEWSPAPER%' AND q.path NOT LIKE '%CSV%' AND regexp_extract(q.path, '20[0-9][0-9]') = regexp_extract(p.path, '20[0-9][0-9]')))""",
)
def source_dedupe(spark, d):
    """Which sources of a folder are read; a folder's listing is small, so this is plain Python."""
    keys = [r[0] for r in spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey").collect()]
    paths = [f"/in/NIKL_NEWSPAPER_{2000 + k}_CSV.zip" for k in keys] + [f"/in/NIKLNEWSPAPER_{2000 + k}_v1.zip" for k in keys if k % 3 == 0] + [f"/in/NIKL_MESSENGER_{k}_{'CSV' if k % 2 else 'JSON'}.zip" for k in keys]
    return spark.createDataFrame([(p,) for p in names.without_repeated(paths)], "path string")


@register("loose_objects", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def loose_objects(spark, d):
    """The events' properties, written loosely and read again."""

    def read(batches):
        for batch in batches:
            found = batch["loose"].map(parse_loose)
            yield pd.DataFrame({"event_id": batch["event_id"], "k": found.map(lambda o: o.get("k")).astype("Int64")})

    events = spark.read.parquet(f"{d}/events.parquet")
    loose = F.concat(F.regexp_replace(F.col("props"), r'"(\w+)":', "$1 : "), F.lit(" // props"))
    return events.select("event_id", F.regexp_replace(loose, r"\}", ",}").alias("loose")).mapInPandas(read, "event_id long, k long")


@register(
    "ingest_zip",
    f"SELECT 'Z' || item_id AS doc_id, {_CLEAN} AS form, '신문 말뭉치' AS category FROM benchmark WHERE item_id % 3 <> 2",
)
def ingest_zip(spark, d):
    """An archive with a table, an archive that is opened by its path, one that is not, and a file of no kind."""
    import io
    import zipfile

    def table(rows) -> bytes:
        return ("sentence_id,doc_id,sentence\n" + "".join(f'Z{r[0]}.s,Z{r[0]},"{r[1].replace(chr(34), chr(34) * 2)}"\n' for r in rows)).encode()

    def pack(files: dict[str, bytes]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in files.items():
                z.writestr(name, data)
        return out.getvalue()

    rows = sorted((r[0], r[1]) for r in items(spark, d).select("item_id", "text").collect())  # the benchmark has some hundred items
    part = lambda k: table([r for r in rows if r[0] % 3 == k])
    data = pack({"a.csv": part(0), "02_more/1. news.zip": pack({"b.csv": part(1)}), "other/1. news.zip": pack({"c.csv": part(2)}), "notes.md": b"x"})
    folder = new_folder(spark)
    fs, path = filesystem(spark, f"{folder}/NEWSPAPER.zip")
    out = fs.create(path, True)
    out.write(bytearray(data))
    out.close()
    store = Store(spark, f"{folder}/store")
    store.ingest(f"{folder}/NEWSPAPER.zip")
    return store.table("utterances").select("doc_id", "form", "category")
