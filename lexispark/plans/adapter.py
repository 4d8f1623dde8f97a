"""The driver's tables as stored corpora: ``conversations`` as dialogues (conv), ``documents`` as paragraphs with a line an utterance (docs).

The tables are written into a store once for each session and folder, as any other corpus is; all queries read what is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE, terms
from ..scratch import new_folder
from ..sources.store import Store

#: Room for the sequence numbers of one document in a row id.
STRIDE = 1_000_000
_stores: dict[tuple[str, str], Store] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows in as many parts as the session has cores at least, by ranges of a key: a small table is one file, which one task would read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartitionByRange(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def _filled(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.lit("") for n in names})


def tag(word: Column) -> Column:
    """The made-up part of speech of the fixture's given tokens."""
    return F.when(word.rlike("^[0-9]+$"), "SN").when(word.rlike("(ing|ed)$"), "VV").otherwise("NNG")


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances of conversations, with given tokens: a lemma without its ending, and a tag."""
    c, role = _spread(_table(spark, sf_dir, "conversations"), "conv_id"), F.col("role")
    form = F.concat(F.lit("{"), role, F.lit("} "), F.col("text"))
    rows = c.select(
        (F.col("conv_id") * STRIDE + F.col("turn") + 1).alias("row_id"),
        F.col("conv_id").cast("string").alias("doc_id"),
        F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("utterance_id"),
        role.alias("speaker_id"),
        (F.col("turn") + 1).cast("long").alias("sequence"),
        form.alias("form"),
        F.col("text").alias("original_form"),
        F.element_at(F.array(F.lit("daily"), F.lit("service"), F.lit("news")), (F.col("conv_id") % 3 + 1).cast("int")).alias("category"),
        F.concat(F.lit("topic"), (F.col("conv_id") % 5).cast("string")).alias("topic"),
        (F.lit(2010) + F.col("conv_id") % 4).cast("string").alias("year"),
        F.when(role == "user", "20").when(role == "assistant", "").otherwise("30").alias("speaker_age"),
        F.when(role == "user", "F").when(role == "system", "M").otherwise("").alias("speaker_sex"),
        F.transform(terms(form), lambda w: F.struct(w.alias("surface"), F.regexp_replace(w, "(ing|ed|s)$", "").alias("lemma"), tag(w).alias("pos"))).alias("provided"),
    )
    return _filled(_timeless(rows), "speaker_occupation", "note").withColumn("metadata", F.lit("{}"))


def _timeless(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"time": F.lit(None).cast("string"), "start": F.lit(None).cast("double"), "end": F.lit(None).cast("double")})


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    lines = d.select("doc_id", "lang", "source", F.posexplode_outer(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.where(F.regexp_replace("line", rf"[{SPACE}]+", "") != "")
    rows = lines.select(
        (F.col("doc_id") * STRIDE + F.col("at") + 1).alias("row_id"),
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat_ws(".", F.col("doc_id").cast("string"), (F.col("at") + 1).cast("string")).alias("utterance_id"),
        F.lit("text").alias("speaker_id"),
        (F.col("at") + 1).cast("long").alias("sequence"),
        F.col("line").alias("form"),
        F.col("line").alias("original_form"),
        F.col("lang").alias("category"),
        F.col("source").alias("topic"),
        F.array().cast("array<struct<surface:string,lemma:string,pos:string>>").alias("provided"),
    )
    return _filled(_timeless(rows), "year", "speaker_age", "speaker_sex", "speaker_occupation", "note").withColumn("metadata", F.lit("{}"))


def _publish(store: Store, spark: SparkSession, sf_dir: str) -> None:
    conv = dialogue(spark, sf_dir)
    docs = _table(spark, sf_dir, "documents")
    blank = ("author", "publisher", "date")
    talks = conv.select("doc_id", F.concat(F.lit("conversation "), "doc_id").alias("title"), "topic", "category", "year").distinct()
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("topic"), F.col("lang").alias("category"), F.lit("").alias("year"))
    who = conv.select("doc_id", "speaker_id", F.col("speaker_age").alias("age"), F.col("speaker_sex").alias("sex")).distinct()
    rest = ("occupation", "birthplace", "principal_residence", "current_residence", "education", "device", "keyboard")
    metadata = lambda rows, kind: _filled(rows, *blank).withColumn("metadata", F.lit(f'{{"sourceFormat": "{kind}"}}'))
    speakers = _filled(who, *rest).withColumn("metadata", F.to_json(F.struct(F.col("speaker_id").alias("id"), "age", "sex")))
    described = lambda c: {"corpus_id": c, "name": c, "source_path": f"{sf_dir}/{c}"}
    for row in store.together(
        lambda: store.publish(described("conv"), conv, metadata(talks, "nikl-dialogue"), speakers, 1),
        lambda: store.publish(described("docs"), paragraphs(spark, sf_dir), metadata(texts, "nikl-paragraph-json"), speakers.limit(0), 1),
    ):
        if row["status"] != "ready":
            raise ValueError(row["error"])


def corpus(spark: SparkSession, sf_dir: str) -> Store:
    """The stored corpora of a folder's tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        store = Store(spark, new_folder(spark))
        _publish(store, spark, sf_dir)
        _stores[key] = store
    return _stores[key]


def utterances(spark: SparkSession, sf_dir: str, corpora: tuple[str, ...] = ()) -> DataFrame:
    rows = corpus(spark, sf_dir).table("utterances")
    return rows.where(F.col("corpus_id").isin(*corpora)) if corpora else rows
