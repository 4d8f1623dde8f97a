"""The registered queries of the training-data operators, one for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, class_lm, decontamination, hard_negatives, jaccard_join, language_id, packing, pii, quality_model, quality_rules, sharding, toxicity, url_filter
from ._base import stored, table
from .oracles import ORACLES  # noqa: F401

#: The key of the queries and tests; a real run takes its key from its own secret store.
DEMO_KEY = "demonstration key"
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def _held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; rows without an id are neither held out nor learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _learnt(key: str = "doc_id") -> Column:
    return F.col(key).isNotNull() & ~_held_out(key)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(_learnt()))
    return toxicity.score(docs, model).withColumn("held_out", _held_out())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start", "n_words", "hamming")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, DEMO_KEY, count="n_changed")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    entries = quality_rules.apply_policy(entries, quality_rules.BASE, "base_kept")
    entries = quality_rules.apply_policy(entries, quality_rules.DEFAULT, "kept")
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "fail_bits")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(_learnt()))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(quality_model.with_statistics(table(spark, sf_dir, "documents")), "statistics")
    model = quality_model.fit(stats, table(spark, sf_dir, "labels").where(_learnt()))
    out = quality_model.score(stats, model).withColumnRenamed("key", "doc_id")
    return out.select("doc_id", _held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = alignment.linked(table(spark, sf_dir, "documents"))
    return alignment.with_counts(links, alignment.pair_counts(links)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(hard_negatives.index(hard_negatives.quantised(rows)), F.col("key") % 100 == 0)


def op13_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = class_lm.fit(docs.where(class_lm.learnt_from(F.col("doc_id"))))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    out = class_lm.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_pii": op3_pii,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_sharding": op5_sharding,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality_model": op9_quality_model,
    "op10_url_filter": op10_url_filter,
    "op11_token_alignment": op11_token_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_class_lm": op13_class_lm,
}
