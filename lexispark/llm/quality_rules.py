"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document; the ledger keeps its measurements and one bit per failed rule. A policy is a
named, versioned set of rules, that is a mask over the bits, so policies and ablations need no second look at a text.
All of it is column expressions; no shuffle happens before the ablation's aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import SPACE_RUN, free_prefix, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]

#: Rule name -> failure, over the measurements. The position is the rule's bit and never changes; new rules go last.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "shouting": "2 * n_upper > word_chars",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document fails it if it fails any of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
DEFAULT = Policy("default", 1, tuple(RULES))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append the measurements of ``text`` to every row of ``docs``.

    n_words, word_chars (code points in words), n_symbols (characters of ``#*$%&|<>``), n_dup_lines (lines with a word that
    equal an earlier line), n_repeat_words (words in 8-word windows found twice or more in the text, the first included),
    n_lines (lines with a word), n_upper (A-Z). Null and empty texts measure 0 throughout. All rows stay, repeated ones and those
    with null keys too; columns that are named like a measurement, in whatever case, are replaced, all others stay. An empty table
    gives an empty table.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in MEASURES]
    w = free_prefix(docs)
    text_, words_, lines_, h2_, h4_, h8_, sorted_, twice_ = (w + n for n in ("text", "words", "lines", "h2", "h4", "h8", "sorted", "twice"))
    t = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(*kept, t.alias(text_), words(F.col(text)).alias(words_))
    lines = F.filter(F.split(text_, "\n", -1), lambda x: F.regexp_replace(x, SPACE_RUN, "") != "")
    step = step.select(
        *kept,
        words_,
        lines.alias(lines_),
        (F.length(text_) - F.length(F.translate(text_, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text_) - F.length(F.translate(text_, UPPER, ""))).cast("long").alias("n_upper"),
    )

    def widen(name: str, by: int) -> Column:
        a = F.col(name)
        return F.when(F.size(a) > by, F.transform(F.sequence(F.lit(0), F.size(a) - 1 - by), lambda i: F.xxhash64(F.get(a, i), F.get(a, i + by)))).otherwise(F.array().cast("array<bigint>"))

    step = step.select(
        *kept,
        "n_symbols",
        "n_upper",
        F.size(words_).cast("long").alias("n_words"),
        F.length(F.array_join(words_, "")).cast("long").alias("word_chars"),
        F.size(lines_).cast("long").alias("n_lines"),
        (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long").alias("n_dup_lines"),
        widen(words_, 1).alias(h2_),
    )
    step = step.withColumn(h4_, widen(h2_, 2)).drop(h2_)
    step = step.withColumn(h8_, widen(h4_, 4)).drop(h4_)
    repeats = F.size(F.array_distinct(h8_)) < F.size(h8_)
    step = step.withColumn(sorted_, F.when(repeats, F.array_sort(F.transform(h8_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col(sorted_)
    twice = F.array_sort(
        F.filter(
            F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])),
            lambda i: i.isNotNull(),
        )
    )
    step = step.withColumn(twice_, F.when(s.isNotNull(), twice)).drop(sorted_, h8_)
    p = F.col(twice_)
    covered = F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).select(*kept, *MEASURES)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``measure`` plus ``fail_bits``: the bit of every rule that the document fails; a column of that name is replaced.

    Nulls, repeated rows, clashing names and empty tables are treated as by ``measure``.
    """
    bits = None
    for name, fails in RULES.items():
        bit = F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "fail_bits"))
    return measure(docs, text).withColumn("fail_bits", bits)


def apply_policy(entries: DataFrame, policy: Policy, column: str = "kept") -> DataFrame:
    """Append whether the entry fails none of the policy's rules; a column of that name is replaced, all others stay.

    Entries come from ``ledger``, where null and empty texts have their bits as any other; all rows stay, repeated ones too, and an empty
    table gives an empty table.
    """
    return entries.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of ``policy``: documents that fail it, that fail only it, and that all others together reject.

    The ledger is first summed by its bits, of which there are at most 2 ** rules, so nothing else is shuffled.
    An empty ledger gives counts of 0.
    """
    spark = entries.sparkSession
    counts = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.broadcast(spark.createDataFrame([(r, BIT[r]) for r in policy.rules], "rule string, bit long"))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not("bit")) != 0
    # at most 2 ** rules sums meet at most 63 rules
    pairs = counts.withColumn("bit", F.explode(F.array(*(F.lit(BIT[r]).cast("long") for r in policy.rules))))
    sums = pairs.groupBy("bit").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(hit & ~rest, F.col("n")).otherwise(0)).alias("failed_only"),
        F.sum(F.when(rest, F.col("n")).otherwise(0)).alias("rejected_without"),
    )
    zero = F.lit(0).cast("long")
    return rules.join(sums, "bit", "left").select(
        F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "rule", *(F.coalesce(c, zero).alias(c) for c in ("failed", "failed_only", "rejected_without"))
    )
