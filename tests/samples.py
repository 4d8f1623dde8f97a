"""Small corpora for tests."""

from pyspark.sql import functions as F

from lexispark.functions import text as X
from lexispark.sources.tables import PROVIDED, SCHEMAS

COLUMNS = "corpus_id string, " + SCHEMAS["utterances"].split(", tokens ")[0] + ", time string, start double, end double, note string, category string, topic string, year string, speaker_age string, speaker_sex string, speaker_occupation string, metadata string"


def utterances(spark, rows):
    """Utterances of (document, speaker, text[, time, start, end]), numbered in order."""
    data = []
    for k, (d, s, t, *when) in enumerate(rows, 1):
        time, start, end = [*when, None, None, None][:3]
        data.append(("c", k, d, f"{d}.{k}", s, k, t, t, time, start, end, "", "cat", "top", "2020", "", "", "", "{}"))
    df = spark.createDataFrame(data, COLUMNS).withColumn("tokens", X.tokens(F.col("form")))
    given = "transform(tokens, t -> named_struct('surface', t.normalized, 'normalized', t.normalized, 'lemma', rtrim('s', t.normalized), 'pos', if(t.normalized like '%s', 'NNS', 'NN')))"
    return df.withColumn("provided", F.expr(given).cast(PROVIDED))


def token_stats(rows):
    kinds = {"raw": "tokens.normalized", "provided": "provided.normalized", "lemma": "provided.lemma", "pos": "provided.pos"}
    parts = [rows.select("corpus_id", F.lit(k).alias("kind"), F.explode(c).alias("term")) for k, c in kinds.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole.groupBy("corpus_id", "kind", "term").agg(F.count(F.lit(1)).alias("count"))
