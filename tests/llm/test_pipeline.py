import corpus_pipeline
from cases import equal_rows, no_documents, odd_documents
from pyspark.sql import functions as F
from test_decontamination import slow_leaks
from test_jaccard import slow_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    rows = {r["doc_id"]: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    known = stage["language_id"](spark, docs, SF)
    assert known.columns == docs.columns and {r["doc_id"] for r in known.collect()} == set(rows)
    unique = stage["jaccard_join"](spark, docs, SF)
    assert unique.columns == docs.columns
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted({c for _, _, c in slow_components([(k, r["text"]) for k, r in rows.items()])})
    clean = stage["decontamination"](spark, docs, SF)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 5]) for _, t in items for w in [t.lower().split()] for i in range(len(w) - 4)}
    near = [(k, r["text"]) for k, r in rows.items() if any(tuple(w[i : i + 5]) in grams for w in [r["text"].lower().split()] for i in range(len(w) - 4))]
    assert {r["doc_id"] for r in clean.collect()} == set(rows) - {d for d, _ in slow_leaks(near, items)}
    private = stage["pii"](spark, docs, SF)
    assert private.columns == docs.columns and all(len(r["text"]) == r["n_chars"] for r in private.collect())
    assert stage["packing"](spark, docs, SF).agg({"n_tokens": "sum"}).first()[0] == sum(len(r["text"].split()) for r in rows.values())


def test_odd(spark):
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, no_documents(spark), SF).count() == 0
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    # document 6 has 17 of the 21 shingles of document 0
    want = {c for _, _, c in slow_components([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert 6 not in want and sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in left) == sorted(-1 if c is None else c for c in want)


def test_odd_with_clashing_columns(spark):
    plain, docs = odd_documents(spark), odd_documents(spark, True)
    marked = docs.selectExpr("*", "'y' as w_lang", "'y' as __lang", "'y' as __r1", "'y' as w_r1", "'y' as w_digest", "'y' as piece_", "'y' as total", "'y' as W_Found")
    own = lambda rows: sorted((str(r["doc_id"]), str(r["text"])) for r in rows.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, marked, SF)
        assert got.columns == marked.columns and own(got) == own(stage(spark, plain, SF)), name
        assert {v for r in got.collect() for v in r[len(docs.columns) :]} == {"y"}, name
        assert stage(spark, marked.limit(0), SF).count() == 0, name
    pieces = lambda d: sorted((str(r["doc_id"]), r["piece"], r["n_tokens"]) for r in corpus_pipeline.pack(spark, d, SF).collect())
    assert pieces(marked) == pieces(plain)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and out.where("n_tokens > 2048").count() == 0


def test_shared_and_missing_ids(spark):
    def words(name, n=40):
        return " ".join(f"{name}{k}" for k in range(n))

    lone = [(5, words(f"u{k}x"), "en", "a", 1) for k in range(6)]  # one id, unrelated texts
    rows = [
        *lone,
        (3, words("copy"), "en", "a", 1),
        (5, words("copy") + " more", "en", "a", 1),  # near copy of 3 under the shared id
        (None, words("copy"), "en", "a", 1),  # copy of 3 without an id
        (None, words("none"), "en", None, 1),  # a group without any id
        (None, words("none") + " more", None, "en", 1),
        (None, words("other"), "en", None, 1),  # equal but for the place of a null
        (None, words("other"), None, "en", 1),
        (9, words("same"), "en", "a", 1),
        (9, words("same"), "en", "a", 1),
        (8, "", "en", "a", 0),
        (8, None, "en", "a", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert all(r in rows for r in left)
    assert [r for r in left if r[0] == 5 and r in lone] and sorted(r for r in left if r[0] == 5) == sorted(lone)
    assert [r for r in left if r[1] and "copy0" in r[1]] == [rows[6]]
    assert sum("none0" in (r[1] or "") for r in left) == sum("other0" in (r[1] or "") for r in left) == sum("same0" in (r[1] or "") for r in left) == 1
    assert sum(r[0] == 8 for r in left) == 2 and len(left) == 12


def test_no_language_at_all(spark):
    rows = [(k, t, None, "a", 1) for k, t in enumerate(["some words", "\u00e9t\u00e9", "12 34", "", None, "\u6f22 1"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.keep_known_languages(spark, docs, SF)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 1, 5]


def test_run_on_equal_rows(spark, tmp_path):
    """A table of equal rows, and one of an id with many texts, with a map beside; every stage takes what the one before has kept."""
    for name, key in (("rows", None), ("id", 7)):
        docs = equal_rows(spark, 1000, key).withColumn("m", F.expr("map('k', doc_id)"))
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        kept = sorted(r["doc_id"] for r in out.collect())
        assert kept == [0 if key is None else 7, 1001, 1002]
