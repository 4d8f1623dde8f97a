"""The importer's queries write many short files where their tables are large, and give the rows of their SQL."""

import json
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from lexispark.plans import imports
from lexispark.plans.queries import numbered_lines

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["ingest_first_wins", "ingest_annotation_table", "ingest_dialogue_json", "ingest_nested_json", "ingest_sentence_table", "ingest_stream"])
def test_files_do_not_grow(spark, monkeypatch, name):
    made = []

    class Watched(imports.Store):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(imports, "Store", Watched)
    monkeypatch.setattr(imports, "FILE_ROWS", 10, raising=False)
    monkeypatch.setattr(imports, "NESTED_DOCS", 2, raising=False)
    found = entry.queries()[name](spark, SMALL)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{SMALL}/conversations.parquet'; CREATE VIEW documents AS FROM '{SMALL}/documents.parquet'")
    sql = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in sql.description]
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(sql.fetchall())
    files = Counter(json.loads(r[0])["sourceFile"] for r in made[0].table("utterances").select("metadata").collect())
    # of 87 utterances; a conversation is never cut
    assert len(files) > 4 and max(files.values()) < 30


def test_a_sentence_is_not_repeated_for_each_word(spark, monkeypatch):
    sizes = []
    was = imports.ingested

    def watched(rows, kind, **options):
        sizes.append(sum(len(r[0] or "") for r in rows.select("sentence").collect()))
        return was(rows, kind, **options)

    monkeypatch.setattr(imports, "ingested", watched)
    imports.ingest_annotation_table(spark, SMALL)
    assert sizes[0] <= 2 * sum(len(r[0]) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("text").collect())


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    lines = [f"{k} {'x' * (k % 50)}\r" for k in range(3000)]
    path = tmp_path / "lines.csv"
    path.write_bytes("".join(x + "\n" for x in lines).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = numbered_lines(spark, str(path))
        assert rows.rdd.getNumPartitions() > 4
        assert sorted(map(tuple, rows.collect())) == [(k, x[:-1]) for k, x in enumerate(lines)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
