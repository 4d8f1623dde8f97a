"""Ingest, publish, delete and the engine over what is stored."""

import json
import threading
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lexispark.engine import Engine
from lexispark.jobs import CANCELLED, DONE, FAILED, Jobs
from lexispark.operators import search
from lexispark.operators.filters import Filters
from lexispark.sources import log
from lexispark.sources.store import Store, numbered, read_files
from lexispark.sources.tables import SCHEMAS


def talk(doc, n, first=1, **metadata):
    said = [{"id": f"{doc}.{k}", "speaker_id": str(k % 2), "form": f"{{laugh}} word{k} Shared, end.", "words": [{"form": f"word{k}", "lemma": "word", "pos": "N"}]} for k in range(first, first + n)]
    return {"id": doc, "metadata": {"title": f"title {doc}", "topic": "t1", "speaker": [{"id": "0", "age": "20", "sex": "F"}, {"id": "1", "age": "30"}], **metadata}, "utterance": said}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpora")
    a, b = root / "in" / "a", root / "in" / "b"
    for folder in (a, b):
        folder.mkdir(parents=True)
    (a / "1.json").write_text(json.dumps({"metadata": {"category": "c1", "year": "2020"}, "document": [talk("D1", 3), talk("D0", 0)]}))
    (a / "2.json").write_text(json.dumps({"metadata": {"category": "c2", "year": "2021"}, "document": [talk("D1", 1, 9, title="late title", speaker=[{"id": "0", "age": "99"}]), talk("D2", 2)]}))
    (a / "notes.txt").write_text("not a corpus")
    (a / "x.pdf").write_text("x")
    (a / "ignored.zip").write_bytes(b"not opened")
    (b / "s.csv").write_text("doc_id,sentence_id,sentence,date\nS,S.1,Shared one two,20200101\nS,S.2,three,20200101\n")
    (root / "in" / ".hidden").mkdir()
    engine = Engine(spark, f"file://{root}/store")
    return engine, root, engine.store.ingest_folder(f"file://{root}/in")


def test_ingested(spark, stored):
    engine, root, records = stored
    assert [(r["status"], r["file_count"], r["document_count"], r["utterance_count"], r["token_count"]) for r in records] == [("ready", 2, 3, 6, 30), ("ready", 1, 1, 2, 4)]
    a, b = (r["corpus_id"] for r in records)
    assert [r["corpus_id"] for r in engine.corpora().collect()] == [b, a]
    docs = {r["doc_id"]: r for r in engine.store.table("documents").collect()}
    assert docs["D1"]["title"] == "title D1" and docs["D1"]["category"] == "c1" and docs["D0"]["topic"] == "t1"  # the first one counts
    assert engine.store.table("speakers").where("doc_id = 'D1' and speaker_id = '0'").first()["age"] == "20"
    ids = [r["row_id"] for r in engine.store.table("utterances").where(F.col("corpus_id") == a).orderBy("row_id").collect()]
    assert len(set(ids)) == 6 and [r["utterance_id"] for r in engine.store.table("utterances").where(F.col("corpus_id") == a).orderBy("row_id").collect()] == ["D1.1", "D1.2", "D1.3", "D1.9", "D2.1", "D2.2"]
    assert engine.store.ingest(f"file://{root}/in/a")["status"] == "skipped_duplicate"
    with pytest.raises(ValueError, match="not a corpus file"):
        engine.store.ingest(f"file://{root}/in/a/x.pdf")
    with pytest.raises(FileNotFoundError):
        engine.store.ingest(f"file://{root}/none")


def test_tables_are_stored_small(stored):
    _, root, _ = stored
    files = list((root / "store").rglob("*.parquet"))
    assert files and all(f.name.endswith(".zstd.parquet") for f in files)


def test_engine(spark, stored, tmp_path):
    engine, _, records = stored
    a, b = (r["corpus_id"] for r in records)
    page = engine.search(search.Request("shared", limit=4))
    assert page.has_more and [r["hit"] for r in page.rows.collect()] == [["Shared,"]] * 4
    page = engine.search(search.Request('[lemma="word"]', mode="cql", filters=Filters(source="provided", year=("2021",))))
    assert [r["hit"] for r in page.rows.orderBy("row_id").collect()] == [["word9"], ["word1"], ["word2"]]
    stats = engine.stats()
    assert stats["summary"].first().asDict() == {"corpus_count": 2, "document_count": 3, "utterance_count": 8, "speaker_count": 5, "token_count": 28, "non_speech_count": 6}
    assert [tuple(r) for r in stats["token_frequencies"].limit(3).collect()] == [("shared", 7), ("end", 6), ("{laugh}", 6)]
    assert [tuple(r) for r in stats["topic_distribution"].collect()] == [("t1", 3), ("문장 말뭉치", 1)]
    assert [tuple(r) for r in stats["speaker_distribution"].collect()] == [("미상 / 30", 3), ("미상 / 미상", 3), ("F / 20", 2)]
    only = engine.stats(Filters(category=("c2",)))
    assert [tuple(r) for r in only["topic_distribution"].collect()] == [("t1", 3)] and only["summary"].first()["utterance_count"] == 3
    found = engine.collocations("shared", window=1)
    assert found.node_count == 7 and [tuple(r)[:3] for r in found.rows.collect()] == [("end", "right", 6), ("word1", "left", 2), ("word2", "left", 2)]
    tree = [r.asDict(True) for r in engine.explore_tree().collect()]
    assert [t["corpus_id"] for t in tree] == [b, a] and tree[1]["count"] == 3
    assert [(c["category"], c["count"], [x["topic"] for x in c["topics"]]) for c in tree[1]["categories"]] == [("c1", 2, ["t1"]), ("c2", 1, ["t1"])]
    listed = engine.list_documents(a, query="TITLE").collect()
    assert [(r["doc_id"], r["utterance_count"], r["unit_label"]) for r in listed] == [("D0", 0, "발화"), ("D1", 4, "발화"), ("D2", 2, "발화")]
    doc = engine.document(a, "D1", offset=1, limit=2)
    assert (doc.total, doc.has_more, doc.is_dialogue, [s["id"] for s in doc.speakers]) == (4, True, True, ["0", "1"])
    assert [r["utterance_id"] for r in doc.utterances.collect()] == ["D1.9", "D1.2"]
    assert engine.speakers_of(doc) == ["0", "1"]
    for unit in ("utterance", "sentence", "bundle"):
        for by_speaker in (False, True):
            rows = engine.view(doc, unit, by_speaker)
            assert rows.count() > 0 and (not by_speaker or {"0", "1"} <= set(rows.columns))
    with pytest.raises(KeyError):
        engine.document(a, "none")
    state = engine.state()
    assert state["filters"]["year"] == ["2020", "2021"] and sorted(state["filters"]["corpus_id"]) == sorted([a, b]) and state["more"] == []
    short = engine.state(1)
    assert short["filters"]["year"] == ["2020"] and "year" in short["more"]
    out = engine.export_csv(search.Request("word", mode="regex"), f"file://{tmp_path}/f.csv")
    assert out["row_count"] == 6 and (tmp_path / "f.csv").read_bytes().count(b"\r\n") == 7


def test_changes(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    file = tmp_path / "k.json"
    file.write_text(json.dumps({"metadata": {}, "document": [talk("D", 2)]}))
    first = engine.store.ingest(f"file://{file}")
    corpus = first["corpus_id"]
    # a corpus that cannot be read again stays as it was
    file.write_text(json.dumps({"metadata": {}, "document": [talk("D", 2), talk("D", 1)]}))
    assert engine.store.rebuild(corpus)["status"] == "failed"
    assert engine.store.record(corpus)["status"] == "ready" and "twice" in engine.store.record(corpus)["error"] and engine.store.table("utterances").count() == 2
    file.write_text("{")
    with pytest.raises(Exception, match="k.json"):
        engine.store.rebuild(corpus)
    assert engine.store.record(corpus)["status"] == "ready" and engine.store.table("utterances").count() == 2
    file.write_text(json.dumps({"metadata": {}, "document": [talk("D", 5)]}))
    assert engine.store.rebuild(corpus)["utterance_count"] == 5 and engine.store.table("utterances").count() == 5
    engine.store.recount(corpus)
    assert engine.store.table("token_stats").where("term = 'shared'").first()["count"] == 5
    (tmp_path / "e.json").write_text('{"document": [{"id": "E", "utterance": []}]}')
    assert engine.store.ingest(f"file://{tmp_path}/e.json")["status"] == "failed"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("02_a/1. b.json", json.dumps({"document": [talk("Z", 1)]}))
    assert engine.store.ingest(f"file://{tmp_path}/z.zip")["utterance_count"] == 1
    engine.store.delete(corpus)
    assert engine.store.record(corpus) is None and engine.store.table("utterances").count() == 1
    assert engine.store.stopwords()["words"] == []
    assert engine.store.save_stopwords("the, of\nthe 그")["words"] == ["the", "of", "그"] == engine.store.stopwords()["words"]


def test_readers_keep_what_they_read(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    file = tmp_path / "k.json"
    file.write_text(json.dumps({"metadata": {}, "document": [talk("D", 2)]}))
    corpus = engine.store.ingest(f"file://{file}")["corpus_id"]
    frame, pinned = engine.store.table("utterances"), engine.store.pinned()
    old = engine.store.record(corpus)["version"]
    file.write_text(json.dumps({"metadata": {}, "document": [talk("D", 5)]}))
    engine.store.rebuild(corpus)
    assert frame.count() == pinned.table("utterances").count() == 2 and engine.store.table("utterances").count() == 5
    engine.store.delete(corpus)
    assert frame.count() == 2 and engine.store.table("utterances").count() == 0
    assert engine.store.sweep(3600) == [] and frame.count() == 2
    assert (corpus, old) in engine.store.sweep(0) and engine.store._versions(corpus) == []


def test_two_writers(spark, tmp_path):
    """Both corpora are there, states are in one order, and whoever looks sees the same."""
    first, second = (Store(spark, f"file://{tmp_path}/store") for _ in range(2))
    for name in "abcd":
        (tmp_path / f"{name}.json").write_text(json.dumps({"metadata": {}, "document": [talk(name, 3)]}))
    errors = []

    def write(store, paths):
        try:
            for p in paths:
                store.ingest(f"file://{tmp_path}/{p}.json", p)
        except BaseException as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=x) for x in ((first, "abd"), (second, "cbd"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    rows = first.records()
    assert {r["corpus_id"]: r["status"] for r in rows} == dict.fromkeys("abcd", "ready") and rows == second.records() == Store(spark, f"file://{tmp_path}/store").records()
    assert first.table("utterances").count() == 12
    numbers = [r["number"] for r in first.log.history()]
    assert numbers == list(range(1, len(numbers) + 1))


def test_log_of_many_writers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "EACH", 7)
    counted = lambda old: {"k": "x", "n": (old or {"n": 0})["n"] + 1}
    logs = [log.Log(spark, f"file://{tmp_path}/log", "k") for _ in range(4)]
    threads = [threading.Thread(target=lambda one=one: [one.add("x", counted) for _ in range(9)]) for one in logs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert logs[0].refresh()["x"]["n"] == 36  # no writer's step is lost
    logs[0].sweep(-1)
    late = log.Log(spark, f"file://{tmp_path}/log", "k")
    assert late.refresh()["x"]["n"] == 36 and late.last == 36 and late.add("x", counted)["n"] == 37
    assert late.add("x", lambda old: None) is None and len(list((tmp_path / "log").glob("*.json"))) == 3


def test_a_recount_gives_way(spark, tmp_path, monkeypatch):
    store, other = (Store(spark, f"file://{tmp_path}/store") for _ in range(2))
    file = tmp_path / "k.json"
    file.write_text(json.dumps({"metadata": {}, "document": [talk("D", 2)]}))
    corpus = store.ingest(f"file://{file}")["corpus_id"]
    file.write_text(json.dumps({"metadata": {}, "document": [talk("D", 4)]}))
    count = store._count
    monkeypatch.setattr(store, "_count", lambda *a: (other.rebuild(corpus), count(*a))[1])
    store.recount(corpus)
    assert store.table("utterances").count() == 4 and store.record(corpus)["utterance_count"] == 4


def tables(store, corpus):
    """All tables of a corpus but for the index, whose entries follow the parts."""
    out = {}
    for name in SCHEMAS:
        df = store.table(name).where(F.col("corpus_id") == corpus).drop("corpus_id")
        if name == "postings":
            df = df.select("kind", "term", F.explode(F.arrays_zip("rows", "at")).alias("x")).select("kind", "term", "x.*")
        if name == "grams":
            df = df.select("gram", F.explode("blocks").alias("b")).distinct()
        out[name] = sorted(str(r.asDict(True)) for r in df.collect())
    return out


def test_batches_give_the_tables_of_one_ingest(spark, tmp_path):
    folder = tmp_path / "in" / "f"
    folder.mkdir(parents=True)
    store, whole = (Store(spark, f"file://{tmp_path}/{x}") for x in ("store", "whole"))
    documents = [[talk("A", 3)], [talk("B", 2), talk("A", 2, 7, title="late", speaker=[{"id": "9"}])], [talk("C", 1), talk("A", 1, 20)]]
    for k, docs in enumerate(documents):
        (folder / f"{k}.json").write_text(json.dumps({"metadata": {"category": f"c{k % 2}", "year": "2020"}, "document": docs}))
        state = store.follow(f"file://{folder}", "x", f"file://{tmp_path}/check")
        assert state["file_count"] == k + 1 and state["status"] == "ready"
    want = whole.ingest(f"file://{folder}", "x")
    assert tables(store, "x") == tables(whole, "x")
    assert all(state[c] == want[c] for c in ("document_count", "utterance_count", "token_count"))
    assert store.follow(f"file://{folder}", "x", f"file://{tmp_path}/check")["number"] == state["number"]  # nothing new
    records = read_files(spark, f"file://{folder}/2.json")
    store._append({"corpus_id": "x", "name": "x", "source_path": "x"}, records, 2)  # the last batch again
    assert store.record("x")["number"] == state["number"]
    with pytest.raises(ValueError, match="twice"):
        store._append({"corpus_id": "x", "name": "x", "source_path": "x"}, records, 3)
    assert store.record("x")["version"] == state["version"] and tables(store, "x") == tables(whole, "x")
    engine = Engine(spark, f"file://{tmp_path}/store")
    assert [r["utterance_id"] for r in engine.search(search.Request("word7")).rows.collect()] == ["A.7"]
    for request in (search.Request("d, en"), search.Request("word\\d+ Sha", mode="regex"), search.Request('[text="shared"] [text="end"]', mode="cql")):  # in all parts
        assert engine.search(request).rows.count() == state["utterance_count"], request
    store.recount("x")
    assert tables(store, "x") == tables(whole, "x") and "+" not in store.record("x")["version"]
    assert len(store.sweep(0)) == 3 and tables(store, "x") == tables(whole, "x")


def test_entries_of_an_archive_are_dealt_to_tasks(spark, tmp_path):
    for form in ("zip", "plain"):
        (tmp_path / form).mkdir()
    with zipfile.ZipFile(tmp_path / "zip" / "z.zip", "w") as z:
        for k in range(30):
            text = json.dumps({"document": [talk(f"D{k}", k % 4)]})
            z.writestr(f"{k:02}.json", text)
            (tmp_path / "plain" / f"{k:02}.json").write_text(text)
    got, want = (read_files(spark, f"file://{tmp_path}/{x}", True).select("nth", "document.doc_id", "utterance.utterance_id", "utterance.form").collect() for x in ("zip/z.zip", "plain"))
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 60
    entries = read_files(spark, f"file://{tmp_path}/zip/z.zip", True)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert entries.select(F.spark_partition_id().alias("p")).distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_are_numbered_by_file_and_place(spark):
    rows = [(f"f{k:02}", e, n, {"form": f"{k}.{e}.{n}"}) for k in range(40) for e in range(2) for n in range(k % 3)]
    records = spark.createDataFrame([(f, e, n, json.dumps(u)) for f, e, n, u in rows], "file string, entry long, nth long, u string").select("file", "entry", "nth", F.from_json("u", "form string").alias("utterance")).repartition(7)
    got = numbered(records, 100)
    assert [(r["row_id"], r["form"]) for r in got.orderBy("row_id").collect()] == [(101 + k, u["form"]) for k, (*_, u) in enumerate(rows)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(part" in plan and numbered(records.limit(0)).count() == 0


def test_empty_store(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    assert engine.corpora().count() == 0 and engine.explore_tree().count() == 0 and engine.state()["corpora"] == []
    assert engine.stats()["summary"].first()["token_count"] == 0 and engine.search(search.Request("abc")).rows.count() == 0
    assert engine.collocations("a").rows.count() == 0 and engine.list_documents("x").count() == 0


def test_jobs(spark):
    jobs, told = Jobs(spark), []
    jobs.listen(lambda p: told.append((p.job_id, p.status)))
    assert jobs.submit("count", lambda: spark.range(100).count()).result(60) == 100
    bad = jobs.submit("count", lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        bad.result(60)
    started = threading.Event()

    def slow():
        started.set()
        return spark.range(4).select(F.expr("java_method('java.lang.Thread', 'sleep', cast(60000 as bigint))")).collect()

    job, waiting = jobs.submit("slow", slow), jobs.submit("slow", lambda: 1)
    started.wait(30)
    time.sleep(1)
    assert {p.status for p in jobs.current()} == {"running", "queued"}
    jobs.cancel()
    for j in (job, waiting):
        with pytest.raises(Exception):  # noqa: B017
            j.result(60)
    assert [j.state().status for j in (bad, job, waiting)] == [FAILED, CANCELLED, CANCELLED] and told[2][1] == DONE
