"""Stored corpora: Parquet tables by corpus and version, and a catalog that says which version of a corpus counts.

A corpus is written whole into a folder of its own version; it is published by one more entry of the catalog's log, so readers see the
old one or the new one, and a failure leaves the old one as it was. Old versions stay until they are swept, so frames that read them do
not break meanwhile.
"""

from __future__ import annotations

import hashlib
import re
import time
import unicodedata
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import legacy_hangul
from ..operators.lookup import Index
from ..scratch import filesystem, new_folder, remove
from . import formats, names
from .log import Log
from . import index as indexed
from .tables import SCHEMAS, counted_terms, derived, merged, tokenised

GIVEN = "array<struct<surface:string,lemma:string,pos:string>>"
_BARE = "doc_id string, utterance_id string, speaker_id string, sequence long, form string, original_form string, time string, start double, end double, note string, category string, topic string, year string, speaker_age string, speaker_sex string, speaker_occupation string, metadata string"


def _struct(fields: str) -> str:
    return "struct<" + re.sub(r"(\w+) (\w+)", r"\1:\2", fields).replace(" ", "") + ">"


#: A record of a file: where it stands, and one of the three.
RECORD = f"file string, entry long, nth long, document {_struct(SCHEMAS['documents'])}, speaker {_struct(SCHEMAS['speakers'])}, utterance {_struct(_BARE)[:-1]},provided:{GIVEN}>"
CATALOG = "corpus_id string, name string, source_path string, status string, imported_at double, version string, file_count long, document_count long, utterance_count long, token_count long, error string"
BATCH = 2000
#: Bytes of a parsing task, about, and files.
TASK_BYTES, TASK_FILES = 32 << 20, 1000
#: Rows of a page of those tables that are looked up by key.
PAGE_ROWS = {"utterances": 1000, "postings": 200, "grams": 200}


def corpus_id_of(path: str) -> str:
    """A corpus's id: its name's letters and numbers, and a digest of its path."""
    slug = re.sub("^-|-$", "", re.sub(r"[\W_]+", "-", unicodedata.normalize("NFKC", names.display_name(formats.stem(path)))))[:48]
    return f"{slug or 'corpus'}-{hashlib.sha1(path.encode()).hexdigest()[:8]}"


def read_files(spark: SparkSession, path: str, asked: bool = False) -> DataFrame:
    """The records of all corpus files under a path, ``entry`` and ``nth`` in the order of a file; each task parses whole files or
    entries of archives, and gives their records in batches. A file is read by Spark, so it may have 2 GB at most; Spark raises an error for larger ones."""
    fs, at = filesystem(spark, path)
    found = fs.getContentSummary(at)
    # Spark counts 4 MB for opening a file, so many short files would make a task, and a stored part, for every thirty
    tasks = max(spark.sparkContext.defaultParallelism, found.getLength() // TASK_BYTES, found.getFileCount() // TASK_FILES)
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).coalesce(tasks), path, asked)


def parsed(files: DataFrame, path: str, asked: bool = False) -> DataFrame:
    """The records of binary files under a path."""
    spark = files.sparkSession
    # of a folder's archives only those are opened whose paths ask for it, as of archives within one
    gate = F.lit(asked) | F.col("path").rlike(formats.OPENED)
    wanted = F.lower("path").rlike(r"\.(json|csv|tsv|xml|txt)$") | (F.lower("path").endswith(".zip") & gate)
    files = files.where(wanted & ~F.col("path").rlike(r"/[._][^/]*$")).select("path", "content")
    schema = StructType.fromDDL(RECORD)
    arrow = to_arrow_schema(schema)
    # files are named from the folder that holds ``path``, so names mean the same wherever a corpus lies
    fs, at = filesystem(spark, path)
    root = fs.getFileStatus(at).getPath().getParent().toString().rstrip("/") + "/"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each entry of each archive, one entry at a time."""
        for batch in batches:
            for full, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for entry, (inner, data) in enumerate(formats.entries(full.removeprefix(root), content.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([inner]), pa.array([entry], pa.int64()), pa.array([data], pa.binary())], ["file", "entry", "content"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []  # of several files, where they are short
        for batch in batches:
            for inner, entry, content in zip(batch.column("file").to_pylist(), batch.column("entry").to_pylist(), batch.column("content"), strict=True):
                for nth, (kind, values) in enumerate(formats.parse(inner.removeprefix(root), content.as_py(), asked)):
                    rows.append({"file": inner.removeprefix(root), "entry": entry, "nth": nth, kind: values})
                    if len(rows) == BATCH:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    zipped = F.lower("path").endswith(".zip")
    alone = files.where(~zipped).select(F.col("path").alias("file"), F.lit(0).cast("long").alias("entry"), "content")
    # an archive is unpacked by one task, and its entries are dealt to all: parsing costs far more
    entries = files.where(zipped).mapInArrow(unpack, "file string, entry long, content binary").repartition("file", "entry")
    return alone.union(entries).mapInArrow(parse, schema)


#: Files up to which their starts are sent to all tasks, some 100 bytes each; beyond they are joined by shuffle.
SENT_FILES = 100_000


def numbered(records: DataFrame, after: int = 0) -> DataFrame:
    """Utterances with ``row_id``, their place in the corpus: by file, then by their order in it, from ``after`` on.

    The files' starts come from one count for each file: ranges of files are summed, and each range then adds up its own files.
    """
    spark = records.sparkSession
    rows = records.where(F.col("utterance").isNotNull())
    spans = rows.groupBy("file", "entry").agg((F.max("nth") + 1).alias("span")).repartitionByRange("file", "entry").withColumn("part", F.spark_partition_id())
    folder = new_folder(spark)
    spans.write.parquet(f"{folder}/spans")  # the ranges are drawn by sampling, so they are kept
    spans = spark.read.parquet(f"{folder}/spans")
    files, offsets, start = 0, [], after
    for r in sorted(spans.groupBy("part").agg(F.sum("span").alias("span"), F.count(F.lit(1)).alias("files")).collect()):
        offsets.append((r["part"], start))
        start, files = start + r["span"], files + r["files"]
    ranges = F.broadcast(spark.createDataFrame(offsets, "of_part int, offset long"))
    running = F.sum("span").over(W.partitionBy("part").orderBy("file", "entry").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("span")
    starts = spans.join(ranges, F.col("part") == F.col("of_part")).select(F.col("file").alias("of"), F.col("entry").alias("at"), (F.col("offset") + running).alias("start"))
    joined = rows.join(F.broadcast(starts) if files <= SENT_FILES else starts, (F.col("file") == F.col("of")) & (F.col("entry") == F.col("at")))
    return joined.select((F.col("start") + F.col("nth") + 1).alias("row_id"), "utterance.*")


def firsts(records: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """The documents or speakers; of those with the same keys the first one counts."""
    rows = records.where(F.col(kind).isNotNull())
    one = rows.groupBy(*(F.col(f"{kind}.{k}") for k in keys)).agg(F.min_by(kind, F.struct("file", "entry", "nth")).alias("x"))
    return one.select("x.*")


#: Tables to which a batch adds rows; the others are counts, which a batch replaces. A version is named by its parts, joined by "+".
GROWING = ("utterances", "documents", "speakers", "postings", "grams")
#: What stays of a state when only the error or the version changes.
KEPT = ("corpus_id", "name", "source_path", "version", "file_count", "document_count", "utterance_count", "token_count", "batch")


def _state(**values) -> dict:
    """A row of the catalog."""
    blank = {"file_count": 0, "document_count": 0, "utterance_count": 0, "token_count": 0, "error": None, "version": None, "batch": None}
    return blank | values | {"imported_at": time.time()}


class Store:
    """Corpora under one folder. Driver-side lists are of corpora, never of what they hold."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = Log(spark, f"{self.folder}/catalog", "corpus_id")
        self._pinned: list[dict] | None = None

    # ---- catalog

    def records(self) -> list[dict]:
        """The last state of each corpus, latest first, with its display name, format and unit label."""
        if self._pinned is not None:
            return [dict(r) for r in self._pinned]
        rows = sorted((dict(r) for r in self.log.refresh().values() if r["status"] != "deleted"), key=lambda r: -r["number"])
        for r in rows:
            r["source_format"] = names.format_of(r["name"], r["source_path"])
            r["name"], r["unit_label"] = names.display_name(r["name"], r["source_path"]), names.unit_label(r["source_format"])
        return rows

    def pinned(self) -> Store:
        """This store as it is now: what it reads stays the same whatever is published later, until old versions are swept."""
        other = Store(self.spark, self.folder)
        other._pinned = self.records()
        return other

    def catalog(self) -> DataFrame:
        """The records as a table."""
        fields = StructType.fromDDL(f"{CATALOG}, source_format string, unit_label string").fieldNames()
        return self.spark.createDataFrame([tuple(r[f] for f in fields) for r in self.records()], f"{CATALOG}, source_format string, unit_label string").orderBy(F.desc("imported_at"))

    def record(self, corpus_id: str) -> dict | None:
        return next((r for r in self.records() if r["corpus_id"] == corpus_id), None)

    def note(self, **values) -> dict:
        """Add a state of a corpus to the catalog."""
        return self.log.add(values["corpus_id"], lambda _: _state(**values))

    # ---- tables

    def _where(self, table: str, corpus_id: str, version: str) -> str:
        return f"{self.folder}/{table}/corpus_id={corpus_id}/version={version}"

    def table(self, name: str, corpora: list[tuple[str, str]] | None = None) -> DataFrame:
        """A table of all ready corpora (or of given corpora and versions), with the column corpus_id, by which scans are pruned."""
        if corpora is None:
            corpora = [(r["corpus_id"], r["version"]) for r in self.records() if r["status"] == "ready"]
        schema = f"{SCHEMAS[name]}, corpus_id string, version string"
        corpora = [(c, v) for c, parts in corpora for v in (parts.split("+") if name in GROWING else parts.split("+")[-1:])]
        if not corpora:
            rows = self.spark.createDataFrame([], schema)
        else:
            rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*(self._where(name, c, v) for c, v in corpora))
        return rows.select("corpus_id", *(f for f in rows.columns if f not in ("corpus_id", "version")))

    def _write(self, rows: DataFrame, table: str, corpus_id: str, version: str) -> DataFrame:
        fields = StructType.fromDDL(SCHEMAS[table]).fieldNames()
        path = self._where(table, corpus_id, version)
        # short pages, so that a look-up of some rows reads few others
        rows.select(*fields).write.mode("overwrite").option("compression", "zstd").option("parquet.page.row.count.limit", PAGE_ROWS.get(table, 20_000)).parquet(path)
        return self.spark.read.schema(SCHEMAS[table]).parquet(path)

    def together(self, *calls):
        """Results of calls that run beside each other, as many of them are too small to keep a cluster busy; they belong to the caller's job."""
        with ThreadPoolExecutor(len(calls)) as pool:
            return [f.result() for f in [pool.submit(inheritable_thread_target(self.spark)(c)) for c in calls]]

    def write(self, corpus_id: str, version: str, utterances: DataFrame, documents: DataFrame, speakers: DataFrame, before: dict[str, DataFrame] | None = None) -> dict:
        """Write a version of a corpus, or a part of it, with its counted tables; returns counts and the error, if it cannot be published.

        Utterances have all stored columns but tokens; ``provided`` has the tokens as the source gives them. ``before`` has the tables of
        the parts before, whose counts are merged in.
        """
        for c in ("title", "author", "publisher", "topic", "category"):
            documents = documents.withColumn(c, legacy_hangul(F.col(c)))
        for c in ("topic", "category"):
            utterances = utterances.withColumn(c, legacy_hangul(F.col(c)))
        rows, docs, _ = self.together(
            lambda: self._write(tokenised(utterances).sortWithinPartitions("row_id"), "utterances", corpus_id, version),
            lambda: self._write(documents, "documents", corpus_id, version),
            lambda: self._write(speakers, "speakers", corpus_id, version),
        )
        total = F.coalesce(F.sum(F.size("tokens.normalized") + F.size("provided.normalized")), F.lit(0)).alias("token_count")
        counts = rows.agg(F.count(F.lit(1)).alias("utterance_count"), total, F.coalesce(F.max("row_id"), F.lit(0)).alias("last")).first().asDict()
        twice_in = rows.groupBy("utterance_id").count()
        if before:
            known = before["utterances"].join(F.broadcast(rows.select("utterance_id")) if counts["utterance_count"] < SENT_FILES else rows.select("utterance_id"), "utterance_id", "left_semi")
            twice_in = twice_in.union(known.select("utterance_id", F.lit(2).cast("long")))
        documents, twice, *_ = self.together(
            docs.count,
            twice_in.where("count > 1").limit(1).collect,
            *self._count(rows, docs, counts["token_count"], counts.pop("last"), corpus_id, version, before),
        )
        counts["document_count"] = documents
        error = f"{counts['document_count']} documents without any utterance" if counts["document_count"] and not counts["utterance_count"] else None
        return counts | {"error": f"utterance id {twice[0][0]!r} occurs twice" if twice else error}

    def _count(self, rows: DataFrame, docs: DataFrame, tokens: int, last_row: int, corpus_id: str, version: str, before: dict[str, DataFrame] | None = None) -> list:
        """Calls that write the counted tables and the search index."""

        def counted(name: str, table: DataFrame) -> None:
            self._write(merged(name, table, before, rows) if before else table, name, corpus_id, version)

        def terms() -> None:
            written = self._write(indexed.postings(rows, tokens, last_row), "postings", corpus_id, version)
            counted("token_stats", counted_terms(written))

        grams = lambda: self._write(indexed.grams(rows), "grams", corpus_id, version)
        return [terms, grams, *(lambda n=n, t=t: counted(n, t) for n, t in derived(rows, docs).items())]

    def index(self) -> Index:
        """The search index of all ready corpora."""
        return Index(self.table("token_stats"), self.table("postings"), self.table("grams"))

    def publish(self, described: dict, utterances: DataFrame, documents: DataFrame, speakers: DataFrame, file_count: int = 0) -> dict:
        """Write a corpus and make it the one that counts; if it cannot be, the one before stays and the catalog has the error."""
        corpus_id, version = described["corpus_id"], f"v{time.time_ns()}"
        try:
            found = self.write(corpus_id, version, utterances, documents, speakers)
        except BaseException as e:
            self._drop(corpus_id, [version])
            stopped = isinstance(e, KeyboardInterrupt) or "cancelled" in str(e).lower()
            self._fail(described, "cancelled" if stopped else "failed", str(e)[:500])
            raise
        if found["error"]:
            self._drop(corpus_id, [version])
            return self._fail(described, "failed", found["error"], file_count=file_count, **{k: v for k, v in found.items() if k != "error"})
        return self.note(**described, status="ready", version=version, file_count=file_count, **found)

    def _fail(self, described: dict, status: str, error: str, **counts) -> dict:
        """A failed attempt on a corpus that is ready leaves it ready, with the error beside it."""

        def state(old: dict | None) -> dict:
            if old and old["version"]:
                return _state(**{k: old[k] for k in KEPT}, status="ready", error=error)
            return _state(**described, status=status, error=error, **counts)

        return self.log.add(described["corpus_id"], state) | described | counts | {"status": status, "error": error}

    def _versions(self, corpus_id: str) -> list[str]:
        fs, path = filesystem(self.spark, f"{self.folder}/utterances/corpus_id={corpus_id}")
        return [s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(path)] if fs.exists(path) else []

    def _drop(self, corpus_id: str, versions: list[str]) -> None:
        for v in versions:
            for table in SCHEMAS:
                remove(self.spark, self._where(table, corpus_id, v))

    # ---- corpora

    def _known(self, path: str, name: str) -> dict | None:
        """The ready corpus with utterances that was read from this path, or is the same corpus from another one."""
        same = lambda p: re.sub(r"[\\/]+", "/", p).lower()
        key = names.corpus_key(name, path)
        usable = [r for r in self.records() if r["status"] == "ready" and r["utterance_count"] > 0]
        return next((r for r in usable if same(r["source_path"]) == same(path) or names.corpus_key(r["name"], r["source_path"]) == key), None)

    def ingest(self, path: str, corpus_id: str | None = None, name: str | None = None) -> dict:
        """Read a file, an archive or a folder, and publish it as a corpus.

        A source that is ready already (by its path, or as the same corpus from another place) is not read again, nor are messenger
        tables beside messenger JSON; both give a record ``skipped_duplicate``. An utterance id that occurs twice, or documents
        without any utterance, fail the corpus. A path that is a file of an unknown kind raises ValueError.
        """
        fs, at = filesystem(self.spark, path)
        if not fs.exists(at):
            raise FileNotFoundError(path)
        asked = not fs.getFileStatus(at).isDirectory()
        if asked and not path.lower().endswith((*formats.SUFFIXES, ".zip")):
            raise ValueError(f"{path}: not a corpus file")
        name = name or names.display_name(formats.stem(path))
        if corpus_id is None:
            if known := self._known(path, name):
                return known | {"status": "skipped_duplicate"}
            ready = [r for r in self.records() if r["status"] == "ready" and r["utterance_count"] > 0]
            if names.is_messenger_csv(path) and any("messenger_v2.0_json" in f"{r['name']} {r['source_path']}".lower() for r in ready):
                return {"corpus_id": corpus_id_of(path), "name": name, "source_path": path, "status": "skipped_duplicate", "utterance_count": 0, "error": "the same corpus is there as JSON"}
        corpus_id = corpus_id or corpus_id_of(path)
        described = {"corpus_id": corpus_id, "name": name, "source_path": path}
        staged = f"{self.folder}/staging/{corpus_id}-{time.time_ns()}"
        if not (self.record(corpus_id) or {}).get("version"):
            self.note(**described, status="running")
        try:
            read_files(self.spark, path, asked).write.parquet(staged)
            records = self.spark.read.schema(RECORD).parquet(staged)
            files = records.select("file", "entry").distinct().count()
            return self.publish(described, numbered(records), firsts(records, "document", ["doc_id"]), firsts(records, "speaker", ["doc_id", "speaker_id"]), files)
        except Exception as e:
            last = self.record(corpus_id)
            if last and last["status"] == "running":
                self._fail(described, "cancelled" if "cancelled" in str(e).lower() else "failed", str(e)[:500])
            raise
        finally:
            remove(self.spark, staged)

    def follow(self, folder: str, corpus_id: str, checkpoint: str, name: str | None = None, files_at_once: int = 1000) -> dict | None:
        """Add the files of a folder that were not there at the last call to a corpus, some at once; returns its state.

        The checkpoint remembers the files. Each batch adds its rows as a part of its own, and its counts are merged into the counted tables,
        which costs as much as they and the batch have, not the corpus. A batch that is played again changes nothing. Rows are numbered
        on in the order of arrival; of documents and speakers the first one counts; an utterance id that is there already is an error, and the
        corpus stays as it was.
        """
        files = self.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_at_once).load(folder)
        described = {"corpus_id": corpus_id, "name": name or corpus_id, "source_path": folder}
        stream = files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, n: self._append(described, parsed(rows, folder), n))
        stream.start().awaitTermination()
        return self.record(corpus_id)

    def _append(self, described: dict, batch: DataFrame, number: int) -> None:
        """Publish a batch of records as a further part of a corpus."""
        corpus_id = described["corpus_id"]
        staged = f"{self.folder}/staging/{corpus_id}-{time.time_ns()}"
        try:
            batch.write.parquet(staged)
            records = self.spark.read.schema(RECORD).parquet(staged)
            done = False
            while not done:
                old = self.log.refresh().get(corpus_id)
                old = old if old and old["status"] != "deleted" and old["version"] else None
                if old and old["batch"] is not None and old["batch"] >= number:
                    return
                done = self._append_to(old, described, records, number)
        finally:
            remove(self.spark, staged)

    def _append_to(self, old: dict | None, described: dict, records: DataFrame, number: int) -> bool:
        """False if the corpus has another version by now."""
        corpus_id, version = described["corpus_id"], f"v{time.time_ns()}"
        at = [(corpus_id, old["version"])] if old else []
        before = {t: self.table(t, at).drop("corpus_id") for t in SCHEMAS}
        new = lambda rows, t, keys: rows.join(before[t].select(*keys), keys, "left_anti") if old else rows
        last = before["utterances"].agg(F.coalesce(F.max("row_id"), F.lit(0))).first()[0] if old else 0
        documents = new(firsts(records, "document", ["doc_id"]), "documents", ["doc_id"])
        speakers = new(firsts(records, "speaker", ["doc_id", "speaker_id"]), "speakers", ["doc_id", "speaker_id"])
        found = self.write(corpus_id, version, numbered(records, last), documents, speakers, before if old else None)
        files = records.select("file", "entry").distinct().count()

        def state(now: dict | None) -> dict | None:
            current = now["version"] if now and now["status"] != "deleted" else None
            if current != (old["version"] if old else None):
                return None
            counts = {k: found[k] + (old[k] if old else 0) for k in ("document_count", "utterance_count", "token_count")}
            parts = f"{current}+{version}" if current else version
            return _state(**described, **counts, file_count=files + (old["file_count"] if old else 0), status="ready", version=parts, batch=number)

        if found["error"]:
            self._drop(corpus_id, [version])
            self._fail(described, "failed", found["error"])
            raise ValueError(found["error"])
        if self.log.add(corpus_id, state) is None:
            self._drop(corpus_id, [version])
            return False
        return True

    def ingest_all(self, paths: list[str]) -> list[dict]:
        """Several sources one after the other; an error ends the list, as the states of all before it are in the catalog."""
        return [self.ingest(p) for p in paths]

    def ingest_folder(self, folder: str) -> list[dict]:
        """Each child of a folder as a corpus of its own, but for hidden ones and sources that another child holds better."""
        fs, path = filesystem(self.spark, folder)
        children = sorted(s.getPath().toString() for s in fs.listStatus(path) if not s.getPath().getName().startswith("."))
        return self.ingest_all(names.without_repeated(children))

    def delete(self, corpus_id: str) -> None:
        """Take a corpus out of the catalog; its files go when they are swept."""
        self.note(corpus_id=corpus_id, name="", source_path="", status="deleted")

    def sweep(self, keep: float = 7 * 86_400) -> list[tuple[str, str]]:
        """Delete versions that have not counted for ``keep`` seconds, and what writers left that old; returns (corpus, version).

        ``keep`` must be longer than any reader needs a frame, and any writer to write a corpus.
        """
        self.log.refresh()
        states, before = self.log._states, time.time() - keep
        until: dict[tuple[str, str], float] = {}
        last: dict[str, set[str]] = {}
        for row in self.log.history():  # a version counts until the entry that names another one
            c = row["corpus_id"]
            parts = set((row["version"] or "").split("+"))
            until |= {(c, v): row["imported_at"] for v in last.get(c, set()) - parts}
            last[c] = parts
        fs, path = filesystem(self.spark, f"{self.folder}/utterances")
        corpora = [s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(path)] if fs.exists(path) else []
        gone = []
        for c in corpora:
            for v in self._versions(c):
                if v not in (states.get(c, {}).get("version") or "").split("+") and until.get((c, v), int(v[1:]) / 1e9) <= before:
                    self._drop(c, [v])
                    gone.append((c, v))
        fs, path = filesystem(self.spark, f"{self.folder}/staging")
        for s in fs.listStatus(path) if fs.exists(path) else []:
            if s.getModificationTime() / 1000 <= before:
                remove(self.spark, s.getPath().toString())
        self.log.sweep(keep)
        return gone

    def rebuild(self, corpus_id: str) -> dict:
        """Read a corpus again from where it came."""
        if not (old := self.record(corpus_id)):
            raise KeyError(corpus_id)
        return self.ingest(old["source_path"], corpus_id, old["name"])

    def recount(self, corpus_id: str) -> None:
        """Make the counted tables of a corpus anew from what is stored, under a new version of it."""
        old = self.record(corpus_id)
        at = [(corpus_id, old["version"])]
        utterances, documents = self.table("utterances", at), self.table("documents", at)
        version = f"v{time.time_ns()}"
        for name in ("utterances", "documents", "speakers"):
            self._write(self.table(name, at), name, corpus_id, version)
        last = utterances.agg(F.coalesce(F.max("row_id"), F.lit(0))).first()[0]
        self.together(*self._count(utterances.drop("corpus_id"), documents.drop("corpus_id"), old["token_count"], last, corpus_id, version))

        def state(now: dict | None) -> dict | None:
            # whoever published in the meantime has counted anew
            return _state(**{k: now[k] for k in KEPT if k != "version"}, status="ready", version=version) if now and now["version"] == old["version"] else None

        if self.log.add(corpus_id, state) is None:
            self._drop(corpus_id, [version])

    # ---- stopwords

    def stopwords(self) -> dict:
        """path, text and words of the stopword file; without one they are empty."""
        fs, path = filesystem(self.spark, f"{self.folder}/stopwords.txt")
        text = "".join(r[0] for r in self.spark.read.text(f"{self.folder}/stopwords.txt", wholetext=True).collect()) if fs.exists(path) else ""
        return {"path": f"{self.folder}/stopwords.txt", "text": text, "words": list(dict.fromkeys(w for w in re.split(r"[,\s]+", text) if w))}

    def save_stopwords(self, text: str) -> dict:
        fs, path = filesystem(self.spark, f"{self.folder}/stopwords.txt")
        out = fs.create(path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return self.stopwords()
