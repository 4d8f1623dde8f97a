"""Times the headline queries and prints one JSON line; each query's times go to stderr as soon as it is done.

``ingest`` is the writing of the tables into the store with all that is counted from them; the queries read the store. DuckDB runs each
query's SQL on the tables themselves, as it has no store to read.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from lexispark.plans.adapter import corpus
from lexispark.plans.queries import ORACLES, QUERIES

NAMES = [
    "token_frequency", "explore_tree", "list_documents", "search_exact_token", "search_substring", "search_regex", "cql_distance", "collocation_raw", "collocation_filtered", "stats_summary",
    "stats_summary_filtered", "sentence_merge", "bundle_merge", "csv_export",
]
#: Seconds after which no query is run more than once.
PATIENCE = 400
TABLES = ("documents", "conversations", "pages", "benchmark", "labels")


def timed(call) -> float:
    start = time.perf_counter()
    call()
    return time.perf_counter() - start


def duckdb_times(sf_dir: str, cpus: str) -> dict[str, float]:
    try:
        import duckdb
    except ImportError:
        return {}
    con = duckdb.connect(config={"threads": int(cpus)})
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return {n: round(timed(lambda n=n: con.execute(ORACLES[n]).fetchall()), 3) for n in NAMES if n in ORACLES}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    begun = time.perf_counter()
    seconds = {"ingest": round(timed(lambda: corpus(spark, sf_dir)), 3)}
    print(f"ingest {seconds['ingest']}", file=sys.stderr, flush=True)
    for name in NAMES:
        run = lambda name=name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times = [timed(run)]
        while len(times) < 4 and time.perf_counter() - begun < PATIENCE:  # the first warms up
            times.append(timed(run))
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        print(f"{name} {seconds[name]} of {[round(t, 2) for t in times]}", file=sys.stderr, flush=True)
    line = {"metric": "ingest and total of median query times", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}
    spark.stop()
    print(json.dumps(line | {"duckdb": duckdb_times(sf_dir, cpus)}), flush=True)


if __name__ == "__main__":
    main()
