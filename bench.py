"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the tables. BENCH_CPUS: cores. BENCH_RUNS: warm runs per
query, of which the median counts. BENCH_QUERIES: comma-separated names.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from pageloom.operators import lookup
from pageloom.plans import queries
from pageloom.plans.queries import QUERIES
from pageloom.scratch import clear_scratch

HEADLINE = [
    "word_page_frequency",
    "bigram_page_frequency",
    "trigram_page_frequency",
    "page_word_percentage",
    "shared_bigram_top10",
    "shared_trigram_top10",
    "page_connectivity",
    "shared_link_pairs",
    "word_frequency_in_links",
    "bfs_depth3",
    "top_pages_by_word",
    "analysis_tables",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pageloom-bench")
        .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_PARTITIONS", "24"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp())
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    taken = time.perf_counter() - started
    clear_scratch(spark)
    return taken


def lookup_seconds(spark: SparkSession, sf_dir: str, runs: int) -> float:
    """The lookup of pages by word alone, on tables that are stored already."""
    tables = queries._word_tables(spark, sf_dir)
    word = queries._common_word(tables)
    times = []
    for _ in range(runs + 1):
        started = time.perf_counter()
        lookup.top_pages_by_word(tables, word).collect()
        times.append(time.perf_counter() - started)
    clear_scratch(spark)
    return statistics.median(times[1:])


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = session(cpus)
    seconds(spark, "word_totals", sf_dir)
    times = {}
    for name in names:
        taken = [seconds(spark, name, sf_dir) for _ in range(runs)]
        times[name] = round(statistics.median(taken), 3)
        print(name, [round(t, 2) for t in taken], file=sys.stderr, flush=True)
    alone = {} if chosen else {"top_pages_by_word": round(lookup_seconds(spark, sf_dir, runs), 3)}
    spark.stop()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/"))
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": times, "lookup_alone": alone, "sf": sf, "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
