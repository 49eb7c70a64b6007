"""Headline queries, timed.  Prints one JSON line.

Every query runs on the whole tables of ``$BENCH_SF_DIR`` and is drained with a noop
sink; the second of two runs counts, the first (cold) one is reported beside it.  The
tables come as single files of one row group, which Spark reads in one task however many
cores there are; so the large ones are copied once, before any timing, into one file per
core, which is how a table of any size lies on a cluster.  With each time go the jobs that
ran while the plan was built, rows out, rows out per second and MB written to shuffles.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

HEADLINE = (
    "search_and_or", "search_stemmed", "recall_bench", "tokenize_index", "resolve_refs", "gold_set", "title_repair", "citation_graph",
    "pool_topn", "coupling_score", "coupling_edges", "sections", "links", "grounding_ratio", "style_metrics", "call_dist",
    "percentile_linear", "running_seq", "run_state_fold", "relevance_select", "results_rows",
)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
          "labels", "conversations")


def split_tables(spark, sf_dir: str, files: int) -> str:
    """A copy of the tables, those of over a thousand rows in ``files`` files."""
    folder = tempfile.mkdtemp(prefix="bench-tables-")
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            (df.repartition(files) if df.count() > 1000 else df).write.parquet(f"{folder}/{name}.parquet")
    return folder


def shuffled(spark) -> float:
    """MB that all executors have written to shuffles so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size())) / 1e6


def main() -> None:
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    from sparkfolio.plans import all_queries
    from sparkfolio.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "20g", "spark.sql.files.openCostInBytes": "64k"})
    spark.sparkContext.setLogLevel("ERROR")
    tracker = spark.sparkContext.statusTracker()
    tables = split_tables(spark, sf_dir, int(cpus))
    queries = all_queries()
    only = os.environ.get("BENCH_ONLY")
    names = only.split(",") if only else HEADLINE
    warm, cold, figures = {}, {}, {}
    for name in names:
        for times in (cold, warm):
            jobs, moved, rows = len(tracker.getJobIdsForGroup(None)), shuffled(spark), Observation()
            started = time.perf_counter()
            df = queries[name](spark, tables)
            at_build = len(tracker.getJobIdsForGroup(None)) - jobs
            df.observe(rows, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
            n = rows.get["n"]
            figures[name] = {"jobs_at_build": at_build, "rows": n, "rows_per_sec": round(n / times[name], 1), "shuffle_mb": round(shuffled(spark) - moved, 2)}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
                      "cold": cold, "figures": figures, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
