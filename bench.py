"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) holds the tables, BENCH_CPUS (default 8) is the number of threads. Each
query runs once to warm up and BENCH_RUNS times (default 2) into a sink that keeps nothing; the least time counts.
files_per_sec is what extraction and chunking make of `documents`, container_files_per_sec what the RTF lane does.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = ("extract_paragraphs", "section_chunks", "paragraph_chunks", "deterministic_ids", "lane_admission", "shard_plan", "receipt_reconcile", "run_states", "cache_lookup", "file_metrics", "change_detect", "manifest_edges", "claim_scores", "claim_decisions", "claim_episodes", "queue_report", "watch_sessions", "latest_manifest")


def main() -> None:
    sf, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "2"))
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g", "spark.sql.files.maxPartitionBytes": "4m"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    from tessera.plans import queries
    from tessera.sources.containers import container_blocks

    def timed(make) -> float:
        best = float("inf")
        for k in range(runs + 1):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began) if k else best
        return best

    took = {name: round(timed(lambda f=queries.QUERIES[name]: f(spark, sf)), 3) for name in HEADLINE}
    files = spark.read.parquet(f"{sf}/documents.parquet").count()
    rtf = F.encode(F.concat(F.lit("{\\rtf1{\\fonttbl{\\f0 Arial;}}First paragraph of "), F.col("id").cast("string"), F.lit("\\par Second\\par Third\\par}")), "UTF-8")
    made = spark.range(20_000, numPartitions=int(cpus)).select(F.col("id").cast("string").alias("path"), F.lit("rtf_text").alias("lane"), rtf.alias("content"))
    lane = timed(lambda: container_blocks(made))
    print(json.dumps({"metric": "headline queries, total of least times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "files_per_sec": round(files / took["paragraph_chunks"], 1), "container_files_per_sec": round(20_000 / lane, 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
