"""Times the headline queries; prints one JSON line.

Each query is written to the noop sink: once to warm up, then RUNS times, and the median
counts. `rates` has MiB of object bytes a second for scans and digests a second for lookups.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sievework.plans import catalogue

RUNS = int(os.environ.get("BENCH_RUNS", "3"))
SCANS = ("object_digests", "body_literal", "body_automaton", "body_wildcards", "logical_match", "verdict")
LOOKUPS = ("hash_match", "digest_lookup_batch", "digest_precedence")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    size = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    took = {}
    for name in SCANS + LOOKUPS:
        times = []
        for _ in range(1 + RUNS):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    rates = {f"{n}_mib_s": round(size.b / took[n] / 2**20, 1) for n in SCANS} | {f"{n}_per_s": round(size.n / took[n]) for n in LOOKUPS}
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rates": rates, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
