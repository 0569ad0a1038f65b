"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import time

from quillrank import registry
from quillrank.session import local_session

HEADLINE = ["rank_remedies", "hybrid_search", "clinical_match", "rate_limit", "validate_requests"]


def timed(query, spark, sf: str) -> float:
    start = time.perf_counter()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    registry.load_all()
    spark = local_session(cores, partitions=int(cores), name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        query = registry.QUERIES[name]
        timed(query, spark, sf)  # warm-up
        seconds[name] = round(statistics.median(timed(query, spark, sf) for _ in range(repeats)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
