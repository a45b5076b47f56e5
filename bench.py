"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 12g pyspark-shell")

from logweave import catalogue
from logweave.session import session

HEADLINE = [
    "wal_continuity", "wal_verify", "wal_gaps", "wal_last_lsn", "segment_summary", "route_write", "route_summary", "version_bump", "cache_stats", "capture_statements", "demux_dedup",
    "demux_epochs", "demux_latency", "agg_group", "agg_rollup", "agg_percentile", "join_multiway", "join_merge", "join_range", "join_asof", "join_salted", "window_rank", "window_range", "top_k", "distinct_on", "subquery_correlated", "set_except_all", "window_session",
]


def single_calls(spark, sf_dir: str, calls: int = 1000) -> float:
    """Mean ms of one routing call in sequence with a warm cache: 3 partitions, 2 nodes, local node 1."""
    from logweave.operators.catalog import MetadataCache

    cache = MetadataCache(lambda: spark.createDataFrame([(700, 1), (800, 2), (900, 1)], "partition_id long, primary_node int"), lambda: spark.createDataFrame([(1, "a", 1, "active"), (2, "b", 2, "active")], "node_id int, hostname string, port int, status string"))
    for p in (700, 800, 900):
        cache.route_write(p, 1)
    start = time.perf_counter()
    for k in range(calls):
        cache.route_write((700, 800, 900)[k % 3], 1)
    return 1000 * (time.perf_counter() - start) / calls


def bulk_load_overhead(spark, sf_dir: str) -> float:
    """Share by which capture lengthens a bulk load: lineitem written as Parquet with its log record's facts observed on the way, against written alone; median of 5."""
    import tempfile

    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")

    def load(captured: bool) -> float:
        with tempfile.TemporaryDirectory() as folder:
            start = time.perf_counter()
            seen = Observation()
            taken = rows.observe(seen, F.max("l_orderkey").alias("orig_lsn"), F.count("*").alias("n_rows")) if captured else rows
            taken.write.parquet(f"{folder}/t")
            if captured and seen.get["n_rows"] == 0:
                raise RuntimeError("nothing loaded")
            return time.perf_counter() - start

    load(True)
    plain, both = (statistics.median(load(c) for _ in range(5)) for c in (False, True))
    return both / plain - 1


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs), 3)
    asked = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    extra = {"route_ms_a_request_in_a_batch": round(1000 * took["route_write"] / max(1, asked), 6), "route_ms_a_call": round(single_calls(spark, sf_dir), 6), "bulk_load_overhead": round(bulk_load_overhead(spark, sf_dir), 4)}
    spark.stop()
    print(json.dumps({"metric": "sum of medians of 3 runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), **extra}))


if __name__ == "__main__":
    sys.exit(main())
