"""Progress and latency statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RING = 1024


def progress(records: DataFrame, lsn: str = "orig_node_lsn") -> DataFrame:
    """One row: node_name 'local' and the highest position, null before any record."""
    return records.agg(F.max(lsn).alias("last_processed_lsn")).select(F.lit("local").alias("node_name"), "last_processed_lsn")


def latency(samples: DataFrame, order: str = "seq", micros: str = "micros") -> DataFrame:
    """p50, p99 and mean in ms of the last 1024 samples: sorted[n / 2] and sorted[n * 99 / 100], counted from 0; nulls without samples.

    The last samples come from a bounded top-k, not a sort of all.
    """
    last = samples.orderBy(F.desc(order)).limit(RING)
    facts = last.agg(F.sort_array(F.collect_list(F.col(micros).cast("bigint"))).alias("s"), F.avg(F.col(micros).cast("double")).alias("mean"))
    n = F.size("s")
    at = lambda i: F.when(n > 0, F.get("s", i.cast("int")) / F.lit(1000.0))
    return facts.select(at(F.floor(n / 2)).alias("p50_ms"), at(F.floor(n * 99 / 100)).alias("p99_ms"), (F.col("mean") / 1000).alias("avg_ms"))
