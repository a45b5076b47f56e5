"""Streaming demultiplexer: a node log in, partition logs out, once each.

State is one row a partition: the highest number kept and the epoch.  Rows of a
micro-batch are judged in arrival order.  The sink writes each micro-batch to a
folder named by its id, so a batch that runs again replaces its own rows.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..lsn import SEGMENT_BYTES
from ..operators import checks, metrics
from ..operators.demux import own_records
from ..sources import partlog

OUT = "partition_id long, partition_lsn long, orig_node_lsn long, flags int, arrival long, epoch long, kept boolean"


def _judge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    mark, epoch = state.get if state.exists else (0, 0)
    rows = pd.concat(list(parts)).sort_values("arrival", kind="stable")
    lsn = rows["partition_lsn"].to_numpy()
    again = rows["is_reset"].fillna(False).to_numpy(bool) & (lsn == 1)
    before = np.r_[mark, np.maximum.accumulate(np.r_[mark, lsn])[1:-1]] if len(lsn) else np.empty(0)
    again &= before > 0
    # Within an epoch a record is kept if it is above all before it.
    epochs = np.cumsum(again)
    kept = np.empty(len(lsn), bool)
    for e in range(int(epochs[-1]) + 1 if len(lsn) else 0):
        here = np.flatnonzero(epochs == e)
        if not len(here):
            continue
        top = np.maximum.accumulate(np.r_[0 if e else mark, lsn[here]])
        kept[here], last = lsn[here] > top[:-1], int(top[-1])
    state.update((last if len(lsn) else mark, epoch + int(epochs[-1]) if len(lsn) else epoch))
    yield rows.assign(kept=kept, epoch=epoch + epochs)[["partition_id", "partition_lsn", "orig_node_lsn", "flags", "arrival", "epoch", "kept"]]


def judged(node_log: DataFrame) -> DataFrame:
    """Own records of a streaming node log with kept and epoch; is_reset marks a log that was emptied before."""
    rows = own_records(node_log)
    rows = rows if "is_reset" in rows.columns else rows.withColumn("is_reset", F.lit(False))
    rows = rows.select("partition_id", "partition_lsn", "orig_node_lsn", "flags", F.col("node_lsn").alias("arrival"), "is_reset")
    return rows.groupBy("partition_id").applyInPandasWithState(_judge, OUT, "mark long, epoch long", "append", GroupStateTimeout.NoTimeout)


def start(node_log: DataFrame, root: str, checkpoint: str, **trigger: Any):
    """Run the demultiplexer into root/log and root/late, Parquet by batch; returns the query."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for name, rows in (("log", batch.where("kept")), ("late", batch.where("not kept"))):
            rows.drop("kept").write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        batch.unpersist()

    return judged(node_log).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_to_segments(node_log: DataFrame, root: str, checkpoint: str, segment_bytes: int = SEGMENT_BYTES, **trigger: Any):
    """Run the demultiplexer into segment files under root; returns the query.

    A batch that runs again after a failure writes nothing twice: what is at or
    below the last number on disk of its partition is passed over.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        kept = batch.where("kept").select("partition_id", "partition_lsn", "orig_node_lsn", "flags")
        on_disk = partlog.scan(batch.sparkSession, root) if partlog.exists(root) else None
        if on_disk is not None:
            last = checks.headers(on_disk).groupBy("partition_id").agg(F.max("partition_lsn").alias("last"))
            kept = kept.join(last, "partition_id", "left").where(F.col("partition_lsn") > F.coalesce("last", F.lit(0))).drop("last")
        partlog.write(kept, root, segment_bytes)

    return judged(node_log).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def flush(query, seconds: float = 30.0, poll: float = 0.02) -> bool:
    """Wait until what had arrived at the call is written; False, with a warning, if that takes longer than so many seconds."""
    end = time.monotonic() + seconds
    while query.isActive and query.exception() is None:
        status = query.status
        if not status["isDataAvailable"] and not status["isTriggerActive"] and query.lastProgress is not None:
            return True
        if time.monotonic() >= end:
            warnings.warn(f"not flushed after {seconds} s", stacklevel=2)
            return False
        time.sleep(poll)
    return query.exception() is None


def progress(spark: SparkSession, root: str) -> DataFrame:
    """One row: node_name and the highest position that the stream into root has written, null before its first batch."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/log", f"{root}/late")
    except AnalysisException:
        rows = spark.createDataFrame([], "orig_node_lsn long")
    return metrics.progress(rows)


def windowed_counts(events: DataFrame, width: str = "1 hour", late_by: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Event-time counts with a watermark: streaming or batch."""
    return events.withWatermark("ts", late_by).groupBy(F.window("ts", width), key).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late_by: str = "10 minutes", key: str = "user_id") -> DataFrame:
    return events.withWatermark("ts", late_by).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))


def matched(left: DataFrame, right: DataFrame, key: str, within: str = "1 hour", late_by: str = "10 minutes") -> DataFrame:
    """Stream-stream join: rows of left (key, ts) with rows of right (key, ts) up to `within` later; both watermarks bound the state."""
    a = left.withWatermark("ts", late_by).select(F.col(key).alias(f"left_{key}"), F.col("ts").alias("left_ts"), *[F.col(c).alias(f"left_{c}") for c in left.columns if c not in (key, "ts")])
    b = right.withWatermark("ts", late_by).select(F.col(key).alias(f"right_{key}"), F.col("ts").alias("right_ts"), *[F.col(c).alias(f"right_{c}") for c in right.columns if c not in (key, "ts")])
    near = (F.col("right_ts") >= F.col("left_ts")) & (F.col("right_ts") <= F.col("left_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(f"left_{key}") == F.col(f"right_{key}")) & near)
