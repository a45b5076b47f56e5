"""Demultiplexing a node log into partition logs, in batch.

A record is kept if its number is above all kept before it in arrival order,
which is the same as above all before it: the running maximum decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lsn import MAGIC

RMID, INFO_DATA = 128, 0


def own_records(node_log: DataFrame) -> DataFrame:
    """Records of our kind with a right magic; all else in the node log is passed over."""
    return node_log.where((F.col("rmid") == RMID) & (F.col("info") == INFO_DATA) & (F.col("magic") == MAGIC))


def with_epochs(records: DataFrame, order: str = "arrival") -> DataFrame:
    """An epoch for each partition that goes up when numbering starts again at 1 after the log was emptied (is_reset)."""
    line = Window.partitionBy("partition_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("epoch", F.sum(F.when(F.col("is_reset"), 1).otherwise(0)).over(line))


CHUNK = 1 << 20  # width of a piece of the arrival order


def judged(records: DataFrame, order: str = "arrival", keys: tuple[str, ...] = ("partition_id",), high: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """Records with kept; high (partition_id, max_lsn) holds what earlier batches wrote.

    The running maximum is taken within pieces of the arrival order, and from
    one piece to the next over their maxima alone, so a partition's records need
    not lie in one task.
    """
    pieces = records.withColumn("_piece", F.floor(F.col(order) / F.lit(chunk)).cast("bigint"))
    ahead = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    tops = pieces.groupBy(*keys, "_piece").agg(F.max("partition_lsn").alias("_top"))
    tops = tops.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_piece").alias("_p"), F.max("_top").over(ahead).alias("_ahead"))
    same = [pieces[k].eqNullSafe(tops[f"_{k}"]) for k in keys]
    joined = pieces.join(tops, [*same, pieces["_piece"] == tops["_p"]], "left").drop("_p", *[f"_{k}" for k in keys])
    before = Window.partitionBy(*keys, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.greatest(F.coalesce(F.max("partition_lsn").over(before), F.lit(0)), F.coalesce("_ahead", F.lit(0)))
    if high is not None:
        joined = joined.join(high.select("partition_id", "max_lsn"), "partition_id", "left")
        mark = F.greatest(mark, F.coalesce("max_lsn", F.lit(0)))
    return joined.withColumn("kept", F.col("partition_lsn") > mark).select(*records.columns, "kept")


def demux(records: DataFrame, **how) -> DataFrame:
    return judged(records, **how).where("kept").drop("kept")


def late(records: DataFrame, **how) -> DataFrame:
    """What demux drops: replays and records that arrive after a higher number."""
    return judged(records, **how).where("not kept").drop("kept")


def replayed(records: DataFrame, written_log: DataFrame) -> DataFrame:
    """Recovery: the records with a right magic whose number is above the last one on disk of their partition; safe to repeat.

    A hole below that number is not filled: numbers only go up.
    """
    last = written_log.groupBy("partition_id").agg(F.max("partition_lsn").alias("_last"))
    above = records.join(last, "partition_id", "left").where(F.col("partition_lsn") > F.coalesce("_last", F.lit(0))).drop("_last")
    return above.where(F.col("magic") == MAGIC) if "magic" in records.columns else above


def resync(node_log: DataFrame, reads: int = 4) -> DataFrame:
    """Runs of unreadable records that the reader skips: gap_start, gap_end (node_lsn) and tries, for each run between readable ones.

    A record is unreadable if it is ours and its magic is wrong.  The reader
    tries a place up to `reads` times before it goes on to the next valid record.
    """
    rows = node_log.where((F.col("rmid") == RMID) & (F.col("info") == INFO_DATA)).select("node_lsn", (F.col("magic") == MAGIC).alias("ok"))
    # The number of readable records before a bad one names its run; counted by pieces, as in judged.
    pieces = rows.withColumn("_piece", F.floor(F.col("node_lsn") / F.lit(CHUNK)).cast("bigint"))
    total = pieces.groupBy("_piece").agg(F.count_if("ok").alias("n"))
    total = total.select("_piece", F.coalesce(F.sum("n").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inside = F.sum(F.col("ok").cast("int")).over(Window.partitionBy("_piece").orderBy("node_lsn").rowsBetween(Window.unboundedPreceding, 0))
    named = pieces.withColumn("_in", inside).join(total, "_piece").where("not ok").withColumn("run", F.col("_in") + F.col("_ahead"))
    runs = named.groupBy("run").agg(F.min("node_lsn").alias("gap_start"), F.max("node_lsn").alias("gap_end"), F.count("*").alias("n_skipped"))
    return runs.select("gap_start", "gap_end", "n_skipped", F.lit(reads).alias("tries"))


def stalled(records: DataFrame, failures: DataFrame) -> DataFrame:
    """Records in arrival order with state: `written`, or `stalled` from the first failed write of their partition until a later retry.

    failures: partition_id, failed_at, retried_at (null: not yet).  Other
    partitions go on; after the retry the stalled records are written first.
    """
    joined = records.join(failures, "partition_id", "left")
    held = F.col("failed_at").isNotNull() & (F.col("arrival") >= F.col("failed_at")) & F.col("retried_at").isNull()
    late = F.col("failed_at").isNotNull() & (F.col("arrival") >= F.col("failed_at")) & (F.col("arrival") < F.col("retried_at"))
    state = F.when(held, "stalled").when(late, "written late").otherwise("written")
    return joined.withColumn("state", state).drop("failed_at", "retried_at")


def reset_marks(records: DataFrame, order: str = "arrival") -> DataFrame:
    """Records with is_reset: numbering starts again at 1 though the partition has had records, and nothing is on disk (on_disk)."""
    line = Window.partitionBy("partition_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("partition_lsn").over(line), F.lit(0))
    return records.withColumn("is_reset", (F.col("partition_lsn") == 1) & (before > 0) & ~F.col("on_disk"))
