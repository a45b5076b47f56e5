"""Capture: change events to log records, one for each statement and relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lsn import DATA, MAGIC

CAPTURED = ("INSERT", "UPDATE", "DELETE", "COPY")


def is_shard_name(name: Column) -> Column:
    """Whether what follows the last underscore is four or more digits."""
    return F.coalesce(name.rlike(r"_[0-9]{4,}\z"), F.lit(False))


def logged_relations(events: DataFrame, registered: DataFrame, distributed: DataFrame | None = None, group_id: int = -1) -> DataFrame:
    """Events of relations that are registered, named like a shard, or distributed while this node is a worker."""
    keyed = registered.select(F.col("partition_id").alias("relid")).distinct().withColumn("registered", F.lit(True))
    out = events.join(keyed, "relid", "left")
    test = F.coalesce(F.col("registered"), F.lit(False)) | is_shard_name(F.col("alias")) | is_shard_name(F.col("rel_name"))
    if distributed is not None and group_id > 0:
        out = out.join(distributed.select("relid").distinct().withColumn("distributed", F.lit(True)), "relid", "left")
        test = test | F.coalesce(F.col("distributed"), F.lit(False))
    return out.where(test).drop("registered", "distributed")


def capture(events: DataFrame) -> DataFrame:
    """Node-log records of the events: a data record for each statement and relation, at its last position."""
    rows = events.where(F.col("op").isin(*CAPTURED))
    return rows.groupBy("stmt_id", F.col("relid").alias("partition_id")).agg(F.max("node_lsn").alias("orig_lsn")).withColumn("flags", F.lit(DATA))


def numbered(records: DataFrame, high: DataFrame | None = None, order: tuple[str, ...] = ("orig_lsn", "stmt_id"), piece: Column | None = None) -> DataFrame:
    """Records with partition_lsn: each partition goes on after its highest number so far (high: partition_id, max_lsn).

    piece names a piece of the order (a segment, a range of positions) that
    rises with it: records are then numbered within pieces and the pieces'
    counts summed up, so a partition's records need not lie in one task.
    """
    if piece is None:
        out = records.withColumn("partition_lsn", F.row_number().over(Window.partitionBy("partition_id").orderBy(*order)).cast("bigint"))
    else:
        cut = records.withColumn("_piece", piece)
        ahead = Window.partitionBy("partition_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        counts = cut.groupBy("partition_id", "_piece").agg(F.count("*").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
        inside = F.row_number().over(Window.partitionBy("partition_id", "_piece").orderBy(*order))
        out = cut.withColumn("_in", inside).join(counts, ["partition_id", "_piece"]).withColumn("partition_lsn", (F.col("_in") + F.col("_ahead")).cast("bigint"))
        out = out.select(*records.columns, "partition_lsn")
    if high is None:
        return out
    return out.join(high.select("partition_id", "max_lsn"), "partition_id", "left").withColumn("partition_lsn", F.col("partition_lsn") + F.coalesce("max_lsn", F.lit(0))).drop("max_lsn")


def registrations(created: DataFrame, registered: DataFrame) -> DataFrame:
    """Partitions to register when relations are created (relid, rel_name): those named like a shard that are not registered yet."""
    named = created.where(is_shard_name(F.col("rel_name"))).select(F.col("relid").alias("partition_id")).distinct()
    return named.join(registered.select("partition_id"), "partition_id", "left_anti")


def explicit_record(requests: DataFrame) -> DataFrame:
    """Records asked for by call: flags are cut to a byte, and null requests give none."""
    return requests.where(F.col("partition_id").isNotNull() & F.col("flags").isNotNull()).withColumn("flags", F.col("flags").bitwiseAND(255)).withColumn("magic", F.lit(MAGIC))
