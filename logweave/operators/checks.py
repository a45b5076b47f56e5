"""Scans and checks of partition logs (native rows as in schema.RECORD)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lsn import CHECKPOINT, DATA, MAGIC, SKIP

KEY = "dir_partition_id"


def header_ok() -> Column:
    return (F.col("magic") == MAGIC) & (F.col("partition_id") == F.col(KEY))


def with_validity(log: DataFrame) -> DataFrame:
    """Every record with is_valid: magic, partition and a flag value of exactly 1, 2 or 4."""
    return log.withColumn("is_valid", header_ok() & F.col("flags").isin(DATA, SKIP, CHECKPOINT))


def headers(log: DataFrame) -> DataFrame:
    """Records of the right magic and partition; flags are not looked at."""
    return log.where(header_ok())


def record_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(KEY).agg(F.count("*").alias("n"))


def segment_facts(log: DataFrame) -> DataFrame:
    """What verification needs of each segment, by one aggregation with partial sums.

    rec_idx numbers a segment's records from 0, so a record's place in its
    partition is rec_idx plus the records of earlier segments; a segment is in
    order when partition_lsn - rec_idx is one and the same number throughout.
    """
    step = F.col("partition_lsn") - F.col("rec_idx")
    return log.groupBy(KEY, "segname").agg(
        F.count("*").alias("n"),
        F.min(step).alias("low"),
        F.max(step).alias("high"),
        F.bool_and(header_ok()).alias("ok"),
    )


def verify(log: DataFrame, first_lsn: int = 1) -> DataFrame:
    """Per partition: headers are right and partition_lsn is first_lsn, +1, ... in physical order.

    The window runs over segment summaries, never over records.
    """
    before = Window.partitionBy(KEY).orderBy("segname").rowsBetween(Window.unboundedPreceding, -1)
    placed = segment_facts(log).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)) + first_lsn)
    right = F.col("ok") & (F.col("low") == F.col("ahead")) & (F.col("high") == F.col("ahead"))
    return placed.groupBy(KEY).agg(F.bool_and(F.coalesce(right, F.lit(False))).alias("ok"))


def verify_partitions(log: DataFrame, partitions: DataFrame) -> DataFrame:
    """verify for listed partitions; empty and missing ones are in order."""
    return partitions.join(verify(log), KEY, "left").withColumn("ok", F.coalesce("ok", F.lit(True)))


def continuity(log: DataFrame) -> DataFrame:
    """Per partition: records, first and last number, whether they run without a gap, and how many are missing."""
    facts = log.groupBy("partition_id").agg(
        F.count("*").alias("n_records"),
        F.min("partition_lsn").alias("min_lsn"),
        F.max("partition_lsn").alias("max_lsn"),
        F.count_distinct("partition_lsn").alias("n_distinct"),
    )
    whole = (F.col("min_lsn") == 1) & (F.col("max_lsn") == F.col("n_records")) & (F.col("n_distinct") == F.col("n_records"))
    return facts.select("partition_id", "n_records", "min_lsn", "max_lsn", whole.alias("is_contiguous"), (F.col("max_lsn") - F.col("n_records")).alias("n_missing"))


def gaps(log: DataFrame, piece: int = 1 << 20) -> DataFrame:
    """Missing ranges: partition_id, gap_start, gap_end.

    Numbers are compared within pieces of the number line, and from piece to
    piece by their first and last numbers alone.
    """
    cut = log.select("partition_id", "partition_lsn", F.floor(F.col("partition_lsn") / F.lit(piece)).cast("bigint").alias("piece")).distinct()
    line = Window.partitionBy("partition_id", "piece").orderBy("partition_lsn")
    inside = cut.withColumn("next", F.lead("partition_lsn").over(line)).select("partition_id", "partition_lsn", "next")
    ends = cut.groupBy("partition_id", "piece").agg(F.min("partition_lsn").alias("low"), F.max("partition_lsn").alias("partition_lsn"))
    between = ends.withColumn("next", F.lead("low").over(Window.partitionBy("partition_id").orderBy("piece"))).select("partition_id", "partition_lsn", "next")
    return inside.unionByName(between).where("next - partition_lsn > 1").selectExpr("partition_id", "partition_lsn + 1 AS gap_start", "next - 1 AS gap_end")


def duplicates(log: DataFrame) -> DataFrame:
    return log.groupBy("partition_id", "partition_lsn").agg(F.count("*").alias("n")).where("n > 1")


def last_written(log: DataFrame, partitions: DataFrame, torn: DataFrame) -> DataFrame:
    """The number that writing goes on from, for each of partitions (dir_partition_id): that of the last record of the highest segment.

    Where that segment has a torn tail (torn: dir_partition_id, segname), the
    highest number among its valid records; 0 where there are no records.
    """
    highest = log.groupBy(KEY).agg(F.max("segname").alias("segname"))
    rows = log.join(highest, [KEY, "segname"]).join(torn.select(KEY, "segname").distinct().withColumn("torn", F.lit(True)), [KEY, "segname"], "left")
    facts = rows.groupBy(KEY).agg(
        F.bool_or(F.coalesce("torn", F.lit(False))).alias("torn"),
        F.max(F.when(header_ok(), F.col("partition_lsn"))).alias("most"),
        F.max_by("partition_lsn", "rec_idx").alias("last"),
    )
    found = facts.select(KEY, F.when(F.col("torn"), F.col("most")).otherwise(F.col("last")).alias("found"))
    return partitions.select(KEY).distinct().join(found, KEY, "left").select(KEY, F.coalesce("found", F.lit(0)).alias("last_lsn"))


def last_lsn(log: DataFrame) -> DataFrame:
    """The last valid record in physical order; a partial aggregate, no sort."""
    return headers(log).groupBy(KEY).agg(F.max_by("partition_lsn", F.struct("segname", "rec_idx")).alias("last_lsn"))


def flag_summary(log: DataFrame) -> DataFrame:
    of = lambda flag: F.count_if(F.col("flags") == flag)
    return log.groupBy("partition_id").agg(of(DATA).alias("n_data"), of(SKIP).alias("n_skip"), of(CHECKPOINT).alias("n_checkpoint"))


def segment_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("partition_id", "segname").agg(F.count("*").alias("n"), F.min("orig_node_lsn").alias("first_lsn"), F.max("orig_node_lsn").alias("last_lsn"))
