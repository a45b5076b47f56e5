"""Distributed tables: key to shard, shard catalogs, pruning, moves and time partitions, as plans over DataFrames.

A key's place on the ring of 2^32 hash values is a multiplicative hash of our
own; parity with any other platform's hash is not claimed.  Shard n of N holds
the n-th of N equal ranges of the ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = 1 << 32
FACTOR = 2654435761


def key_hash(key: Column) -> Column:
    """Place of an integer key on the ring."""
    return F.pmod(F.pmod(key.cast("bigint"), F.lit(RING)) * F.lit(FACTOR), F.lit(RING))


def shard_of(key: Column, shards: int) -> Column:
    return F.floor(key_hash(key) / F.lit(RING // shards)).cast("int")


def shard_catalog(spark, shards: int) -> DataFrame:
    """shardid with the smallest and largest hash it holds."""
    width = RING // shards
    return spark.range(shards).select(F.col("id").cast("int").alias("shardid"), (F.col("id") * width).alias("min_hash"), F.when(F.col("id") == shards - 1, F.lit(RING - 1)).otherwise((F.col("id") + 1) * width - 1).alias("max_hash"))


def distribute(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """Rows with their shard, one shard a partition; equal keys of tables that are distributed alike lie together."""
    return rows.withColumn("shardid", shard_of(F.col(key), shards)).repartition(shards, "shardid")


def write_distributed(rows: DataFrame, key: str, shards: int, path: str) -> None:
    """A table whose folders are shards, so a read that names keys opens only theirs (``prune``)."""
    distribute(rows, key, shards).write.mode("overwrite").partitionBy("shardid").parquet(path)


def prune(rows: DataFrame, key: str, values: list[int], shards: int) -> DataFrame:
    """Rows with one of the keys; the shards that can't hold them are left out of the scan."""
    places = sorted({((v % RING) * FACTOR % RING) // (RING // shards) for v in values})
    return rows.where(F.col("shardid").isin(places) & F.col(key).isin(values))


def colocated_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join of tables distributed alike: on shard and key, so the shards' partitions serve as they are."""
    return left.join(right, ["shardid", key])


def sizes(rows: DataFrame, shard: str = "shardid") -> DataFrame:
    return rows.groupBy(shard).agg(F.count("*").alias("n_rows"))


def split_points(rows: DataFrame, key: str, shards: int, shard: int) -> DataFrame:
    """Where to split a shard in two: the hash below which half of its rows lie."""
    mine = rows.where(shard_of(F.col(key), shards) == shard).select(key_hash(F.col(key)).alias("h"))
    return mine.agg(F.count("*").alias("n_rows"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY h)").cast("bigint").alias("split_at"))


def isolated(rows: DataFrame, key: str, tenants: list[int], shards: int) -> DataFrame:
    """shardid in which each named key has a shard of its own, numbered after the others."""
    own = F.lit(None).cast("int")
    for k, tenant in enumerate(tenants):
        own = F.when(F.col(key) == tenant, F.lit(shards + k)).otherwise(own)
    return rows.withColumn("shardid", F.coalesce(own, shard_of(F.col(key), shards)))


def rebalanced(placements: DataFrame, nodes: int) -> DataFrame:
    """A node for each shard (shardid, n_rows): shards in order of size are dealt to and fro, so loads end near each other.

    The table has a row a shard, so one window over it is small.
    """
    line = Window.orderBy(F.desc("n_rows"), "shardid")
    turn = (F.row_number().over(line) - 1).cast("int")
    lap, place = F.floor(turn / nodes), turn % nodes
    return placements.withColumn("node", F.when(lap % 2 == 0, place).otherwise(nodes - 1 - place).cast("int"))


def time_partitions(rows: DataFrame, column: str, unit: str = "month") -> DataFrame:
    """The partitions that rows need: from_time, to_time and how many rows each gets."""
    start = F.date_trunc(unit, F.col(column)).cast("timestamp_ntz")
    counts = rows.groupBy(start.alias("from_time")).agg(F.count("*").alias("n_rows"))
    return counts.select("from_time", F.expr(f"from_time + INTERVAL 1 {unit}").alias("to_time"), "n_rows")


def map_outputs(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """What map tasks hand to merge tasks: rows by source shard and target part."""
    target = shard_of(F.col(key), parts).alias("part")
    return rows.groupBy("shardid", target).agg(F.count("*").alias("n_rows"))
