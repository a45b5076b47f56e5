"""WITH RECURSIVE ... UNION (distinct) by semi-naive rounds: each joins only the rows that the last one found."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def use_checkpoints(spark: SparkSession) -> None:
    """A cluster names its shared folder in spark.checkpoint.dir; a local session without one gets a folder of its own."""
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="logweave-"))


def reachable(edges: DataFrame, start: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(origin, node) for every node that origin reaches over edges (src, dst), origin itself included; cycles end where nothing is new.

    Each round writes the rows it found and no others.
    """
    use_checkpoints(edges.sparkSession)
    fresh = start.select("origin", F.col("origin").alias("node")).distinct().checkpoint()
    parts = [fresh]
    for _ in range(most_rounds):
        step = fresh.join(edges, fresh["node"] == edges["src"]).select("origin", F.col("dst").alias("node")).distinct()
        for part in parts:
            step = step.join(part, ["origin", "node"], "left_anti")
        fresh = step.checkpoint()
        if not fresh.head(1):
            return reduce(DataFrame.unionByName, parts)
        parts.append(fresh)
        if len(parts) > 16:  # many small rounds: one table again
            parts = [reduce(DataFrame.unionByName, parts).checkpoint()]
    raise RuntimeError(f"not closed after {most_rounds} rounds")


def paths(edges: DataFrame, start: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Every walk from origin that ends at its first repeated node: origin, node, path (array) and is_cycle, as SEARCH and CYCLE clauses give them."""
    use_checkpoints(edges.sparkSession)
    fresh = start.select("origin", F.col("origin").alias("node"), F.array("origin").alias("path"), F.lit(False).alias("is_cycle")).distinct().checkpoint()
    parts = [fresh]
    for _ in range(most_rounds):
        step = fresh.where("not is_cycle").join(edges, F.col("node") == F.col("src"))
        fresh = step.select("origin", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), F.array_contains("path", F.col("dst")).alias("is_cycle")).checkpoint()
        if not fresh.head(1):
            return reduce(DataFrame.unionByName, parts)
        parts.append(fresh)
    raise RuntimeError(f"not ended after {most_rounds} rounds")
