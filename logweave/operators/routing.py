"""Write routing: where a write to a partition goes, for any number of requests at once.

The maps are joined, not looked up.  Spark broadcasts a side whose size it
knows to be under its threshold and shuffles larger maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SECONDARIES = 32
BLOCKED = ("remote", "node_down")


class WriteRejected(RuntimeError):
    pass


def get_primary(requests: DataFrame, partitions: DataFrame) -> DataFrame:
    """primary_node of each request; null where the partition is unknown or its node negative; a null id asks for 0."""
    known = partitions.select(F.col("partition_id").alias("k"), F.when(F.col("primary_node") >= 0, F.col("primary_node")).alias("primary_node"))
    return requests.join(known, F.coalesce(requests["partition_id"], F.lit(0)) == known["k"], "left").drop("k")


def get_entry(requests: DataFrame, partitions: DataFrame) -> DataFrame:
    """primary_node with the first 32 secondaries."""
    known = partitions.select(F.col("partition_id").alias("k"), F.when(F.col("primary_node") >= 0, F.col("primary_node")).alias("primary_node"), F.slice("secondary_nodes", 1, MAX_SECONDARIES).alias("secondary_nodes"))
    return requests.join(known, F.coalesce(requests["partition_id"], F.lit(0)) == known["k"], "left").drop("k")


def node_status(status: Column) -> Column:
    """Null and unknown states count as active."""
    return F.when(status.isin("down", "syncing"), status).otherwise("active")


def get_node(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    return requests.join(nodes.select("node_id", "hostname", "port", node_status(F.col("status")).alias("status")), "node_id", "left")


def route_writes(requests: DataFrame, partitions: DataFrame, nodes: DataFrame, local_node_id: int = -1) -> DataFrame:
    """Requests with route: not_found, node_down, local or remote, decided in that order."""
    with_primary = get_primary(requests, partitions)
    states = nodes.select(F.col("node_id").alias("n"), node_status(F.col("status")).alias("state"))
    joined = with_primary.join(states, with_primary["primary_node"] == states["n"], "left")
    local = F.lit(local_node_id >= 0) & (F.col("primary_node") == local_node_id)
    route = F.when(F.col("primary_node").isNull(), "not_found").when(F.col("state") == "down", "node_down").when(local, "local").otherwise("remote")
    return joined.withColumn("route", route).drop("n", "state", "primary_node")


SETTING = "logweave.local_node_id"


def local_node(spark) -> int:
    """This node's id from the session's settings, -1 where it isn't set."""
    return int(spark.conf.get(SETTING, "-1"))


def status_text(code: Column) -> Column:
    """The route of a status number, `unknown` for any other."""
    names = ("local", "remote", "not_found", "node_down")
    out = F.lit("unknown")
    for k, name in reversed(list(enumerate(names))):
        out = F.when(code == k, name).otherwise(out)
    return out


def rejected(routed: DataFrame) -> DataFrame:
    """Requests that the guard turns away, with the reason."""
    text = F.when(F.col("route") == "remote", F.lit("write to remote partition")).otherwise(F.lit("primary node is down"))
    return routed.where(F.col("route").isin(*BLOCKED)).withColumn("error", text)


def guard(requests: DataFrame, partitions: DataFrame, nodes: DataFrame, local_node_id: int) -> DataFrame:
    """The requests, if all may be written here; raises otherwise. Off while local_node_id is negative."""
    if local_node_id < 0:
        return requests
    bad = rejected(route_writes(requests, partitions, nodes, local_node_id)).head(1)
    if bad:
        raise WriteRejected(f"{bad[0]['error']}: partition {bad[0]['partition_id']}")
    return requests


def guarded(requests: DataFrame, partitions: DataFrame, nodes: DataFrame, local_node_id: int) -> DataFrame:
    """The same as part of the plan: the job that would write a rejected row fails."""
    routed = route_writes(requests, partitions, nodes, local_node_id)
    wrong = F.col("route").isin(*BLOCKED) & F.lit(local_node_id >= 0)
    return routed.withColumn("route", F.when(wrong, F.raise_error(F.concat(F.lit("write rejected: "), F.col("route")))).otherwise(F.col("route")))


def replicas(partitions: DataFrame) -> DataFrame:
    """A row for each secondary: partition_id, pos (from 0), node_id."""
    return partitions.select("partition_id", F.posexplode("secondary_nodes").alias("pos", "node_id"))
