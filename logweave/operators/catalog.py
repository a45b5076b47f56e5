"""The partition and node catalog: constraints, writes by copy, versions, snapshots by generation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("active", "down", "syncing")
VERSION = "1.0"


class ConstraintError(ValueError):
    pass


def node_violations(nodes: DataFrame) -> DataFrame:
    """Rows that break a rule, with the rule's name; an empty result means a sound table."""
    rule = (
        F.when(F.col("node_id").isNull() | F.col("hostname").isNull() | F.col("port").isNull() | F.col("status").isNull(), "not_null")
        .when(~F.col("port").between(1, 65535), "port_range")
        .when(~F.col("status").isin(*STATUSES), "status_value")
    )
    twice = Window.partitionBy("node_id")
    return nodes.withColumn("n", F.count("*").over(twice)).withColumn("rule", F.coalesce(rule, F.when(F.col("n") > 1, "primary_key"))).drop("n").where("rule is not null")


def partition_violations(partitions: DataFrame) -> DataFrame:
    missing = F.when(F.col("partition_id").isNull() | F.col("primary_node").isNull() | F.col("secondary_nodes").isNull() | F.col("version").isNull(), "not_null")
    twice = Window.partitionBy("partition_id")
    return partitions.withColumn("n", F.count("*").over(twice)).withColumn("rule", F.coalesce(missing, F.when(F.col("n") > 1, "primary_key"))).drop("n").where("rule is not null")


def insert(table: DataFrame, rows: DataFrame, violations) -> DataFrame:
    """Table with rows added, columns left out taking their defaults; raises on a broken rule."""
    defaults = {"secondary_nodes": F.array().cast("array<int>"), "version": F.lit(1).cast("bigint"), "updated_at": F.current_timestamp(), "status": F.lit("active"), "last_heartbeat": F.lit(None).cast("timestamp")}
    for name in table.columns:
        if name not in rows.columns:
            rows = rows.withColumn(name, defaults[name])
    out = table.unionByName(rows.select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in table.columns]))
    broken = violations(out).head(1)
    if broken:
        raise ConstraintError(f"{broken[0]['rule']}: {broken[0].asDict()}")
    return out


def update_partitions(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply changed columns by partition_id; each changed row's version goes up by one, whatever changes says."""
    new = [c for c in changes.columns if c in ("primary_node", "secondary_nodes")]
    keyed = changes.select("partition_id", *[F.col(c).alias(f"new_{c}") for c in new], F.lit(True).alias("hit"))
    joined = table.join(keyed, "partition_id", "left")
    for c in new:
        joined = joined.withColumn(c, F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)))
    joined = joined.withColumn("version", F.when(F.col("hit"), F.col("version") + 1).otherwise(F.col("version")))
    return joined.withColumn("updated_at", F.when(F.col("hit"), F.current_timestamp()).otherwise(F.col("updated_at"))).select(*table.columns)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def versions_after(partitions: DataFrame, updates: DataFrame) -> DataFrame:
    """Version of each partition after a list of update statements (partition_id, a row an update)."""
    n = updates.groupBy("partition_id").agg(F.count("*").alias("n"))
    return partitions.join(n, "partition_id", "left").select("partition_id", (F.col("version") + F.coalesce("n", F.lit(0))).alias("version"))


@dataclass
class MetadataCache:
    """Snapshots of both maps that are served until the generation changes, with hit and miss counts."""

    load_partitions: object
    load_nodes: object
    generation: int = 0
    counters: dict = field(default_factory=lambda: {"partition_hits": 0, "partition_misses": 0, "node_hits": 0, "node_misses": 0})
    _held: dict = field(default_factory=dict)

    def invalidate(self) -> None:
        self.generation += 1
        for held in self._held.values():
            if isinstance(held, DataFrame):
                held.unpersist()
        self._held.clear()

    bump_metadata_version = invalidate

    def partitions(self) -> DataFrame:
        if "p" not in self._held:
            self._held["p"] = self.load_partitions().cache()
            self._held["p"].count()
        return self._held["p"]

    def nodes(self) -> DataFrame:
        if "n" not in self._held:
            self._held["n"] = self.load_nodes().cache()
            self._held["n"].count()
        return self._held["n"]

    def get_primary(self, partition_id: int | None) -> int | None:
        """The primary node of one partition: a hit if it was asked for in this generation, else a miss; unknown ones are never kept."""
        return self._look_up("partition", self.partitions, "partition_id", partition_id or 0, lambda r: r["primary_node"] if r["primary_node"] >= 0 else None)

    def get_node(self, node_id: int) -> tuple | None:
        """(hostname, port, status) of one node, with the same counts."""
        return self._look_up("node", self.nodes, "node_id", node_id, lambda r: (r["hostname"], r["port"], r["status"] if r["status"] in STATUSES else "active"))

    def _look_up(self, kind: str, rows, key: str, value: int, read):
        known = self._held.setdefault(f"known {kind}", {})
        if value in known:
            self.counters[f"{kind}_hits"] += 1
            return known[value]
        self.counters[f"{kind}_misses"] += 1
        row = rows().where(F.col(key) == value).first()
        got = None if row is None else read(row)
        if got is not None:
            known[value] = got
        return got

    def route_write(self, partition_id: int | None, local_node_id: int = -1) -> str:
        """Where one write goes; the batch form is ``routing.route_writes``."""
        primary = self.get_primary(partition_id)
        if primary is None:
            return "not_found"
        node = self.get_node(primary)
        if node is not None and node[2] == "down":
            return "node_down"
        return "local" if 0 <= local_node_id == primary else "remote"

    def stats(self) -> dict:
        return {**self.counters, "metadata_generation": self.generation}


def cache_stats(requests: DataFrame, partitions: DataFrame, nodes: DataFrame, generation: int = 0) -> DataFrame:
    """What the counters show after a list of routing requests in one generation.

    A partition that is known (its primary not negative) misses once, then hits;
    others miss each time.  Each request of a known partition asks for its node,
    which is counted in the same way.
    """

    def counted(asked: DataFrame, key: str, known: DataFrame, kind: str) -> DataFrame:
        per_key = asked.groupBy(key).agg(F.count("*").alias("n")).join(known.select(key).distinct().withColumn("known", F.lit(True)), key, "left")
        misses = F.when(F.col("known"), 1).otherwise(F.col("n"))
        return per_key.agg(F.coalesce(F.sum(F.col("n") - misses), F.lit(0)).alias(f"{kind}_hits"), F.coalesce(F.sum(misses), F.lit(0)).alias(f"{kind}_misses"))

    keyed = requests.select(F.coalesce("partition_id", F.lit(0)).alias("partition_id"))
    known = partitions.where("primary_node >= 0").select("partition_id", F.col("primary_node").alias("node_id"))
    asked = keyed.join(known, "partition_id").select("node_id")
    both = counted(keyed, "partition_id", known, "partition").crossJoin(counted(asked, "node_id", nodes, "node"))
    return both.withColumn("metadata_generation", F.lit(generation).cast("bigint"))
