"""The log's functions under their SQL names, as temporary SQL functions over four views.

``register`` makes them from a partition log (schema.RECORD, segno), a
partition map and a node map; they are ordinary SQL, so Spark inlines them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lsn import MAGIC
from ..operators import checks

_VIEWS = {"log": "logweave_log", "partitions": "logweave_partitions", "nodes": "logweave_nodes", "verified": "logweave_verified"}


def _definitions(local_node_id: int) -> list[str]:
    ok = f"magic = {MAGIC} AND partition_id = dir_partition_id"
    segment = "format_string('%08X%08X%08X', 1, bigint(segno div 256), bigint(segno % 256))"
    primary = "(SELECT max(CASE WHEN primary_node >= 0 THEN primary_node END) FROM logweave_partitions WHERE partition_id = coalesce(pid, 0))"
    route = f"""(SELECT coalesce(max(CASE WHEN primary_node < 0 THEN 'not_found' WHEN status = 'down' THEN 'node_down'
      WHEN {local_node_id} >= 0 AND primary_node = {local_node_id} THEN 'local' ELSE 'remote' END), 'not_found')
      FROM logweave_partitions LEFT JOIN logweave_nodes ON node_id = primary_node WHERE partition_id = coalesce(pid, 0))"""
    return [
        "partdist_version() RETURNS STRING RETURN '1.0'",
        "lsn_text(lsn BIGINT) RETURNS STRING RETURN concat(hex(lsn div 4294967296), '/', hex(lsn % 4294967296))",
        f"partition_wal_path(pid BIGINT, segno BIGINT) RETURNS STRING RETURN concat('pg_parwal/', pid, '/', {segment})",
        "is_shard_name(name STRING) RETURNS BOOLEAN RETURN coalesce(name RLIKE '_[0-9]{4,}\\\\z', false)",
        f"get_primary(pid BIGINT) RETURNS INT RETURN {primary}",
        f"route_write(pid BIGINT) RETURNS STRING RETURN {route}",
        f"check_partition_wal(pid BIGINT) RETURNS TABLE(partition_lsn BIGINT, orig_node_lsn DECIMAL(20,0), flags INT, is_valid BOOLEAN) RETURN SELECT partition_lsn, orig_node_lsn, flags, {ok} AND flags IN (1, 2, 4) FROM logweave_log WHERE dir_partition_id = pid",
        f"read_all_headers(pid BIGINT) RETURNS TABLE(partition_lsn BIGINT, orig_node_lsn DECIMAL(20,0)) RETURN SELECT partition_lsn, orig_node_lsn FROM logweave_log WHERE dir_partition_id = pid AND {ok}",
        "count_parwal_records(pid BIGINT) RETURNS BIGINT RETURN CASE WHEN pid IS NOT NULL THEN (SELECT count(*) FROM logweave_log WHERE dir_partition_id = pid) END",
        "verify_partition_wal(pid BIGINT) RETURNS BOOLEAN RETURN CASE WHEN pid IS NOT NULL THEN coalesce((SELECT bool_and(ok) FROM logweave_verified WHERE dir_partition_id = pid), true) END",
        "demux_progress() RETURNS TABLE(node_name STRING, last_processed_lsn DECIMAL(20,0)) RETURN SELECT 'local', max(orig_node_lsn) FROM logweave_log",
    ]


def register(spark: SparkSession, log: DataFrame, partitions: DataFrame, nodes: DataFrame, local_node_id: int = -1) -> list[str]:
    """Make the views and functions in this session; returns the functions' names."""
    log.select("dir_partition_id", "segname", "rec_idx", "magic", "partition_id", F.col("orig_node_lsn").cast("decimal(20,0)").alias("orig_node_lsn"), "partition_lsn", "flags").createOrReplaceTempView(_VIEWS["log"])
    checks.verify(log).createOrReplaceTempView(_VIEWS["verified"])
    partitions.createOrReplaceTempView(_VIEWS["partitions"])
    nodes.createOrReplaceTempView(_VIEWS["nodes"])
    names = []
    for text in _definitions(local_node_id):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
        names.append(text.split("(")[0])
    return names
