"""Schemas of the catalog tables, log records and inputs."""

from __future__ import annotations

from pyspark.sql import types as T

PARTITION_MAP = T.StructType(
    [
        T.StructField("partition_id", T.LongType(), False),
        T.StructField("primary_node", T.IntegerType(), False),
        T.StructField("secondary_nodes", T.ArrayType(T.IntegerType()), False),
        T.StructField("version", T.LongType(), False),
        T.StructField("updated_at", T.TimestampType(), True),
    ]
)
NODE_MAP = T.StructType(
    [
        T.StructField("node_id", T.IntegerType(), False),
        T.StructField("hostname", T.StringType(), False),
        T.StructField("port", T.IntegerType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("last_heartbeat", T.TimestampType(), True),
    ]
)
RECORD = "dir_partition_id bigint, segname string, rec_idx int, magic bigint, partition_id bigint, orig_node_lsn decimal(20,0), partition_lsn bigint, flags int"
NODE_LOG = "node_lsn bigint, rmid int, info int, magic bigint, partition_id bigint, orig_node_lsn bigint, partition_lsn bigint, flags int"
