"""Partition-log queries over logs derived from events and a catalog derived from orders and supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lsn
from ..operators import capture, catalog, checks, demux, maintenance, metrics, routing

SEGMENT = 16384  # bytes of the derived log's small segments
LOCAL_NODE = 7
KEEP_LSN = 16777216 + 100000

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = "WITH " + SQL_PRELUDE + sql if sql.startswith(",") else sql
        return f

    return register


SQL_PRELUDE = """log AS (SELECT event_id, 21000 + user_id % 16 AS partition_id, 16777216 + event_id * 64 AS orig_node_lsn,
  row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS partition_lsn,
  CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 4 ELSE 1 END AS flags FROM events),
glog AS (SELECT * FROM log WHERE NOT (partition_id % 4 = 3 AND partition_lsn = 5)),
phys AS (SELECT event_id, partition_id AS dir_partition_id, (16777216 + event_id * 64) // 16384 AS segno, orig_node_lsn, partition_lsn,
  CASE WHEN event_id % 103 = 50 AND partition_id % 2 = 0 THEN 1 ELSE 1346458196 END AS magic,
  CASE WHEN event_id % 101 = 50 AND partition_id % 3 = 0 THEN partition_id + 1 ELSE partition_id END AS partition_id,
  CASE WHEN event_id % 97 = 50 THEN 3 ELSE flags END AS flags FROM glog),
nodes AS (SELECT s_suppkey AS node_id, CASE s_suppkey % 10 WHEN 0 THEN 'down' WHEN 1 THEN 'syncing' ELSE 'active' END AS status FROM supplier),
parts AS (SELECT o_orderkey AS partition_id, o_custkey % 120 - 1 AS primary_node FROM orders),
asked AS (SELECT l_orderkey + l_linenumber % 3 AS partition_id, l_linenumber, l_orderkey FROM lineitem)
"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    rows = events.select(
        "event_id",
        (21000 + F.col("user_id") % 16).alias("partition_id"),
        (16777216 + F.col("event_id") * 64).alias("orig_lsn"),
        F.when(F.col("event_type") == "error", lsn.SKIP).when(F.col("event_type") == "signup", lsn.CHECKPOINT).otherwise(lsn.DATA).alias("flags"),
    )
    return capture.numbered(rows, order=("event_id",), piece=F.expr(f"orig_lsn div {SEGMENT}")).withColumnRenamed("orig_lsn", "orig_node_lsn")


def gappy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where("not (partition_id % 4 = 3 and partition_lsn = 5)")


def physical_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with directory, segment, place and some damage: wrong magics, partitions and flags."""
    rows = gappy_log(spark, sf_dir).withColumn("dir_partition_id", F.col("partition_id"))
    rows = rows.withColumn("segno", lsn.segment_number(F.col("orig_node_lsn"), SEGMENT)).withColumn("segname", lsn.segment_name(F.col("segno")))
    line = Window.partitionBy("dir_partition_id", "segname").orderBy("orig_node_lsn")
    return (
        rows.withColumn("rec_idx", F.row_number().over(line) - 1)
        .withColumn("magic", F.when(F.expr("event_id % 103 = 50 and partition_id % 2 = 0"), 1).otherwise(lsn.MAGIC))
        .withColumn("partition_id", F.when(F.expr("event_id % 101 = 50 and partition_id % 3 = 0"), F.col("partition_id") + 1).otherwise(F.col("partition_id")))
        .withColumn("flags", F.when(F.col("event_id") % 97 == 50, 3).otherwise(F.col("flags")))
    )


def node_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("node_id"))
    status = F.when(F.col("node_id") % 10 == 0, "down").when(F.col("node_id") % 10 == 1, "syncing").otherwise("active")
    return rows.select("node_id", F.concat(F.lit("worker"), F.col("node_id")).alias("hostname"), F.lit(5432).alias("port"), status.alias("status"))


def partition_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    replicas = F.transform(F.sequence(F.lit(1), (F.col("o_custkey") % 3 + 1).cast("int")), lambda i: ((F.col("o_custkey") + i) % 120).cast("int"))
    return rows.select(F.col("o_orderkey").alias("partition_id"), (F.col("o_custkey") % 120 - 1).alias("primary_node"), replicas.alias("secondary_nodes"), F.lit(1).cast("bigint").alias("version"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    return rows.select((F.col("l_orderkey") + F.col("l_linenumber") % 3).alias("partition_id"), "l_orderkey", "l_linenumber")


@query(""", x AS (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY partition_lsn) AS rn FROM glog)
SELECT partition_id, count(*) AS n_records, min(partition_lsn) AS min_lsn, max(partition_lsn) AS max_lsn,
 bool_and(partition_lsn = rn) AS is_contiguous, max(partition_lsn) - count(*) AS n_missing FROM x GROUP BY partition_id""")
def wal_continuity(spark, sf_dir):
    return checks.continuity(gappy_log(spark, sf_dir))


@query(", r AS (SELECT 1) SELECT dir_partition_id, partition_lsn, orig_node_lsn, flags, magic = 1346458196 AND partition_id = dir_partition_id AND flags IN (1, 2, 4) AS is_valid FROM phys")
def wal_check(spark, sf_dir):
    return checks.with_validity(physical_log(spark, sf_dir)).select("dir_partition_id", "partition_lsn", "orig_node_lsn", "flags", "is_valid")


@query(", r AS (SELECT 1) SELECT partition_id, partition_lsn, orig_node_lsn FROM phys WHERE magic = 1346458196 AND partition_id = dir_partition_id")
def wal_headers(spark, sf_dir):
    return checks.headers(physical_log(spark, sf_dir)).select("partition_id", "partition_lsn", "orig_node_lsn")


@query(", r AS (SELECT 1) SELECT dir_partition_id, count(*) AS n FROM phys GROUP BY ALL")
def wal_count(spark, sf_dir):
    return checks.record_counts(physical_log(spark, sf_dir))


@query(""", x AS (SELECT *, row_number() OVER (PARTITION BY dir_partition_id ORDER BY orig_node_lsn) AS rn FROM phys)
SELECT dir_partition_id, bool_and(magic = 1346458196 AND partition_id = dir_partition_id AND partition_lsn = rn) AS ok FROM x GROUP BY ALL""")
def wal_verify(spark, sf_dir):
    return checks.verify(physical_log(spark, sf_dir))


@query(""", x AS (SELECT partition_id, partition_lsn, lead(partition_lsn) OVER (PARTITION BY partition_id ORDER BY partition_lsn) AS nx FROM glog)
SELECT partition_id, partition_lsn + 1 AS gap_start, nx - 1 AS gap_end FROM x WHERE nx - partition_lsn > 1""")
def wal_gaps(spark, sf_dir):
    return checks.gaps(gappy_log(spark, sf_dir))


@query(""", x AS (SELECT partition_id, partition_lsn FROM log UNION ALL SELECT partition_id, partition_lsn FROM log WHERE partition_lsn % 50 = 7)
SELECT partition_id, partition_lsn, count(*) AS n FROM x GROUP BY ALL HAVING count(*) > 1""")
def wal_duplicates(spark, sf_dir):
    rows = log(spark, sf_dir)
    return checks.duplicates(rows.unionByName(rows.where("partition_lsn % 50 = 7")))


@query(", r AS (SELECT 1) SELECT dir_partition_id, max_by(partition_lsn, orig_node_lsn) AS last_lsn FROM phys WHERE magic = 1346458196 AND partition_id = dir_partition_id GROUP BY ALL")
def wal_last_lsn(spark, sf_dir):
    return checks.last_lsn(physical_log(spark, sf_dir))


@query(", r AS (SELECT 1) SELECT partition_id, count(*) FILTER (flags = 1) AS n_data, count(*) FILTER (flags = 2) AS n_skip, count(*) FILTER (flags = 4) AS n_checkpoint FROM log GROUP BY ALL")
def wal_flag_summary(spark, sf_dir):
    return checks.flag_summary(log(spark, sf_dir))


@query("SELECT event_id, printf('%X/%X', (16777216 + event_id * 6400000) // 4294967296, (16777216 + event_id * 6400000) % 4294967296) AS lsn_text FROM events")
def lsn_text(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return rows.select("event_id", lsn.lsn_text(16777216 + F.col("event_id") * 6400000).alias("lsn_text"))


@query("""SELECT event_id, printf('pg_parwal/%d/%08X%08X%08X', 21000 + user_id % 16, 1, (event_id * 1000) // 256, (event_id * 1000) % 256) AS path FROM events""")
def wal_path(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    return rows.select("event_id", lsn.segment_path(21000 + F.col("user_id") % 16, F.col("event_id") * 1000).alias("path"))


@query(""", r AS (SELECT 1) SELECT partition_id, partition_lsn, printf('partition_id=%d partition_lsn=%d orig_lsn=%X/%08X flags=0x%02X', partition_id, partition_lsn,
 orig_node_lsn // 4294967296, orig_node_lsn % 4294967296, flags) AS description FROM log""")
def wal_describe(spark, sf_dir):
    text = lsn.record_text(F.col("partition_id"), F.col("partition_lsn"), F.col("orig_node_lsn"), F.col("flags"))
    return log(spark, sf_dir).select("partition_id", "partition_lsn", text.alias("description"))


@query(""", r AS (SELECT 1) SELECT dir_partition_id AS partition_id, printf('%08X%08X%08X', 1, segno // 256, segno % 256) AS segname, count(*) AS n,
 min(orig_node_lsn) AS first_lsn, max(orig_node_lsn) AS last_lsn FROM phys GROUP BY ALL""")
def segment_summary(spark, sf_dir):
    return checks.segment_summary(physical_log(spark, sf_dir).withColumn("partition_id", F.col("dir_partition_id")))


@query(f""", k AS (SELECT * FROM phys WHERE (segno + 1) * 16384 > {KEEP_LSN}),
x AS (SELECT *, row_number() OVER (PARTITION BY dir_partition_id ORDER BY orig_node_lsn) AS rn FROM k)
SELECT dir_partition_id, count(*) AS n_left, bool_and(magic = 1346458196 AND partition_id = dir_partition_id AND partition_lsn = rn) AS verify_after FROM x GROUP BY ALL""")
def cleanup_survivors(spark, sf_dir):
    left = maintenance.cleanup(physical_log(spark, sf_dir), KEEP_LSN, SEGMENT)
    return checks.record_counts(left).withColumnRenamed("n", "n_left").join(checks.verify(left).withColumnRenamed("ok", "verify_after"), "dir_partition_id")


@query(", r AS (SELECT 1) SELECT partition_id, count(*) AS n FROM log WHERE partition_id NOT IN (21003, 21007) GROUP BY ALL")
def reset_survivors(spark, sf_dir):
    return maintenance.reset(log(spark, sf_dir), [21003, 21007]).groupBy("partition_id").agg(F.count("*").alias("n"))


@query(", r AS (SELECT 1) SELECT a.partition_id, a.l_linenumber, CASE WHEN primary_node >= 0 THEN primary_node END AS primary_node FROM asked a LEFT JOIN parts p USING (partition_id)")
def get_primary(spark, sf_dir):
    return routing.get_primary(requests(spark, sf_dir), partition_map(spark, sf_dir)).select("partition_id", "l_linenumber", "primary_node")


ROUTED = f""", routed AS (SELECT a.partition_id, a.l_linenumber, CASE WHEN primary_node IS NULL OR primary_node < 0 THEN 'not_found' WHEN status = 'down' THEN 'node_down'
 WHEN primary_node = {LOCAL_NODE} THEN 'local' ELSE 'remote' END AS route FROM asked a LEFT JOIN parts p USING (partition_id) LEFT JOIN nodes n ON n.node_id = p.primary_node)
"""


def routed(spark, sf_dir):
    return routing.route_writes(requests(spark, sf_dir), partition_map(spark, sf_dir), node_map(spark, sf_dir), LOCAL_NODE)


@query(ROUTED + "SELECT partition_id, l_linenumber, route FROM routed")
def route_write(spark, sf_dir):
    return routed(spark, sf_dir).select("partition_id", "l_linenumber", "route")


@query(ROUTED + "SELECT route, count(*) AS n FROM routed GROUP BY ALL")
def route_summary(spark, sf_dir):
    return routed(spark, sf_dir).groupBy("route").agg(F.count("*").alias("n"))


@query(ROUTED + "SELECT partition_id, l_linenumber, CASE route WHEN 'remote' THEN 'write to remote partition' ELSE 'primary node is down' END AS error FROM routed WHERE route IN ('remote', 'node_down')")
def write_guard(spark, sf_dir):
    return routing.rejected(routed(spark, sf_dir)).select("partition_id", "l_linenumber", "error")


@query("SELECT o_orderkey AS partition_id, i AS pos, (o_custkey + i + 1) % 120 AS node_id FROM orders, generate_series(0, 2) g(i) WHERE i <= o_custkey % 3")
def secondary_explode(spark, sf_dir):
    return routing.replicas(partition_map(spark, sf_dir)).select("partition_id", F.col("pos").cast("bigint").alias("pos"), F.col("node_id").cast("bigint").alias("node_id"))


@query("SELECT s_suppkey AS node_id, 'worker' || s_suppkey AS hostname, CASE s_suppkey % 10 WHEN 0 THEN 'down' WHEN 1 THEN 'syncing' ELSE 'active' END AS status FROM supplier")
def node_info(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("node_id"))
    return routing.get_node(rows, node_map(spark, sf_dir)).select("node_id", "hostname", "status")


@query("SELECT o_orderkey AS partition_id, 1 + count(l_orderkey) AS version FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def version_bump(spark, sf_dir):
    updates = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("partition_id"))
    return catalog.versions_after(partition_map(spark, sf_dir), updates)


@query("SELECT s_suppkey AS node_id, CASE WHEN (s_suppkey * 997) % 70000 NOT BETWEEN 1 AND 65535 THEN 'port_range' ELSE 'status_value' END AS rule FROM supplier WHERE (s_suppkey * 997) % 70000 NOT BETWEEN 1 AND 65535 OR s_suppkey % 13 = 5")
def node_violations(spark, sf_dir):
    odd = node_map(spark, sf_dir).withColumn("port", ((F.col("node_id") * 997) % 70000).cast("int")).withColumn("status", F.when(F.col("node_id") % 13 == 5, "asleep").otherwise(F.col("status")))
    return catalog.node_violations(odd).select("node_id", "rule")


@query(""", good AS (SELECT partition_id, primary_node FROM parts WHERE primary_node >= 0),
p AS (SELECT partition_id, count(*) AS n, partition_id IN (SELECT partition_id FROM good) AS known FROM asked GROUP BY ALL),
w AS (SELECT primary_node AS node_id, count(*) AS n, primary_node IN (SELECT node_id FROM nodes) AS known FROM asked JOIN good USING (partition_id) GROUP BY ALL)
SELECT (SELECT sum(CASE WHEN known THEN n - 1 ELSE 0 END) FROM p)::BIGINT AS partition_hits, (SELECT sum(CASE WHEN known THEN 1 ELSE n END) FROM p)::BIGINT AS partition_misses,
 (SELECT sum(CASE WHEN known THEN n - 1 ELSE 0 END) FROM w)::BIGINT AS node_hits, (SELECT sum(CASE WHEN known THEN 1 ELSE n END) FROM w)::BIGINT AS node_misses, 0::BIGINT AS metadata_generation""")
def cache_stats(spark, sf_dir):
    return catalog.cache_stats(requests(spark, sf_dir), partition_map(spark, sf_dir), node_map(spark, sf_dir))


@query("SELECT event_id // 10 AS stmt_id, 21000 + user_id % 16 AS partition_id, max(16777216 + event_id * 64) AS orig_lsn FROM events WHERE event_type <> 'view' GROUP BY ALL")
def capture_statements(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_type") == "view", "SELECT").when(F.col("event_type") == "click", "UPDATE").otherwise("INSERT")
    rows = events.select(F.expr("event_id div 10").alias("stmt_id"), op.alias("op"), (21000 + F.col("user_id") % 16).alias("relid"), (16777216 + F.col("event_id") * 64).alias("node_lsn"))
    return capture.capture(rows).select("stmt_id", "partition_id", "orig_lsn")


@query("""SELECT p_partkey, rel_name, regexp_matches(rel_name, '_[0-9]{4,}$') AS is_shard FROM
 (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'orders_' || (p_partkey * 517) WHEN 1 THEN 't_' || (p_partkey % 1000) WHEN 2 THEN 'a_b_' || p_partkey ELSE 't_12a' || p_partkey END AS rel_name FROM part)""")
def shard_filter(spark, sf_dir):
    key = F.col("p_partkey")
    name = F.when(key % 4 == 0, F.concat(F.lit("orders_"), key * 517)).when(key % 4 == 1, F.concat(F.lit("t_"), key % 1000)).when(key % 4 == 2, F.concat(F.lit("a_b_"), key)).otherwise(F.concat(F.lit("t_12a"), key))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", name.alias("rel_name"))
    return rows.withColumn("is_shard", capture.is_shard_name(F.col("rel_name")))


ARRIVALS = """, arrivals AS (SELECT partition_id, partition_lsn, event_id * 4 + CASE WHEN event_id % 7 = 3 THEN 241 ELSE 0 END AS arrival FROM log
 UNION ALL SELECT partition_id, partition_lsn, event_id * 4 + 1602 FROM log WHERE event_id % 11 = 4),
judged AS (SELECT *, partition_lsn > coalesce(max(partition_lsn) OVER (PARTITION BY partition_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kept FROM arrivals)
"""


def arrivals(spark, sf_dir):
    rows = log(spark, sf_dir)
    first = rows.select("partition_id", "partition_lsn", (F.col("event_id") * 4 + F.when(F.col("event_id") % 7 == 3, 241).otherwise(0)).alias("arrival"))
    again = rows.where("event_id % 11 = 4").select("partition_id", "partition_lsn", (F.col("event_id") * 4 + 1602).alias("arrival"))
    return first.unionByName(again)


@query(ARRIVALS + "SELECT partition_id, partition_lsn, arrival FROM judged WHERE kept")
def demux_dedup(spark, sf_dir):
    return demux.demux(arrivals(spark, sf_dir))


@query(ARRIVALS + "SELECT partition_id, partition_lsn, arrival FROM judged WHERE NOT kept")
def demux_late(spark, sf_dir):
    return demux.late(arrivals(spark, sf_dir))


@query(""", x AS (SELECT partition_id, partition_lsn, sum(CASE WHEN partition_lsn % 100 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY partition_id ORDER BY event_id) AS epoch FROM log)
SELECT partition_id, epoch::BIGINT AS epoch, count(*) AS n, max(partition_lsn) AS max_lsn FROM x GROUP BY ALL""")
def demux_epochs(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("is_reset", F.col("partition_lsn") % 100 == 1)
    return demux.with_epochs(rows, "event_id").groupBy("partition_id", "epoch").agg(F.count("*").alias("n"), F.max("partition_lsn").alias("max_lsn"))


@query(""", disk AS (SELECT partition_id, max(partition_lsn) AS last FROM log WHERE partition_lsn <= 20 + partition_id % 7 AND event_id % 3 <> 0 GROUP BY ALL)
SELECT l.partition_id, l.partition_lsn FROM log l LEFT JOIN disk d USING (partition_id) WHERE l.partition_lsn > coalesce(d.last, 0) AND event_id % 11 <> 5""")
def wal_redo(spark, sf_dir):
    """The log on disk ends early and has holes; some records to replay have a wrong magic."""
    rows = log(spark, sf_dir).withColumn("magic", F.when(F.col("event_id") % 11 == 5, 1).otherwise(lsn.MAGIC))
    return demux.replayed(rows, rows.where("partition_lsn <= 20 + partition_id % 7 and event_id % 3 <> 0")).select("partition_id", "partition_lsn")


@query(""", x AS (SELECT partition_id, event_id, (partition_lsn - 1) % 40 + 1 AS n, partition_id % 4 = 1 AS on_disk FROM log),
y AS (SELECT *, coalesce(max(n) OVER (PARTITION BY partition_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x)
SELECT partition_id, event_id AS arrival, n AS partition_lsn FROM y WHERE n = 1 AND before > 0 AND NOT on_disk""")
def demux_reset(spark, sf_dir):
    """Where numbering starts again at 1 after the log was emptied."""
    rows = log(spark, sf_dir).select("partition_id", F.col("event_id").alias("arrival"), ((F.col("partition_lsn") - 1) % 40 + 1).alias("partition_lsn"), (F.col("partition_id") % 4 == 1).alias("on_disk"))
    return demux.reset_marks(rows).where("is_reset").select("partition_id", "arrival", "partition_lsn")


@query(""", f AS (SELECT 21000 + i AS partition_id, i * 100 AS failed_at, CASE WHEN i % 2 = 0 THEN i * 150 END AS retried_at FROM range(0, 16, 3) t(i))
SELECT partition_id, event_id AS arrival, CASE WHEN failed_at IS NULL OR event_id < failed_at THEN 'written' WHEN retried_at IS NULL THEN 'stalled' WHEN event_id < retried_at THEN 'written late' ELSE 'written' END AS state FROM log LEFT JOIN f USING (partition_id)""")
def demux_stall(spark, sf_dir):
    """A failed write stalls its own partition until a retry."""
    i = F.col("id")
    failures = spark.range(0, 16, 3).select((21000 + i).alias("partition_id"), (i * 100).alias("failed_at"), F.when(i % 2 == 0, i * 150).alias("retried_at"))
    rows = log(spark, sf_dir).select("partition_id", F.col("event_id").alias("arrival"))
    return demux.stalled(rows, failures).select("partition_id", "arrival", "state")


@query(""", x AS (SELECT event_id, event_id % 13 NOT IN (5, 6, 7) AS ok FROM events WHERE event_id % 5 <> 0),
y AS (SELECT *, sum(ok::INT) OVER (ORDER BY event_id) AS run FROM x)
SELECT min(event_id) AS gap_start, max(event_id) AS gap_end, count(*) AS n_skipped, 4 AS tries FROM y WHERE NOT ok GROUP BY run""")
def wal_resync(spark, sf_dir):
    """Runs of unreadable records that the reader skips."""
    i = F.col("event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(i.alias("node_lsn"), F.when(i % 5 == 0, 7).otherwise(demux.RMID).alias("rmid"), F.lit(demux.INFO_DATA).alias("info"), F.when((i % 13).isin(5, 6, 7), 1).otherwise(lsn.MAGIC).alias("magic"))
    return demux.resync(rows)


@query(""", c AS (SELECT o_orderkey AS relid, CASE o_custkey % 3 WHEN 0 THEN 'orders_' || (100000 + o_orderkey) ELSE 't_' || (o_orderkey % 90) END AS rel_name FROM orders)
SELECT relid AS partition_id FROM c WHERE regexp_matches(rel_name, '_[0-9]{4,}$') AND relid NOT IN (SELECT l_orderkey FROM lineitem)""")
def capture_registrations(spark, sf_dir):
    """Partitions to register when relations are created."""
    k = F.col("o_orderkey")
    name = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("orders_"), 100000 + k)).otherwise(F.concat(F.lit("t_"), k % 90))
    created = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("relid"), name.alias("rel_name"))
    return capture.registrations(created, spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("partition_id")))


@query("""WITH e AS (SELECT event_id, user_id AS relid, CASE event_id % 4 WHEN 0 THEN 'a_' || (1000 + event_id) ELSE 'a' END AS alias, CASE event_id % 5 WHEN 0 THEN 'r_12345' ELSE 'r_12' END AS rel_name FROM events)
SELECT event_id FROM e WHERE relid % 7 = 0 OR event_id % 4 = 0 OR event_id % 5 = 0 OR relid % 11 = 3""")
def capture_filter(spark, sf_dir):
    """Which changes are logged: registered relations, shard names, and distributed tables on a worker."""
    i = F.col("event_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("relid"), F.when(i % 4 == 0, F.concat(F.lit("a_"), 1000 + i)).otherwise("a").alias("alias"), F.when(i % 5 == 0, "r_12345").otherwise("r_12").alias("rel_name"))
    users = events.select("relid").distinct()
    return capture.logged_relations(events, users.where("relid % 7 = 0").withColumnRenamed("relid", "partition_id"), users.where("relid % 11 = 3"), group_id=1).select("event_id")


@query("SELECT l_orderkey, l_linenumber, 1346458196::BIGINT AS magic, (l_partkey % 600) & 255 AS flags FROM lineitem WHERE l_suppkey % 9 <> 0")
def capture_explicit(spark, sf_dir):
    """Records asked for by call: flags are cut to a byte, nulls give none."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 9 != 0, F.col("l_orderkey")).alias("partition_id"), (F.col("l_partkey") % 600).alias("flags"))
    return capture.explicit_record(rows).select("l_orderkey", "l_linenumber", F.col("magic").cast("bigint").alias("magic"), "flags")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN o_custkey % 120 - 1 >= 0 THEN o_custkey % 120 - 1 END AS primary_node,
 CASE WHEN o_orderkey IS NOT NULL THEN array_to_string(list_transform(range(o_custkey % 3 + 1), lambda i: (o_custkey + i + 1) % 120), ',') END AS secondaries FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey + l_linenumber % 3""")
def get_entry(spark, sf_dir):
    found = routing.get_entry(requests(spark, sf_dir), partition_map(spark, sf_dir))
    return found.select("l_orderkey", "l_linenumber", F.col("primary_node").cast("bigint").alias("primary_node"), F.array_join(F.col("secondary_nodes").cast("array<string>"), ",").alias("secondaries"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'local' WHEN 1 THEN 'remote' WHEN 2 THEN 'not_found' WHEN 3 THEN 'node_down' ELSE 'unknown' END AS status, CASE event_id % 3 WHEN 0 THEN 'PARTWAL_DATA' WHEN 1 THEN 'PARTWAL_SKIP' END AS kind FROM events")
def status_names(spark, sf_dir):
    i = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", routing.status_text(i % 6).alias("status"), lsn.record_kind(i % 3 * 16).alias("kind"))


@query("""WITH p AS (SELECT o_orderkey // 2 AS partition_id, nullif(o_custkey % 120, 7) AS primary_node FROM orders)
SELECT partition_id, CASE WHEN primary_node IS NULL THEN 'not_null' ELSE 'primary_key' END AS rule FROM (SELECT *, count(*) OVER (PARTITION BY partition_id) AS n FROM p) WHERE primary_node IS NULL OR n > 1""")
def partition_violations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr("o_orderkey div 2").alias("partition_id"), F.expr("nullif(o_custkey % 120, 7)").alias("primary_node"), F.array().cast("array<int>").alias("secondary_nodes"), F.lit(1).alias("version"))
    return catalog.partition_violations(rows).select("partition_id", "rule")


@query(""", h AS (SELECT dir_partition_id, max(segno) AS segno FROM phys GROUP BY ALL),
r AS (SELECT p.*, row_number() OVER (PARTITION BY dir_partition_id ORDER BY orig_node_lsn DESC) AS back FROM phys p JOIN h USING (dir_partition_id, segno)),
f AS (SELECT dir_partition_id, CASE WHEN dir_partition_id % 2 = 0 THEN max(partition_lsn) FILTER (magic = 1346458196 AND partition_id = dir_partition_id) ELSE max(partition_lsn) FILTER (back = 1) END AS last FROM r GROUP BY dir_partition_id)
SELECT a.p AS dir_partition_id, coalesce(last, 0) AS last_lsn FROM (SELECT unnest(range(21000, 21020)) AS p) a LEFT JOIN f ON dir_partition_id = a.p""")
def wal_last_written(spark, sf_dir):
    """Where writing goes on, with torn tails in some partitions and none missing from the result."""
    rows = physical_log(spark, sf_dir)
    torn = rows.where("dir_partition_id % 2 = 0").groupBy("dir_partition_id").agg(F.max("segname").alias("segname"))
    return checks.last_written(rows, spark.range(21000, 21020).select(F.col("id").alias("dir_partition_id")), torn)


@query(", r AS (SELECT 1) SELECT flags AS kind, count(*) AS n_records, (count(*) * 32)::BIGINT AS n_bytes, min(orig_node_lsn) AS first_lsn, max(orig_node_lsn) AS last_lsn FROM log GROUP BY ALL")
def wal_stats(spark, sf_dir):
    """What the log holds, by kind of record."""
    return log(spark, sf_dir).groupBy(F.col("flags").alias("kind")).agg(F.count("*").alias("n_records"), (F.count("*") * lsn.RECORD_BYTES).alias("n_bytes"), F.min("orig_node_lsn").alias("first_lsn"), F.max("orig_node_lsn").alias("last_lsn"))


@query("""WITH last AS (SELECT event_id, (value * 1000)::BIGINT AS us FROM (SELECT event_id, floor(value) AS value FROM events ORDER BY event_id DESC LIMIT 1024)),
s AS (SELECT list(us ORDER BY us) AS l, avg(us::DOUBLE) / 1000 AS avg_ms FROM last)
SELECT l[len(l) // 2 + 1] / 1000.0::DOUBLE AS p50_ms, l[len(l) * 99 // 100 + 1] / 1000.0::DOUBLE AS p99_ms, avg_ms FROM s""")
def demux_latency(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), (F.floor("value") * 1000).alias("micros"))
    return metrics.latency(rows)


@query(", r AS (SELECT 1) SELECT 'local' AS node_name, max(orig_node_lsn) AS last_processed_lsn FROM log")
def progress(spark, sf_dir):
    return metrics.progress(log(spark, sf_dir))


@query("SELECT '1.0' AS version")
def version(spark, sf_dir):
    return spark.range(1).select(F.lit(catalog.VERSION).alias("version"))


@query("""WITH s AS (SELECT o_orderkey AS shardid, o_custkey % 40 AS logicalrelid FROM orders), p AS (SELECT l_orderkey AS shardid, l_suppkey AS node_id FROM lineitem)
SELECT logicalrelid, node_id, count(*) AS n FROM s JOIN p USING (shardid) GROUP BY ALL""")
def shard_placement(spark, sf_dir):
    shards = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("shardid"), (F.col("o_custkey") % 40).alias("logicalrelid"))
    places = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("shardid"), F.col("l_suppkey").alias("node_id"))
    return shards.join(places, "shardid").groupBy("logicalrelid", "node_id").agg(F.count("*").alias("n"))


@query(""", bounds AS (SELECT i AS shardid, i * 10000 AS lo, i * 10000 + 9999 AS hi FROM generate_series(0, 40) g(i))
SELECT shardid, count(*) AS n FROM asked JOIN bounds ON (partition_id * 7) % 400000 BETWEEN lo AND hi GROUP BY ALL""")
def shard_by_range(spark, sf_dir):
    from ..operators.joins import range_join

    bounds = spark.range(41).select(F.col("id").alias("shardid"), (F.col("id") * 10000).alias("lo"), (F.col("id") * 10000 + 9999).alias("hi"))
    rows = requests(spark, sf_dir).withColumn("h", (F.col("partition_id") * 7) % 400000)
    return range_join(rows, "h", bounds, "lo", "hi", 10000).groupBy("shardid").agg(F.count("*").alias("n"))
