"""The functions under their SQL names."""

from logweave.functions import sql_names
from logweave.plans import log_queries as q

SF = "/root/testdata/sf0.001"


def test_functions(spark):
    names = sql_names.register(spark, q.physical_log(spark, SF), q.partition_map(spark, SF), q.node_map(spark, SF), q.LOCAL_NODE)
    assert len(names) == 11
    one = lambda text: spark.sql(text).first()[0]
    assert one("SELECT partdist_version()") == "1.0" and one("SELECT lsn_text(4294967296 * 3 + 255)") == "3/FF"
    assert one("SELECT partition_wal_path(7, 257)") == "pg_parwal/7/000000010000000100000001"
    assert [r[0] for r in spark.sql("SELECT is_shard_name(n) FROM VALUES ('orders_102225'), ('t_123'), (NULL) v(n)").collect()] == [True, False, False]
    n = one("SELECT count_parwal_records(21000)")
    assert n == one("SELECT count(*) FROM check_partition_wal(21000)") > 0 and one("SELECT count(*) FROM read_all_headers(21000)") <= n
    assert one("SELECT count_parwal_records(5)") == 0 and one("SELECT verify_partition_wal(5)") is True and one("SELECT verify_partition_wal(NULL)") is None
    assert one("SELECT verify_partition_wal(21003)") is False
    assert one("SELECT node_name FROM demux_progress()") == "local"
    want = {(r["partition_id"], r["route"]) for r in q.routed(spark, SF).select("partition_id", "route").distinct().limit(50).collect()}
    got = spark.createDataFrame(sorted(want), "p long, want string")
    got.createOrReplaceTempView("asked")
    assert spark.sql("SELECT count(*) FROM asked WHERE route_write(p) <> want").first()[0] == 0
    assert one("SELECT get_primary(99999999)") is None and one("SELECT route_write(NULL)") == one("SELECT route_write(0)") and one("SELECT route_write(99999999)") == "not_found"
