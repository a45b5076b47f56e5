"""Operators of the partition log, catalog, routing, capture and demultiplexer on small hand-made inputs."""

import random

import pytest
from pyspark.sql import functions as F

from logweave import lsn
from logweave.operators import capture, catalog, checks, demux, joins, maintenance, metrics, routing
from logweave.sources import partlog

NODES = [(1, "coordinator", 5432, "active"), (2, "worker1", 5433, "active"), (3, "worker2", 5434, "active"), (9, "gone", 5439, "down"), (5, "sync", 5435, "syncing")]


def nodes(spark, rows=NODES):
    return spark.createDataFrame(rows, "node_id int, hostname string, port int, status string")


def partitions(spark, rows):
    return spark.createDataFrame([(p, n, s, 1) for p, n, s in rows], "partition_id long, primary_node int, secondary_nodes array<int>, version long").withColumn("updated_at", F.current_timestamp())


def log(spark, rows):
    """rows: (dir, segname, idx, partition, lsn, flags, magic)."""
    return spark.createDataFrame(rows, "dir_partition_id long, segname string, rec_idx int, partition_id long, partition_lsn long, flags int, magic long")


def whole(p, numbers, flags=1, per=3):
    return [(p, f"{1:08X}{0:08X}{1 + k // per:08X}", k % per, p, n, flags, lsn.MAGIC) for k, n in enumerate(numbers)]


@pytest.mark.parametrize("numbers,ok", [([1], True), ([1, 2, 3, 4, 5, 6, 7], True), ([1, 3], False), ([1, 1], False), ([2, 3], False), ([2, 1, 3], False)])
def test_verify(spark, numbers, ok):
    assert checks.verify(log(spark, whole(7, numbers))).first()["ok"] is ok


def test_verify_headers_flags_and_empty(spark):
    rows = whole(7, [1, 2, 3, 4])
    bad_flag = [(*r[:5], 3, r[6]) for r in rows]
    assert checks.verify(log(spark, bad_flag)).first()["ok"]
    assert [r["is_valid"] for r in checks.with_validity(log(spark, bad_flag)).collect()] == [False] * 4
    bad_magic = [(*rows[0][:6], 1), *rows[1:]]
    assert not checks.verify(log(spark, bad_magic)).first()["ok"]
    assert checks.headers(log(spark, bad_magic)).count() == 3
    listed = spark.createDataFrame([(7,), (8,)], "dir_partition_id long")
    assert {r[0]: r["ok"] for r in checks.verify_partitions(log(spark, rows), listed).collect()} == {7: True, 8: True}


def test_property_verify_against_model(spark):
    rng, rows, want = random.Random(5), [], {}
    for p in range(60):
        numbers = list(range(1, rng.randint(2, 12)))
        fault = rng.choice(["none", "gap", "dup", "magic", "pid"])
        if fault == "gap" and len(numbers) > 1:
            numbers.pop(rng.randrange(len(numbers) - 1))
        if fault == "dup":
            numbers.insert(0, numbers[0])
        mine = whole(p, numbers, per=rng.randint(1, 5))
        k = rng.randrange(len(mine))
        if fault == "magic":
            mine[k] = (*mine[k][:6], 5)
        if fault == "pid":
            mine[k] = (*mine[k][:3], p + 1, *mine[k][4:])
        rows += mine
        want[p] = all(r[6] == lsn.MAGIC and r[3] == p and r[4] == i + 1 for i, r in enumerate(mine))
    assert {r[0]: r["ok"] for r in checks.verify(log(spark, rows)).collect()} == want


def test_cleanup_breaks_verify(spark):
    rows = log(spark, whole(7, range(1, 8))).withColumn("segno", F.conv(F.substring("segname", 17, 8), 16, 10).cast("int"))
    left = maintenance.cleanup(rows, 2 * 16, 16)
    assert left.count() == 4 and not checks.verify(left).first()["ok"]
    assert checks.verify(left, first_lsn=4).first()["ok"]


def test_routes(spark):
    maps = partitions(spark, [(700, 1, []), (800, 2, [3]), (900, 9, []), (500, 5, []), (600, 6, []), (50, -1, [])])
    asked = spark.createDataFrame([(700,), (800,), (99999,), (900,), (500,), (600,), (50,), (None,)], "partition_id long")
    want = {700: "local", 800: "remote", 99999: "not_found", 900: "node_down", 500: "remote", 600: "remote", 50: "not_found", None: "not_found"}
    routed = routing.route_writes(asked, maps, nodes(spark), 1)
    assert {r["partition_id"]: r["route"] for r in routed.collect()} == want
    assert {r["partition_id"]: r["route"] for r in routing.route_writes(asked, maps, nodes(spark), -1).collect()}[700] == "remote"
    with pytest.raises(routing.WriteRejected):
        routing.guard(asked, maps, nodes(spark), 1)
    assert routing.guard(asked, maps, nodes(spark), -1).count() == 8


def test_catalog_rules_and_versions(spark):
    empty = nodes(spark, []).withColumn("last_heartbeat", F.lit(None).cast("timestamp"))
    good = catalog.insert(empty, nodes(spark), catalog.node_violations)
    assert good.count() == 5
    for row in [(10, "h", 0, "active"), (10, "h", 99999, "active"), (10, "h", 1, "invalid"), (1, "h", 1, "active")]:
        with pytest.raises(catalog.ConstraintError):
            catalog.insert(good, nodes(spark, [row]), catalog.node_violations)
    maps = partitions(spark, [(400, 1, [])])
    for node, version in ((2, 2), (3, 3)):
        maps = catalog.update_partitions(maps, spark.createDataFrame([(400, node, 99)], "partition_id long, primary_node int, version long"))
        assert maps.first()["version"] == version
    assert catalog.delete(maps, spark.createDataFrame([(400,)], "partition_id long"), "partition_id").count() == 0


def test_cache_serves_until_invalidated(spark):
    state = {"rows": [(700, 1, [])]}
    cache = catalog.MetadataCache(lambda: partitions(spark, state["rows"]), lambda: nodes(spark))
    assert cache.partitions().first()["primary_node"] == 1
    state["rows"] = [(700, 2, [])]
    assert cache.partitions().first()["primary_node"] == 1
    cache.invalidate()
    assert cache.partitions().first()["primary_node"] == 2 and cache.stats()["metadata_generation"] == 1


def test_capture(spark):
    names = spark.createDataFrame([("orders_102225",), ("t_123",), ("t_12a4",), ("t_",), ("a_b_1234",), (None,)], "n string")
    assert [r[0] for r in names.select(capture.is_shard_name(F.col("n"))).collect()] == [True, False, False, False, True, False]
    events = spark.createDataFrame([(1, "INSERT", 5, 10), (1, "INSERT", 5, 12), (1, "INSERT", 6, 11), (2, "SELECT", 5, 13), (3, "COPY", 5, 14)], "stmt_id long, op string, relid long, node_lsn long")
    got = {(r["stmt_id"], r["partition_id"]): r["orig_lsn"] for r in capture.capture(events).collect()}
    assert got == {(1, 5): 12, (1, 6): 11, (3, 5): 14}
    high = spark.createDataFrame([(5, 40)], "partition_id long, max_lsn long")
    numbered = {(r["stmt_id"], r["partition_id"]): r["partition_lsn"] for r in capture.numbered(capture.capture(events), high).collect()}
    assert numbered == {(1, 5): 41, (3, 5): 42, (1, 6): 1}


def test_demux_against_model(spark):
    rng, rows, want, mark = random.Random(3), [], set(), {}
    for arrival in range(400):
        p, n = rng.randint(1, 5), rng.randint(1, 60)
        rows.append((p, n, arrival))
        if n > mark.get(p, 0):
            mark[p] = n
            want.add((p, n, arrival))
    df = spark.createDataFrame(rows, "partition_id long, partition_lsn long, arrival long")
    assert {tuple(r) for r in demux.demux(df).select("partition_id", "partition_lsn", "arrival").collect()} == want
    assert demux.late(df).count() == 400 - len(want)


def test_latency(spark):
    df = spark.createDataFrame([(i, i) for i in range(1, 101)], "seq long, micros long")
    assert tuple(metrics.latency(df).first()) == pytest.approx((0.051, 0.100, 0.0505))
    assert tuple(metrics.latency(df.limit(0)).first()) == (None, None, None)


def test_partlog_round_trip_and_torn_tail(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    rows = [(p, p * 20000000 + n * 64, n, 1) for p in (1, 2, 3) for n in range(1, 11)]
    df = spark.createDataFrame(rows, "partition_id long, orig_node_lsn long, partition_lsn long, flags int")
    partlog.write(df, root)
    read = spark.read.format("partlog").option("path", root).load()
    native = partlog.scan(spark, root)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, native.collect())) and read.count() == 30
    assert all(r["ok"] for r in checks.verify(native).collect())
    file = next((tmp_path / "log" / "2").glob("0*"))
    file.write_bytes(file.read_bytes()[:-5])
    assert {r[0]: r[1] for r in partlog.counts(spark, root).collect()} == {1: 10, 2: 9, 3: 10}
    partlog.write(spark.createDataFrame([(2, 2 * 20000000 + 640, 10, 1)], df.schema), root)
    assert all(r["ok"] for r in checks.verify(partlog.scan(spark, root)).collect())
    assert {r["last_lsn"] for r in checks.last_lsn(partlog.scan(spark, root)).collect()} == {10}
    big = partlog.pack(1, 2**64 - 1, 2**40, 7)
    assert partlog.unpack(big + b"xx")[0][2:] == (2**64 - 1, 2**40, 7)


def test_streaming_demux_equals_batch(spark, tmp_path):
    from logweave.streaming import demux as stream

    rng = random.Random(9)
    rows = [(a, 128 if rng.random() < 0.9 else 7, 0, lsn.MAGIC if rng.random() < 0.95 else 1, rng.randint(1, 4), a * 64, rng.randint(1, 80), 1) for a in range(300)]
    schema = "node_lsn long, rmid int, info int, magic long, partition_id long, orig_node_lsn long, partition_lsn long, flags int"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):  # the query ends and starts again from its checkpoint between the parts
        spark.createDataFrame(rows[100 * k : 100 * k + 100], schema).coalesce(1).write.mode("append").parquet(source)
        query = stream.start(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "cp"))
        query.awaitTermination(120)
        assert query.exception() is None
    batch = demux.demux(demux.own_records(spark.createDataFrame(rows, schema)).withColumnRenamed("node_lsn", "arrival"))
    got = spark.read.parquet(f"{out}/log")
    assert sorted(map(tuple, got.select("partition_id", "partition_lsn", "arrival").collect())) == sorted(map(tuple, batch.select("partition_id", "partition_lsn", "arrival").collect()))


def test_asof_and_salted_joins(spark):
    left = spark.createDataFrame([("a", 5), ("a", 9), ("b", 1)], "k string, t long")
    right = spark.createDataFrame([("a", 4, "x"), ("a", 9, "y"), ("b", 2, "z")], "k string, t long, v string")
    got = {(r["k"], r["t"]): r["v"] for r in joins.asof_join(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {("a", 5): "x", ("a", 9): "y", ("b", 1): None}
    assert joins.salted_join(left, right.drop("t"), ["k"], 4).count() == 5
