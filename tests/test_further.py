"""Catalog cache, file maintenance, streams into segments, COPY, tables and views, skewed joins, and packaging."""

import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from logweave import lsn
from logweave.functions import compat, textsearch
from logweave.operators import capture, catalog, checks, ddl, demux, distribution, joins, maintenance, recursion, routing
from logweave.sources import partlog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def maps(spark):
    nodes = spark.createDataFrame([(1, "a", 1, "active"), (2, "b", 2, "active"), (9, "c", 3, "down")], "node_id int, hostname string, port int, status string")
    parts = spark.createDataFrame([(700, 1), (800, 2), (900, 9), (50, -1), (60, 6)], "partition_id long, primary_node int")
    return parts, nodes


def test_cache_counts(spark):
    parts, nodes = maps(spark)
    cache = catalog.MetadataCache(lambda: parts, lambda: nodes)
    asked = [700, 700, 99, 99, 900, 50, 50, 60, 60, 800, 700, None]
    want = {700: "local", 800: "remote", 900: "node_down", 99: "not_found", 50: "not_found", 60: "remote", None: "not_found"}
    assert [cache.route_write(p, 1) for p in asked] == [want[p] for p in asked]
    batch = catalog.cache_stats(spark.createDataFrame([(p,) for p in asked], "partition_id long"), parts, nodes).first().asDict()
    assert cache.stats() == batch and batch["partition_hits"] == 3 and batch["node_misses"] == 5
    cache.invalidate()
    assert cache.get_primary(700) == 1 and cache.stats()["partition_misses"] == batch["partition_misses"] + 1 and cache.stats()["metadata_generation"] == 1


def test_local_node_setting(spark):
    assert routing.local_node(spark) == -1
    spark.conf.set(routing.SETTING, "7")
    assert routing.local_node(spark) == 7
    spark.conf.unset(routing.SETTING)
    parts, nodes = maps(spark)
    asked = spark.createDataFrame([(700,), (800,)], "partition_id long")
    with pytest.raises(Exception, match="write rejected"):
        routing.guarded(asked, parts, nodes, 1).collect()
    assert routing.guarded(asked, parts, nodes, -1).count() == 2


def test_joins_with_hot_keys(spark):
    big = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7), (9, 7), (9, 7)], "k long, _salt long")
    other = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (3, "w")], "k long, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want, got = big.join(other, ["k"], how), joins.salted_join(big, other, ["k"], 4, how)
        assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    for how in ("right", "full"):
        with pytest.raises(ValueError):
            joins.salted_join(big, other, ["k"], 4, how)
    assert [r["k"] for r in joins.hot_keys(big, ["k"], 0.5).collect()] == [1]
    assert sorted(map(tuple, joins.skewed_join(big, other, ["k"], 4, 0.5).collect())) == sorted(map(tuple, big.join(other, ["k"]).collect()))


def test_closures_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)] + [(k, k + 1) for k in range(10, 40)], "src long, dst long")
    start = spark.createDataFrame([(1,), (4,), (10,)], "origin long")
    got = {(r["origin"], r["node"]) for r in recursion.reachable(edges, start).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (4, 4)} | {(10, k) for k in range(10, 41)}
    walks = recursion.paths(edges, start).where("origin < 10").collect()
    assert {tuple(r["path"]) for r in walks if r["is_cycle"]} == {(1, 2, 3, 1), (4, 4)}


def test_segment_files(spark, tmp_path):
    root, size = f"file://{tmp_path}/log", 64
    rows = [(p, n * 32, n, 1) for p in (1, 2) for n in range(1, 11)]
    partlog.write(spark.createDataFrame(rows, "partition_id long, orig_node_lsn long, partition_lsn long, flags int"), root, size)
    assert maintenance.partition_exists(root, 1) and not maintenance.partition_exists(root, 3) and maintenance.partition_exists(root, None) is None
    maintenance.init_partition(root, 3)
    maintenance.init_partition(root, 3)
    assert maintenance.partition_exists(root, 3) and checks.verify_partitions(partlog.scan(spark, root), spark.createDataFrame([(3,)], "dir_partition_id long")).first()["ok"]
    gone = maintenance.cleanup_files(root, 1, 4 * size, size)
    assert len(gone) == 3 and maintenance.cleanup_files(root, 1, None) is None and maintenance.cleanup_files(root, 77, 10**9) == []
    left = {r["partition_lsn"] for r in partlog.scan(spark, root).where("dir_partition_id = 1").collect()}
    assert left == {n for n in range(1, 11) if (max(1, n * 32 // size) + 1) * size > 4 * size}
    assert not {r[0]: r["ok"] for r in checks.verify(partlog.scan(spark, root)).collect()}[1]
    assert len(maintenance.cleanup_files(root, 2, 2**64 - 1, size)) > 0 and {r[0] for r in partlog.counts(spark, root).collect()} == {1}
    assert maintenance.reset_files(root, 1) and maintenance.reset_files(root, None) is None and not partlog.exists(root) and maintenance.partition_exists(root, 1)


def test_last_written_with_torn_tail(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    rows = [(p, n * 32, n, 1) for p in (1, 2) for n in range(1, 8)]
    partlog.write(spark.createDataFrame(rows, "partition_id long, orig_node_lsn long, partition_lsn long, flags int"), root, 64)
    file = max((tmp_path / "log" / "2").glob("0*"))
    file.write_bytes(file.read_bytes()[:-5])
    torn = partlog.torn(spark, root)
    assert [(r[0], r[1]) for r in torn.collect()] == [(2, file.name)]
    listed = spark.createDataFrame([(1,), (2,), (5,)], "dir_partition_id long")
    got = {r[0]: r["last_lsn"] for r in checks.last_written(partlog.scan(spark, root), listed, torn).collect()}
    assert got == {1: 7, 2: 6, 5: 0}


def test_registration_makes_folders(spark, tmp_path):
    created = spark.createDataFrame([(1, "orders_102225"), (2, "plain"), (3, "t_1234"), (3, "t_1234")], "relid long, rel_name string")
    known = spark.createDataFrame([(1,)], "partition_id long")
    got = maintenance.register_created(f"file://{tmp_path}", created, known).collect()
    assert [(r["partition_id"], r["warning"]) for r in got] == [(3, None)] and (tmp_path / "3").is_dir()
    (tmp_path / "blocked").write_text("")
    bad = maintenance.register_created(f"file://{tmp_path}/blocked", created, known).collect()
    assert bad[0]["warning"]


def test_numbering_by_pieces(spark):
    rows = spark.createDataFrame([(p, n, n % 3) for p in (1, 2) for n in range(40)], "partition_id long, orig_lsn long, stmt_id long")
    plain = capture.numbered(rows)
    pieces = capture.numbered(rows, piece=F.expr("orig_lsn div 7"))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, pieces.select(plain.columns).collect()))
    high = spark.createDataFrame([(1, 100)], "partition_id long, max_lsn long")
    assert capture.numbered(rows, high, piece=F.expr("orig_lsn div 7")).agg(F.max("partition_lsn")).first()[0] == 140


def test_judging_by_pieces(spark):
    import random

    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.randint(1, 3), rng.randint(1, 50), a) for a in range(200)], "partition_id long, partition_lsn long, arrival long")
    for chunk in (1, 7, 10**6):
        got = {(r["partition_id"], r["arrival"]) for r in demux.demux(rows, chunk=chunk).collect()}
        mark, want = {}, set()
        for p, n, a in sorted(map(tuple, rows.collect()), key=lambda r: r[2]):
            if n > mark.get(p, 0):
                mark[p] = n
                want.add((p, a))
        assert got == want
    for piece in (1, 5, 10**6):
        log = spark.createDataFrame([(1, n) for n in (1, 2, 5, 6, 20, 21, 22, 40)], "partition_id long, partition_lsn long")
        assert sorted((r["gap_start"], r["gap_end"]) for r in checks.gaps(log, piece).collect()) == [(3, 4), (7, 19), (23, 39)]


NODE_LOG = "node_lsn long, rmid int, info int, magic long, partition_id long, orig_node_lsn long, partition_lsn long, flags int, is_reset boolean"


def test_stream_into_segments(spark, tmp_path):
    from logweave.streaming import demux as stream

    source, root = str(tmp_path / "in"), f"file://{tmp_path}/log"
    own = lambda a, p, n: (a, 128, 0, lsn.MAGIC, p, a * 64, n, 1, False)
    schema = spark.createDataFrame([], NODE_LOG).schema
    for k, rows in enumerate([[own(1, 1, 1), own(2, 2, 1), own(3, 1, 2)], [own(4, 1, 2), own(5, 1, 3), own(6, 2, 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = stream.start_to_segments(spark.readStream.schema(schema).parquet(source), root, str(tmp_path / "cp"), segment_bytes=128)
        query.awaitTermination(120)
        assert query.exception() is None
        # A batch that was written but not committed runs again and adds nothing.
        again = stream.start_to_segments(spark.readStream.schema(schema).parquet(source), root, str(tmp_path / f"cp again {k}"), segment_bytes=128)
        again.awaitTermination(120)
    log = partlog.scan(spark, root)
    assert {r[0]: r["n"] for r in checks.record_counts(log).collect()} == {1: 3, 2: 2} and all(r["ok"] for r in checks.verify(log).collect())


def test_flush_and_progress(spark, tmp_path):
    from logweave.streaming import demux as stream

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], NODE_LOG).schema
    assert tuple(stream.progress(spark, out).first()) == ("local", None)
    spark.createDataFrame([(1, 128, 0, lsn.MAGIC, 1, 64, 1, 1, False), (2, 128, 0, lsn.MAGIC, 1, 128, 1, 1, False)], schema).coalesce(1).write.mode("append").parquet(source)
    query = stream.start(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "cp"), processingTime="0 seconds")
    try:
        assert stream.flush(query, 60)
        assert tuple(stream.progress(spark, out).first()) == ("local", 128)
    finally:
        query.stop()
    slow = spark.readStream.format("rate").load().writeStream.foreachBatch(lambda rows, _: time.sleep(3)).option("checkpointLocation", str(tmp_path / "slow")).start()
    try:
        start = time.monotonic()
        with pytest.warns(UserWarning):
            assert not stream.flush(slow, 0.3)
        assert time.monotonic() - start < 2.5
    finally:
        slow.stop()


def test_judging_a_stream_with_resets():
    import pandas as pd

    from logweave.streaming.demux import _judge

    class State:
        exists, get = True, (3, 0)

        def update(self, value):
            self.value = value

    rows = pd.DataFrame({"partition_id": 1, "partition_lsn": [3, 4, 1, 1, 2, 2, 1, 5], "orig_node_lsn": 0, "flags": 1, "arrival": range(8), "is_reset": [False, False, True, True, False, False, False, False]})
    state = State()
    out = next(_judge((1,), iter([rows]), state))
    assert out.kept.tolist() == [False, True, True, True, True, False, False, True] and out.epoch.tolist() == [0, 0, 1, 2, 2, 2, 2, 2] and state.value == (5, 2)


def test_event_time_and_stream_joins(spark, tmp_path):
    from logweave.streaming import demux as stream

    rows = [("a", f"2024-01-01 0{h}:10:00", h) for h in range(5)]
    df = spark.createDataFrame(rows, "event_type string, t string, v long").select("event_type", F.to_timestamp("t").alias("ts"), "v")
    df.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def rows_of(result, name, mode="append"):
        query = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return spark.table(name)

    assert rows_of(stream.windowed_counts(read()), "hours", "update").agg(F.sum("n")).first()[0] == 5
    assert rows_of(stream.session_counts(read(), key="event_type"), "sessions", "complete").count() == 5
    pairs = rows_of(stream.matched(read(), read(), "event_type", "1 hour"), "pairs")
    assert sorted((r["left_v"], r["right_v"]) for r in pairs.collect()) == sorted((a, b) for a in range(5) for b in (a, a + 1) if b < 5)


@pytest.mark.parametrize("form", ["csv", "text", "binary"])
def test_copy_round_trip(spark, tmp_path, form):
    rows = spark.createDataFrame([(1, 'a,"b"', 1.5), (2, None, None), (3, "tab\there \\ back", -2.0), (4, "", 0.0), (5, "two\nlines", 1.0)], "k long, t string, x double")
    ddl.copy_to(rows, str(tmp_path / form), form)
    back = ddl.copy_from(spark, str(tmp_path / form), "k long, t string, x double", form)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_tables_and_views(spark, tmp_path):
    folder = ddl.Folder(spark, str(tmp_path))
    folder.create_table_as("t", spark.range(5).withColumnRenamed("id", "k"))
    folder.create_view("v", lambda: folder.table("t").where("k > 1"))
    assert folder.create_materialized_view("m", lambda: folder.table("t").agg(F.count("*").alias("n"))).first()["n"] == 5
    folder.create_table_as("t", folder.table("t").unionByName(spark.createDataFrame([(9,)], "k long")))
    assert folder.view("v").count() == 4 and folder.table("m").first()["n"] == 5 and folder.refresh("m").first()["n"] == 6
    assert folder.truncate("t").count() == 0 and folder.view("v").count() == 0
    folder.drop("t")
    with pytest.raises(KeyError):
        folder.table("t")


def test_distributed_tables(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    distribution.write_distributed(rows, "k", 4, str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d"))
    assert back.count() == 1000 and back.select("shardid").distinct().count() == 4
    one = distribution.prune(back, "k", [17], 4)
    assert [r["v"] for r in one.collect()] == [34] and len({f.rsplit("/", 2)[-2] for f in one.inputFiles()}) <= 4
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shardid" in plan or "PartitionFilters" in plan and "shardid" in plan
    joined = distribution.colocated_join(distribution.distribute(rows, "k", 4), distribution.distribute(rows.withColumnRenamed("v", "w"), "k", 4), "k")
    assert joined.count() == 1000


def test_patterns_and_search():
    assert compat.date_pattern("YYYY-MM-DD HH24:MI:SS") == "yyyy-MM-dd HH:mm:ss" and compat.date_pattern("Day DD") == "'Day' dd"
    assert "the" in textsearch.STOP


def test_division_by_zero_is_an_error(spark):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        spark.sql("SELECT 1 / id FROM range(1)").collect()


def test_imports_without_the_training_subpackage(tmp_path):
    """Without the subpackage the rest imports; a module that fails within it is an error."""
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__"))
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sum(n.startswith('op') and n[2].isdigit() for n in e.queries()))"], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
    shutil.rmtree(copy / "logweave" / "llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert run().stdout.strip() == "0"
    (copy / "logweave" / "llm").mkdir()
    (copy / "logweave" / "llm" / "__init__.py").write_text("")
    (copy / "logweave" / "llm" / "queries.py").write_text("import numpy_that_is_missing")
    (copy / "corpus_pipeline.py").write_text("")
    assert "numpy_that_is_missing" in run().stderr
