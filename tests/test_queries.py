"""Every query with SQL gives the same rows in Spark and DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from logweave import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    missing = lambda v: v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v)
    show = lambda v: "~" if missing(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_joins_of_whole_tables(spark):
    rows = {t: spark.read.parquet(f"{SF}/{t}.parquet").toPandas() for t in ("customer", "orders", "supplier")}
    customers, orders, suppliers = set(rows["customer"].c_custkey), rows["orders"], set(rows["supplier"].s_suppkey)
    found = {how: catalogue.QUERIES[f"join_{how}"](spark, SF).toPandas() for how in ("inner", "left", "right", "full")}
    assert set(found["inner"].o_orderkey) == set(orders.o_orderkey[orders.o_custkey.isin(customers)])
    assert set(found["left"].c_custkey) == customers and found["left"].o_orderkey.isna().any()
    assert set(found["right"].o_orderkey) == set(orders.o_orderkey) and found["right"].c_custkey.isna().any()
    assert set(found["full"].c_custkey.dropna()) == customers and set(found["full"].s_suppkey.dropna()) == suppliers
    assert found["full"].c_custkey.isna().any() and found["full"].s_suppkey.isna().any()


def test_queries_of_all_rows(spark):
    rows = {t: spark.read.parquet(f"{SF}/{t}.parquet").toPandas() for t in ("events", "part", "customer", "supplier", "orders", "lineitem")}
    got = {n: catalogue.QUERIES[n](spark, SF).toPandas() for n in ("join_range", "shard_placement", "modify_merge", "modify_returning", "modify_on_conflict")}
    pairs = [(e, p) for e, v in zip(rows["events"].event_id, rows["events"].value) for p, z in zip(rows["part"].p_partkey, rows["part"].p_size) if z * 10 <= v * 10 <= z * 10 + 3]
    assert sorted(got["join_range"][["event_id", "p_partkey"]].itertuples(index=False, name=None)) == sorted(pairs) and max(pairs)[0] >= 500
    assert set(got["shard_placement"].logicalrelid) == set(rows["orders"].o_custkey % 40) and got["shard_placement"].n.sum() == rows["lineitem"].l_orderkey.isin(rows["orders"].o_orderkey).sum()
    old, new = dict(zip(rows["supplier"].s_suppkey, rows["supplier"].s_acctbal)), dict(zip(rows["customer"].c_custkey * 3, rows["customer"].c_acctbal))
    want = {k: new.get(k, old.get(k)) for k in old.keys() | new.keys() if not new.get(k, 0) < 0}
    assert dict(zip(got["modify_merge"].s_suppkey, got["modify_merge"].s_acctbal)) == want and len(got["modify_merge"]) == len(want)
    assert set(got["modify_returning"].s_suppkey) == {k for k, v in new.items() if k in old or not v < 0}
    assert sorted(got["modify_on_conflict"].k) == sorted(set(old) | set(rows["customer"].c_custkey * 2))


def test_entry(spark, duck):
    import __spark_entry__

    want = duck.execute(catalogue.ORACLES["wal_continuity"]).df()
    assert plain(__spark_entry__.entry(spark).toPandas()) == plain(want)


def test_queries_without_sql(spark):
    run = lambda name: catalogue.QUERIES[name](spark, SF).toPandas()
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    some = run("sample_bernoulli")
    assert 0.05 * events < len(some) < 0.15 * events and sorted(some.event_id) == sorted(run("sample_bernoulli").event_id)
    assert len(run("sample_rows")) == 100 and len(run("sample_system")) % 256 in (0, events % 256)
    numbers, again = run("fn_random"), run("fn_random")
    assert numbers.u.between(0, 1).all() and abs(numbers.g.mean()) < 0.3 and (numbers.u == again.u).all()
    assert run("fn_uuid").id.str.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}").all()
    assert {n for n in catalogue.QUERIES if n not in catalogue.ORACLES} == {"sample_bernoulli", "sample_rows", "sample_system", "fn_random", "fn_uuid"}


def test_no_query_is_cut_by_id():
    """Registered SQL holds no row cap or id filter beyond the top-k reports and the keys that a point lookup asks for."""
    import re

    capped = {n for n, text in catalogue.ORACLES.items() if re.search(r"\bLIMIT\b|_(?:id|key|suppkey|custkey)\s*<\s*\d", text)}
    assert capped <= {"top_k", "demux_latency", "join_lateral", "agg_mode"}, capped


def test_lateral_limit_is_ordered(spark, tmp_path):
    """Nulls among prices and keys come last as in the SQL, and the window that numbers a customer's orders has their order."""
    c = duckdb.connect()
    c.execute("CREATE TABLE customer AS SELECT i AS c_custkey FROM range(5) t(i)")
    c.execute("CREATE TABLE orders AS SELECT * FROM (VALUES (NULL, 1, 9.5), (7, 1, 9.5), (3, 1, 9.5), (4, 2, NULL), (5, 2, 1.5), (NULL, 3, 2.0), (8, 3, 2.0), (6, NULL, 8.0), (9, 4, NULL), (2, 4, NULL), (1, 4, NULL)) t(o_orderkey, o_custkey, o_totalprice)")
    for t, cast in (("customer", "c_custkey::BIGINT AS c_custkey"), ("orders", "o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, o_totalprice::DOUBLE AS o_totalprice")):
        c.execute(f"COPY (SELECT {cast} FROM {t}) TO '{tmp_path}/{t}.parquet'")
    got = catalogue.QUERIES["join_lateral"](spark, str(tmp_path))
    assert plain(got.toPandas()) == plain(c.execute(catalogue.ORACLES["join_lateral"]).df())
    import re

    windows = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*)", got._jdf.queryExecution().executedPlan().toString())
    assert windows and all("o_totalprice" in w and "o_orderkey" in w for w in windows), windows


def test_range_join_packs_equal_ranges(spark):
    """Ranges of equal ends meet points as packs: the joins give few rows where the result has many, and no pair is lost, made twice or out of its columns."""
    from logweave.operators import joins

    points = [(i, i % 40 / 4.0) for i in range(200)] + [(900, None), (901, -3.0)]
    ranges = [("a", 1, 3)] * 2 + [(f"n{i}", 2, 5) for i in range(500)] + [("wide", -7, 30), ("none", 4, 3), ("open", None, 3), (None, 2, 5)]
    got = joins.range_join(spark.createDataFrame(points, "i long, v double"), "v", spark.createDataFrame(ranges, "name string, lo int, hi int"), "lo", "hi", 2)
    assert got.columns == ["i", "v", "name", "lo", "hi"]
    rows = got.collect()
    want = [(i, v, n, lo, hi) for i, v in points for n, lo, hi in ranges if v is not None and lo is not None and lo <= v <= hi]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert joins.range_join(spark.createDataFrame(points, "i long, v double"), "v", spark.createDataFrame(ranges, "name string, lo int, hi int").select("lo", "hi"), "lo", "hi", 2).count() == len(want)

    def plans(p):
        yield p
        below = [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in p.nodeName() else [p.children().apply(k) for k in range(p.children().size())]
        for x in below:
            yield from plans(x)

    made = [p.metrics().apply("numOutputRows").value() for p in plans(got._jdf.queryExecution().executedPlan()) if "Join" in p.nodeName()]
    assert len(want) > 30_000 and made and max(made) < len(want) / 10, (made, len(want))
