"""Relational queries over the shared tables: one for each operator family, in Spark SQL or the DataFrame API.

Where both engines read the same text it stands once; where Spark lacks a form
(DISTINCT ON, WITH TIES, GROUPS and EXCLUDE frames, FILTER over windows, ANY and
ALL over subqueries, SYMMETRIC, array and date forms) the Spark side is the
rewrite and the DuckDB side the form itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import compat
from ..operators import joins

TABLES = "region nation customer supplier part orders lineitem events".split()

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query whose Spark SQL names tables in braces, so no view of the session is touched."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
        return spark.sql(text, **used)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle or text.replace("{", "").replace("}", "")


def frame(oracle: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return register


# Scans, projection, filters

sql("scan_project", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem}")
sql("scan_pushdown", "SELECT l_orderkey, l_extendedprice FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_quantity < 5")
sql("scan_or_filters", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F' OR o_totalprice > 200000 OR o_orderkey BETWEEN 10 AND 20")
sql("values_scan", "SELECT v.a, v.b FROM (VALUES (1, 'x'), (2, 'y'), (NULL, 'z')) AS v(a, b)")
sql("cte_scan", "WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) SELECT n, count(*) AS customers FROM big GROUP BY n")
sql("function_scan", "SELECT n_nationkey, s.i AS i FROM {nation} LATERAL VIEW explode(sequence(1, 3)) s AS i", "SELECT n_nationkey, i FROM nation, generate_series(1, 3) g(i)")
sql("with_ordinality", "SELECT n_nationkey, p.pos + 1 AS ord, p.w FROM {nation} LATERAL VIEW posexplode(split(n_name, '_')) p AS pos, w",
    "SELECT n_nationkey, unnest(range(len(string_split(n_name, '_')))) + 1 AS ord, unnest(string_split(n_name, '_')) AS w FROM nation")
sql("recursive_union", "WITH RECURSIVE t(n, s) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, s * 2 FROM t WHERE n < 20) SELECT n, s FROM t")
sql("three_valued_logic", "SELECT x.a, x.a IS TRUE AS t, x.a IS NOT FALSE AS nf, x.a IS NULL AS u, (x.a AND NULL) AS an, (x.a OR NULL) AS o FROM (VALUES (true), (false), (NULL)) AS x(a)")
sql("distinct_from", "SELECT a.o_orderkey, nullif(a.o_orderstatus, 'F') IS DISTINCT FROM 'O' AS d FROM {orders} a")
sql("case_coalesce", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, coalesce(nullif(o_orderstatus, 'P'), '?') AS st, greatest(o_custkey, 700) AS g, least(o_custkey, NULL, 700) AS l FROM {orders}")
sql("array_any_all", "SELECT p_partkey, array_contains(array(1, 5, 9), p_size) AS is_any, forall(array(1, 5, 9), x -> x <> p_size) AS is_all FROM {part}",
    "SELECT p_partkey, list_contains([1, 5, 9], p_size) AS is_any, NOT list_contains([1, 5, 9], p_size) AS is_all FROM part")
sql("row_compare", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE (l_orderkey, l_linenumber) > (100L, 3) AND (l_orderkey, l_linenumber) <= (140L, 2)", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey > 100 OR l_orderkey = 100 AND l_linenumber > 3) AND (l_orderkey < 140 OR l_orderkey = 140 AND l_linenumber <= 2)")
sql("like_ilike", "SELECT p_partkey, p_name LIKE '%a%' AS a, p_type ILIKE '%STEEL%' AS b FROM {part}")
sql("similar_to", "SELECT p_partkey FROM {part} WHERE p_brand RLIKE '^(Brand#(1|2).)$'", "SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2).'")
sql("overlaps", "SELECT o_orderkey FROM {orders} WHERE o_orderdate < TIMESTAMP '1995-06-01' AND o_orderdate + INTERVAL 30 DAYS > TIMESTAMP '1995-03-01'")

# Joins

sql("join_inner", "SELECT c.c_custkey, o.o_orderkey FROM {customer} c JOIN {orders} o ON c.c_custkey = o.o_custkey")
sql("join_left", "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey + 1")
sql("join_right", "SELECT c.c_custkey, o.o_orderkey FROM {customer} c RIGHT JOIN {orders} o ON c.c_custkey = o.o_custkey * 2")
sql("join_full", "SELECT c.c_custkey, s.s_suppkey FROM {customer} c FULL JOIN {supplier} s ON c.c_custkey = s.s_suppkey * 30")
sql("join_semi", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
sql("join_anti", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")
sql("join_not_in", "SELECT p_partkey FROM {part} WHERE p_partkey NOT IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 45)")
sql("join_cross", "SELECT r.r_regionkey, n.n_nationkey FROM {region} r CROSS JOIN {nation} n")
sql("join_using", "SELECT n_regionkey, count(*) AS n FROM {nation} JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM {region}) r USING (n_regionkey) GROUP BY n_regionkey")
sql("join_natural", "SELECT n_nationkey, nm FROM {nation} NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name AS nm FROM {region}) r")
sql("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
sql("join_merge", "SELECT /*+ MERGE(o) */ l.l_orderkey, count(*) AS n FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey GROUP BY l.l_orderkey", "SELECT l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
# Spark numbers the rows of a correlated ORDER BY .. LIMIT by a window without an order, after a sort that its shuffle need not keep; so the places are named here.
sql("join_lateral", "SELECT c.c_custkey, t.o_orderkey FROM {customer} c, LATERAL (SELECT o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST) AS place FROM {orders}) WHERE o_custkey = c.c_custkey AND place <= 2) t",
    "SELECT c.c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
sql("join_lateral_left", "SELECT r.r_regionkey, t.m FROM {region} r LEFT JOIN LATERAL (SELECT max(n_nationkey) AS m FROM {nation} WHERE n_regionkey = r.r_regionkey) t ON true")
sql("join_multiway", "SELECT n.n_name, count(*) AS orders FROM {nation} n JOIN {customer} c ON c.c_nationkey = n.n_nationkey JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY n.n_name")


@frame("SELECT e.event_id, p.p_partkey FROM events e JOIN part p ON e.value * 10 BETWEEN p.p_size * 10 AND p.p_size * 10 + 3")
def join_range(spark, sf_dir):
    points = table(spark, sf_dir, "events").select("event_id", (F.col("value") * 10).alias("v"))
    ranges = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 10).alias("lo"), (F.col("p_size") * 10 + 3).alias("hi"))
    return joins.range_join(points, "v", ranges, "lo", "hi", 10).select("event_id", "p_partkey")


@frame("""SELECT e.event_id, c.event_id AS click_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click') c
 ON e.user_id = c.user_id AND e.ts >= c.ts""")
def join_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return joins.asof_join(events, clicks, ["user_id"], "ts", ["click_id"]).select("event_id", "click_id")


@frame("SELECT l_suppkey, count(*) AS n, count(DISTINCT s_nationkey) AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def join_salted(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return joins.salted_join(items, suppliers, ["l_suppkey"], 8).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_distinct("s_nationkey").alias("k"))


# Aggregation

sql("agg_plain", "SELECT count(*) AS n, count(l_quantity) AS c, round(sum(l_quantity), 2) AS s, min(l_shipdate) AS lo, max(l_shipdate) AS hi, round(avg(l_discount), 6) AS a FROM {lineitem}")
sql("agg_group", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_tax), 6) AS avg_tax, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p FROM {lineitem} GROUP BY l_returnflag")
sql("agg_distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")
sql("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
sql("agg_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM {nation} GROUP BY ROLLUP (n_regionkey, n_nationkey)")
sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_totalprice > 100000) AS big FROM {orders} GROUP BY o_orderpriority")
sql("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
sql("agg_stats", "SELECT l_returnflag, round(stddev_samp(l_quantity), 4) AS sd, round(stddev_pop(l_quantity), 4) AS sp, round(var_samp(l_quantity), 3) AS vs, round(var_pop(l_quantity), 3) AS vp FROM {lineitem} GROUP BY l_returnflag")
sql("agg_regression", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 5) AS c, round(covar_pop(l_quantity, l_discount), 5) AS cp, round(covar_samp(l_quantity, l_discount), 5) AS cs, round(regr_slope(l_extendedprice, l_quantity), 3) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 1) AS ic, round(regr_r2(l_extendedprice, l_quantity), 5) AS r2, regr_count(l_extendedprice, l_quantity) AS rc FROM {lineitem} GROUP BY l_returnflag")
sql("agg_bool", "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 400000) AS o, every(o_custkey > 0) AS e FROM {orders} GROUP BY o_orderpriority",
    "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 400000) AS o, bool_and(o_custkey > 0) AS e FROM orders GROUP BY ALL")
sql("agg_bits", "SELECT n_regionkey, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x FROM {nation} GROUP BY n_regionkey")
sql("agg_string", "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY ALL")
sql("agg_array", "SELECT n_regionkey, array_join(transform(array_sort(collect_list(struct(n_nationkey, nullif(n_nationkey % 2, 0) AS v))), x -> coalesce(cast(x.v AS STRING), 'null')), ',') AS vs FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(coalesce(nullif(n_nationkey % 2, 0)::VARCHAR, 'null'), ',' ORDER BY n_nationkey) AS vs FROM nation GROUP BY ALL")
sql("agg_percentile", "SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS med, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90 FROM {lineitem} GROUP BY l_returnflag",
    "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS med, quantile_disc(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY ALL")
sql("agg_hypothetical", "SELECT o_orderpriority, count_if(o_totalprice < 100000) + 1 AS rank, count(DISTINCT CASE WHEN o_totalprice < 100000 THEN o_totalprice END) + 1 AS dense_rank FROM {orders} GROUP BY o_orderpriority",
    "SELECT o_orderpriority, count(*) FILTER (o_totalprice < 100000) + 1 AS rank, count(DISTINCT o_totalprice) FILTER (o_totalprice < 100000) + 1 AS dense_rank FROM orders GROUP BY ALL")
sql("agg_json", "SELECT n_regionkey, to_json(array_sort(collect_list(n_nationkey))) AS j FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, replace(to_json(list(n_nationkey ORDER BY n_nationkey))::VARCHAR, ' ', '') AS j FROM nation GROUP BY ALL")
sql("agg_range_intersect", "SELECT o_custkey, max(o_orderdate) AS lo, min(o_orderdate + INTERVAL 900 DAYS) AS hi FROM {orders} GROUP BY o_custkey")
sql("pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_orderkey FROM {lineitem}) PIVOT (count(l_orderkey) FOR l_linestatus IN ('O' AS open, 'F' AS done))",
    "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS open, count(*) FILTER (l_linestatus = 'F') AS done FROM lineitem GROUP BY ALL")


@frame("SELECT user_id, count(*) AS pieces, max(n) AS longest FROM (SELECT user_id, island, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, CASE WHEN ts > max(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 3 HOURS THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY ALL) GROUP BY ALL")
def agg_range_union(spark, sf_dir):
    """range_agg: overlapping ranges [ts, ts + 3 h] of each user joined to islands."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") > F.max("ts").over(line.rowsBetween(Window.unboundedPreceding, -1)) + F.expr("INTERVAL 3 HOURS"), 1).otherwise(0)
    islands = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(line))
    return islands.groupBy("user_id", "island").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("pieces"), F.max("n").alias("longest"))


# Windows

W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
sql("window_rank", f"SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(3) OVER w AS nt FROM {{orders}} WINDOW w AS ({W}), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
sql("window_distribution", "SELECT o_orderkey, round(percent_rank() OVER v, 9) AS pr, round(cume_dist() OVER v, 9) AS cd FROM {orders} WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
sql("window_offset", f"SELECT o_orderkey, lag(o_orderkey, 1, -1) OVER w AS lg, lead(o_orderkey, 2) OVER w AS ld, first_value(o_orderkey) OVER w AS fv, nth_value(o_orderkey, 2) OVER w AS nv FROM {{orders}} WINDOW w AS ({W})")
sql("window_rows", f"SELECT o_orderkey, count(*) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS c, max(o_orderkey) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM {{orders}}")
sql("window_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS c FROM {orders}")
sql("window_groups", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS c FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS g FROM {orders})",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS c FROM orders")
sql("window_exclude", "SELECT o_orderkey, CASE WHEN (count(*) OVER w) > 1 THEN (sum(o_orderkey) OVER w) - o_orderkey END AS s FROM {orders} WINDOW w AS (PARTITION BY o_custkey)",
    "SELECT o_orderkey, (sum(o_orderkey) OVER (PARTITION BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW))::BIGINT AS s FROM orders")
sql("window_exclude_group", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) - count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS c FROM {orders}",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS c FROM orders")
sql("window_filter", "SELECT o_orderkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) OVER (PARTITION BY o_custkey) AS c FROM {orders}", "SELECT o_orderkey, count(*) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS c FROM orders")
sql("window_distinct", "SELECT o_orderkey, size(collect_set(o_orderpriority) OVER (PARTITION BY o_custkey)) AS c FROM {orders}", "SELECT o_orderkey, (count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey))::INT AS c FROM orders")

# Sort, limit, sets

A, B = "SELECT c_nationkey AS k FROM {customer}", "SELECT s_nationkey AS k FROM {supplier}"
for _name, _op in (("union_all", "UNION ALL"), ("union_distinct", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    sql(f"set_{_name}", f"{A} {_op} {B}")

# Subqueries

sql("subquery_scalar", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM {orders})")
sql("subquery_correlated", "SELECT c_custkey, (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey) AS n FROM {customer}")
sql("subquery_in", "SELECT count(*) AS n FROM {lineitem} WHERE l_orderkey IN (SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'P')")
sql("subquery_array", "SELECT r_regionkey, array_join(transform(array_sort(k), x -> cast(x AS STRING)), ',') AS ks FROM {region} LEFT JOIN (SELECT n_regionkey, collect_list(n_nationkey) AS k FROM {nation} GROUP BY n_regionkey) ON n_regionkey = r_regionkey",
    "SELECT r_regionkey, array_to_string(ARRAY(SELECT n_nationkey FROM nation WHERE n_regionkey = r_regionkey ORDER BY 1), ',') AS ks FROM region")

# Scalar families

sql("fn_string", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, replace(p_type, 'E', 'e') AS r, reverse(p_brand) AS rv, repeat('ab', 2) AS rep, translate(p_brand, 'B#', 'b-') AS t, strpos(p_name, 'a') AS pos, split_part(p_type, ' ', 2) AS sp, concat_ws('-', p_brand, NULL, p_type) AS cw, length(p_name) AS n, ascii(p_brand) AS asc, chr(65 + p_size % 26) AS ch FROM {part}".replace("strpos(p_name, 'a')", "position('a' IN p_name)"))
sql("fn_hash", "SELECT p_partkey, md5(p_name) AS m, sha2(p_name, 256) AS s, lower(hex(p_size)) AS h FROM {part}", "SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s, lower(to_hex(p_size)) AS h FROM part")
sql("fn_regex", "SELECT p_partkey, regexp_extract(p_brand, '#([0-9])', 1) AS e, regexp_replace(p_name, '[aeiou]', '_') AS r, p_name RLIKE '^[a-m]' AS k, regexp_count(p_name, 'a') AS c FROM {part}",
    "SELECT p_partkey, regexp_extract(p_brand, '#([0-9])', 1) AS e, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r, regexp_matches(p_name, '^[a-m]') AS k, len(regexp_extract_all(p_name, 'a'))::INT AS c FROM part")
sql("fn_math", "SELECT p_partkey, abs(-p_size) AS a, mod(p_size, 7) AS m, p_size div 7 AS d, round(sqrt(p_size), 6) AS sq, round(ln(p_size + 1), 6) AS l, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, sign(p_size - 25) AS s, round(power(p_size, 2), 1) AS pw, round(cbrt(p_size), 6) AS cb, round(degrees(sin(p_size)), 6) AS dg, round(atan2(p_size, 3), 6) AS at FROM {part}".replace("sign(p_size - 25)", "cast(sign(p_size - 25) AS INT)").replace("ceil(p_retailprice)", "cast(ceil(p_retailprice) AS BIGINT)").replace("floor(p_retailprice)", "cast(floor(p_retailprice) AS BIGINT)"),
    "SELECT p_partkey, abs(-p_size) AS a, mod(p_size, 7) AS m, p_size // 7 AS d, round(sqrt(p_size), 6) AS sq, round(ln(p_size + 1), 6) AS l, ceil(p_retailprice)::BIGINT AS c, floor(p_retailprice)::BIGINT AS f, sign(p_size - 25)::INT AS s, round(power(p_size, 2), 1) AS pw, round(cbrt(p_size), 6) AS cb, round(degrees(sin(p_size)), 6) AS dg, round(atan2(p_size, 3), 6) AS at FROM part")
sql("fn_date", "SELECT event_id, date_trunc('hour', ts) AS h, extract(YEAR FROM ts) AS y, extract(MONTH FROM ts) AS m, extract(DAY FROM ts) AS d, dayofweek(ts) - 1 AS dow, weekofyear(ts) AS w, cast(last_day(ts) AS STRING) AS ld, datediff(ts, TIMESTAMP '2024-01-01') AS dd FROM {events}",
    "SELECT event_id, date_trunc('hour', ts) AS h, extract(YEAR FROM ts)::INT AS y, extract(MONTH FROM ts)::INT AS m, extract(DAY FROM ts)::INT AS d, dayofweek(ts)::INT AS dow, weekofyear(ts)::INT AS w, last_day(ts)::VARCHAR AS ld, date_diff('day', TIMESTAMP '2024-01-01', ts)::INT AS dd FROM events")
sql("fn_json", "SELECT event_id, get_json_object(props, '$.k') AS k, cast(variant_get(parse_json(props), '$.k', 'int') AS INT) AS v FROM {events}", "SELECT event_id, props->>'$.k' AS k, (props->>'$.k')::INT AS v FROM events")
sql("fn_array", "SELECT p_partkey, size(a) AS n, array_join(transform(array_distinct(a), x -> cast(x AS STRING)), ',') AS d, array_contains(a, 3) AS c, a[0] AS f, element_at(a, -1) AS l, array_position(a, 2) AS pos, array_max(a) AS mx FROM (SELECT p_partkey, array(p_size % 5, 2, p_size % 3) AS a FROM {part})",
    "SELECT p_partkey, len(a)::INT AS n, array_to_string(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i]::VARCHAR END), ',') AS d, list_contains(a, 3) AS c, a[1] AS f, a[-1] AS l, list_position(a, 2)::BIGINT AS pos, list_max(a) AS mx FROM (SELECT p_partkey, [p_size % 5, 2, p_size % 3] AS a FROM part)")
sql("fn_width_bucket", "SELECT p_partkey, size(filter(array(5, 10, 30), x -> x <= p_size)) AS b FROM {part}", "SELECT p_partkey, len(list_filter([5, 10, 30], lambda x: x <= p_size))::INT AS b FROM part")


@frame("""SELECT p_partkey, gcd(p_size, 12)::BIGINT AS g, lcm(p_size, 12)::BIGINT AS l, CASE WHEN p_size - 10 >= 0 THEN substring(p_name, greatest(p_size - 10, 1), greatest(0, 5 + least(0, p_size - 11))) ELSE substring(p_name, 1, greatest(0, 5 + p_size - 11)) END AS s,
 left(p_brand, -2) AS le, right(p_brand, 3) AS ri, concat(p_brand, NULL, p_size) AS c FROM part""")
def fn_compat(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        compat.gcd(size, F.lit(12)).alias("g"),
        compat.lcm(size, F.lit(12)).alias("l"),
        compat.substr(F.col("p_name"), size - 10, F.lit(5)).alias("s"),
        compat.left(F.col("p_brand"), -2).alias("le"),
        compat.right(F.col("p_brand"), 3).alias("ri"),
        compat.concat(F.col("p_brand"), F.lit(None), size).alias("c"),
    )


@frame("SELECT event_id, time_bucket(INTERVAL 15 MINUTES, ts, TIMESTAMP '2024-01-01 00:05:00') AS bin, epoch(ts) AS ep, extract(dow FROM ts)::INT AS dow FROM events")
def fn_date_compat(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", compat.date_bin(900, ts, "2024-01-01 00:05:00").alias("bin"), compat.epoch(ts).alias("ep"), compat.day_of_week(ts).alias("dow"))


# Streams read as batches: tumbling, sliding and session windows

sql("window_tumbling", "SELECT window.start AS start, event_type, count(*) AS n FROM {events} GROUP BY window(ts, '1 hour'), event_type", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
sql("window_sliding", "SELECT window.start AS start, count(*) AS n FROM {events} GROUP BY window(ts, '2 hours', '1 hour')",
    "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - i * INTERVAL 1 HOUR AS start FROM events, generate_series(0, 1) g(i)) GROUP BY ALL")
sql("window_session", "SELECT user_id, session_window.start AS start, count(*) AS n FROM {events} GROUP BY user_id, session_window(ts, '3 hours')",
    """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM
 (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3 HOURS THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s""")


# Further families

sql("fn_bits", "SELECT p_partkey, bit_count(p_size) AS c, p_size & 12 AS a, p_size | 3 AS o, p_size ^ 5 AS x, shiftleft(p_size, 2) AS sl, shiftright(p_size, 1) AS sr, cast(getbit(p_size, 2) AS INT) AS g FROM {part}".replace("bit_count(p_size)", "cast(bit_count(p_size) AS INT)"),
    "SELECT p_partkey, bit_count(p_size)::INT AS c, p_size & 12 AS a, p_size | 3 AS o, xor(p_size, 5) AS x, p_size << 2 AS sl, p_size >> 1 AS sr, (p_size >> 2) & 1 AS g FROM part")
sql("fn_fuzzy", "SELECT p_partkey, levenshtein(p_brand, p_type) AS d FROM {part}", "SELECT p_partkey, levenshtein(p_brand, p_type)::INT AS d FROM part")
sql("fn_series", "SELECT n_nationkey, s.t AS t FROM {nation} LATERAL VIEW explode(sequence(TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-01-03', INTERVAL 12 HOURS)) s AS t",
    "SELECT n_nationkey, t FROM nation, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03', INTERVAL 12 HOURS) g(t)")
sql("fn_nulls", "SELECT o_orderkey, size(filter(array(nullif(o_orderstatus, 'F'), o_orderpriority, NULL), x -> x IS NULL)) AS n FROM {orders}", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS n FROM orders")
sql("connect_by", "WITH RECURSIVE t(k, depth, path) AS (SELECT n_nationkey, 0, cast(n_nationkey AS STRING) FROM {nation} WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.depth + 1, t.path || '>' || n.n_nationkey FROM {nation} n JOIN t ON n.n_nationkey IN (2 * t.k + 1, 2 * t.k + 2)) SELECT k, depth, path FROM t",
    "WITH RECURSIVE t(k, depth, path) AS (SELECT n_nationkey, 0, n_nationkey::VARCHAR FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.depth + 1, t.path || '>' || n.n_nationkey FROM nation n JOIN t ON n.n_nationkey IN (2 * t.k + 1, 2 * t.k + 2)) SELECT k, depth, path FROM t")


@frame("WITH RECURSIVE t(origin, node) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT t.origin, (t.node * 3 + 1) % 25 FROM t) SELECT origin, node FROM t")
def recursive_distinct(spark, sf_dir):
    from ..operators.recursion import reachable

    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"))
    return reachable(nodes.select("src", ((F.col("src") * 3 + 1) % 25).alias("dst")), nodes.select(F.col("src").alias("origin")))


MERGED = """SELECT coalesce(s_suppkey, k) AS s_suppkey, CASE WHEN k IS NULL THEN s_acctbal ELSE bal END AS s_acctbal,
 CASE WHEN k IS NULL THEN 'keep' WHEN s_suppkey IS NULL THEN 'insert' WHEN bal < 0 THEN 'delete' ELSE 'update' END AS action
 FROM supplier FULL JOIN (SELECT c_custkey * 3 AS k, c_acctbal AS bal FROM customer) ON s_suppkey = k WHERE NOT (s_suppkey IS NULL AND bal < 0)"""


def merged(spark, sf_dir):
    from ..operators import modify

    target = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    source = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("s_suppkey"), F.col("c_acctbal").alias("s_acctbal"))
    return modify.merge(target, source, ["s_suppkey"], F.col("s_acctbal") < 0)


@frame(f"SELECT s_suppkey, s_acctbal FROM ({MERGED}) WHERE action <> 'delete'")
def modify_merge(spark, sf_dir):
    from ..operators import modify

    return modify.result(merged(spark, sf_dir))


@frame(f"SELECT * FROM ({MERGED}) WHERE action <> 'keep'")
def modify_returning(spark, sf_dir):
    from ..operators import modify

    return modify.returning(merged(spark, sf_dir))


@frame("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE NOT coalesce(s_suppkey % 7 = 0, false)")
def modify_update_delete(spark, sf_dir):
    from ..operators import modify

    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return modify.delete_where(modify.update_where(rows, F.col("s_acctbal") < 0, s_acctbal=F.lit(0.0)), F.col("s_suppkey") % 7 == 0)


@frame("SELECT s_suppkey AS k FROM supplier UNION SELECT c_custkey * 2 FROM customer")
def modify_on_conflict(spark, sf_dir):
    from ..operators import modify

    target = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return modify.insert_or_nothing(target, table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("k")), ["k"])


@frame("""SELECT p_partkey, '10.' || p_size || '.' || p_partkey % 256 || '.7' AS host, 20 AS bits, '255.255.240.0' AS mask,
 '10.' || p_size || '.' || (p_partkey % 256) // 16 * 16 || '.0/20' AS net, '10.' || p_size || '.' || ((p_partkey % 256) // 16 * 16 + 15) || '.255/20' AS last FROM part""")
def fn_network(spark, sf_dir):
    from ..functions import network

    a = F.concat(F.lit("10."), F.col("p_size"), F.lit("."), F.col("p_partkey") % 256, F.lit(".7/20"))
    rows = table(spark, sf_dir, "part").select("p_partkey", a.alias("a"))
    a = F.col("a")
    return rows.select("p_partkey", network.host(a).alias("host"), network.mask_length(a).alias("bits"), network.netmask(a).alias("mask"), network.network(a).alias("net"), network.broadcast_address(a).alias("last"))


@frame("SELECT p_partkey, p_size < 20 AS has, p_size < 30 AND 10 < p_size + 5 AS meets, p_size = 30 OR p_size + 5 = 10 AS next_to, CASE WHEN p_size < 30 AND 10 < p_size + 5 THEN greatest(p_size, 10) END AS lo FROM part")
def fn_ranges(spark, sf_dir):
    size = F.col("p_size")
    r, fixed = compat.range_of(size, size + 5), compat.range_of(F.lit(10), F.lit(30))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        compat.range_contains(compat.range_of(F.lit(None).cast("int"), F.lit(20)), size).alias("has"),
        compat.range_overlaps(r, fixed).alias("meets"),
        compat.range_adjacent(r, fixed).alias("next_to"),
        compat.range_intersection(r, fixed)["lo"].alias("lo"),
    )
