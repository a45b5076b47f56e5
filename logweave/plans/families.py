"""Queries of further families: functions, special aggregates, scans, distribution, changes; each in Spark and DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import compat, network, textsearch
from ..operators import ddl, distribution, joins, modify, quantified, recursion
from . import relational
from .relational import frame, sql, table

Q = relational.QUERIES


def plain(f):
    """A query without SQL: its rows depend on chance or on Spark alone; tests look at it."""
    Q[f.__name__] = f
    return f


# Scans


@frame("SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER () - 1 AS ri FROM nation) WHERE ri BETWEEN 3 AND 9")
def tid_scan(spark, sf_dir):
    """Rows by their place in the file; Parquet's row groups outside it aren't read."""
    return table(spark, sf_dir, "nation").where("_metadata.row_index BETWEEN 3 AND 9").select("n_nationkey", "n_name")


@plain
def sample_bernoulli(spark, sf_dir):
    """TABLESAMPLE BERNOULLI (10) REPEATABLE (42): each row by itself."""
    return spark.sql("SELECT event_id FROM {events} TABLESAMPLE (10 PERCENT) REPEATABLE (42)", events=table(spark, sf_dir, "events"))


@plain
def sample_rows(spark, sf_dir):
    """system_rows(100): any so many rows, from as few files as hold them."""
    return table(spark, sf_dir, "events").select("event_id").limit(100)


@plain
def sample_system(spark, sf_dir):
    """TABLESAMPLE SYSTEM: whole blocks of rows, here of 256 by their place in the file, by a hash with a seed."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("_metadata.file_path").alias("f"), F.expr("_metadata.row_index div 256").alias("block"))
    return rows.where(F.pmod(F.xxhash64(F.regexp_extract("f", "[^/]+$", 0), "block", F.lit(42)), F.lit(100)) < 10).select("event_id")


sql("project_set", "SELECT o_orderkey, explode(sequence(1, cast(o_custkey % 3 AS INT))) AS i FROM {orders} WHERE o_custkey % 3 > 0", "SELECT o_orderkey, unnest(generate_series(1, o_custkey % 3))::INT AS i FROM orders")
sql("rows_from", "SELECT p_partkey, z.a, z.b FROM {part} LATERAL VIEW explode(arrays_zip(sequence(1, 3) AS a, split(p_type, ' ') AS b)) t AS z".replace("arrays_zip(sequence(1, 3) AS a, split(p_type, ' ') AS b)", "transform(sequence(0, greatest(3, size(split(p_type, ' '))) - 1), i -> named_struct('a', get(sequence(1, 3), i), 'b', get(split(p_type, ' '), i)))"),
    "SELECT p_partkey, unnest([1, 2, 3]) AS a, unnest(string_split(p_type, ' ')) AS b FROM part")
sql("xml_table", "SELECT p_partkey, x.pos + 1 AS ord, x.w FROM {part} LATERAL VIEW posexplode(xpath(concat('<t><w>', replace(p_type, ' ', '</w><w>'), '</w></t>'), 't/w/text()')) x AS pos, w",
    "SELECT p_partkey, unnest(range(len(string_split(p_type, ' ')))) + 1 AS ord, unnest(string_split(p_type, ' ')) AS w FROM part")
sql("row_in", "SELECT o_orderkey FROM {orders} WHERE (o_orderstatus, o_orderpriority) IN (SELECT 'F', o_orderpriority FROM {orders} WHERE o_totalprice > 300000)")
sql("current_values", "SELECT current_date() = cast(now() AS DATE) AS d, now() = current_timestamp() AS t, current_user() IS NOT NULL AS u, current_database() IS NOT NULL AS s, abs(datediff(current_date(), cast(localtimestamp() AS DATE))) <= 1 AS l",
    "SELECT current_date = now()::DATE AS d, now() = current_timestamp AS t, current_user IS NOT NULL AS u, current_schema() IS NOT NULL AS s, true AS l")
sql("collate_nocase", "SELECT p_partkey FROM {part} WHERE upper(p_type) COLLATE UTF8_LCASE LIKE 'standard%' OR p_brand COLLATE UTF8_LCASE = 'BRAND#11'", "SELECT p_partkey FROM part WHERE p_type ILIKE 'standard%' OR p_brand COLLATE NOCASE = 'BRAND#11'")
sql("casts", "SELECT o_orderkey, cast(o_totalprice AS INT) AS i, cast(o_orderkey AS STRING) AS s, try_cast(o_orderpriority AS INT) AS n, cast(cast(o_orderdate AS DATE) AS STRING) AS d, array_join(cast(array('1', '22') AS ARRAY<INT>), '+') AS a FROM {orders}",
    "SELECT o_orderkey, trunc(o_totalprice)::INT AS i, o_orderkey::VARCHAR AS s, try_cast(o_orderpriority AS INT) AS n, o_orderdate::DATE::VARCHAR AS d, array_to_string(['1', '22']::INT[], '+') AS a FROM orders")
sql("subscripts", "SELECT p_partkey, a[1] AS second, array_join(slice(a, 2, 2), ',') AS part, s.x AS x FROM (SELECT p_partkey, array(p_size, p_size + 1, p_size + 2) AS a, named_struct('x', p_brand) AS s FROM {part})",
    "SELECT p_partkey, a[2] AS second, array_to_string(a[2:3], ',') AS part, s.x AS x FROM (SELECT p_partkey, [p_size, p_size + 1, p_size + 2] AS a, {'x': p_brand} AS s FROM part)")


@frame("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000.0")
def params(spark, sf_dir):
    """A prepared statement with named parameters."""
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :least", args={"status": "F", "least": 150000.0}, orders=table(spark, sf_dir, "orders"))


sql("between_symmetric", "SELECT p_partkey FROM {part} WHERE p_size BETWEEN least(p_partkey % 50, 25) AND greatest(p_partkey % 50, 25)", "SELECT p_partkey FROM part WHERE (p_size >= p_partkey % 50 AND p_size <= 25) OR (p_size >= 25 AND p_size <= p_partkey % 50)")


# Subqueries with ALL and ANY


GROUPS = "SELECT nullif(n_nationkey, 6) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey % 5 <> 4 AND n_regionkey <> 2"


def _quantified(spark, sf_dir):
    values = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 4 and n_regionkey <> 2").select("n_regionkey", F.nullif(F.col("n_nationkey"), F.lit(6)).alias("v"))
    facts = quantified.facts(values, "v", ["n_regionkey"])
    region = table(spark, sf_dir, "region")
    return region.join(facts, region["r_regionkey"] == facts["n_regionkey"], "left")


@frame("SELECT r_regionkey, " + ", ".join(f"{x} {op} ALL ({GROUPS}) AS {name}" for x, op, name in (("30", ">", "above"), ("3", "<=", "below"), ("12", ">=", "mid"), ("NULL::INT", ">", "unknown"))) + " FROM region")
def subquery_all_nulls(spark, sf_dir):
    """Groups with nulls and an empty group: null and true where SQL says so."""
    rows, f = _quantified(spark, sf_dir), F.col("facts")
    return rows.select("r_regionkey", quantified.compare_all(F.lit(30), ">", f).alias("above"), quantified.compare_all(F.lit(3), "<=", f).alias("below"), quantified.compare_all(F.lit(12), ">=", f).alias("mid"), quantified.compare_all(F.lit(None).cast("int"), ">", f).alias("unknown"))


@frame("SELECT r_regionkey, " + ", ".join(f"{x} {op} ANY ({GROUPS}) AS {name}" for x, op, name in (("1", ">", "above"), ("30", "<", "below"), ("6", ">=", "mid"), ("NULL::INT", "<", "unknown"))) + " FROM region")
def subquery_any_nulls(spark, sf_dir):
    rows, f = _quantified(spark, sf_dir), F.col("facts")
    return rows.select("r_regionkey", quantified.compare_any(F.lit(1), ">", f).alias("above"), quantified.compare_any(F.lit(30), "<", f).alias("below"), quantified.compare_any(F.lit(6), ">=", f).alias("mid"), quantified.compare_any(F.lit(None).cast("int"), "<", f).alias("unknown"))


@frame("SELECT p_partkey, p_size > ALL (SELECT n_nationkey FROM nation) AS over FROM part")
def subquery_all(spark, sf_dir):
    f = quantified.facts(table(spark, sf_dir, "nation").withColumn("one", F.lit(1)), "n_nationkey", ["one"])
    return table(spark, sf_dir, "part").crossJoin(F.broadcast(f)).select("p_partkey", quantified.compare_all(F.col("p_size"), ">", F.col("facts")).alias("over"))


@frame("SELECT p_partkey, p_size < ANY (SELECT n_regionkey FROM nation) AS under FROM part")
def subquery_any(spark, sf_dir):
    f = quantified.facts(table(spark, sf_dir, "nation").withColumn("one", F.lit(1)), "n_regionkey", ["one"])
    return table(spark, sf_dir, "part").crossJoin(F.broadcast(f)).select("p_partkey", quantified.compare_any(F.col("p_size"), "<", F.col("facts")).alias("under"))


sql("subquery_row", "SELECT c_custkey FROM {customer} WHERE struct(c_nationkey, c_mktsegment) = (SELECT struct(s_nationkey, 'BUILDING') FROM {supplier} WHERE s_suppkey = (SELECT min(s_suppkey) FROM {supplier}))",
    "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = (SELECT arg_min(s_nationkey, s_suppkey) FROM supplier)")
sql("join_memoize", "SELECT c.c_custkey, m.n FROM {customer} c JOIN (SELECT k.c_nationkey AS k, count(s.s_suppkey) AS n FROM (SELECT DISTINCT c_nationkey FROM {customer}) k LEFT JOIN {supplier} s ON s.s_nationkey = k.c_nationkey GROUP BY k.c_nationkey) m ON m.k = c.c_nationkey",
    "SELECT c_custkey, (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey) AS n FROM customer")


@frame("SELECT l_suppkey, count(*) AS n, count(DISTINCT s_nationkey) AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def join_skewed(spark, sf_dir):
    """Only keys that are seen to be hot are salted."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return joins.skewed_join(items, suppliers, ["l_suppkey"]).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_distinct("s_nationkey").alias("k"))


@frame("""WITH RECURSIVE t(origin, node, path, is_cycle) AS (SELECT n_nationkey, n_nationkey, [n_nationkey], false FROM nation
 UNION ALL SELECT origin, (node * 3 + 1) % 25, list_append(path, (node * 3 + 1) % 25), list_contains(path, (node * 3 + 1) % 25) FROM t WHERE NOT is_cycle)
SELECT origin, node, array_to_string(path, '>') AS path, is_cycle FROM t""")
def recursive_cycle(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"))
    found = recursion.paths(nodes.select("src", ((F.col("src") * 3 + 1) % 25).alias("dst")), nodes.select(F.col("src").alias("origin")))
    return found.select("origin", "node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "is_cycle")


# Aggregates


sql("agg_mode", "SELECT l_returnflag, mode() WITHIN GROUP (ORDER BY l_linenumber) AS m, mode() WITHIN GROUP (ORDER BY l_quantity) AS q FROM {lineitem} GROUP BY l_returnflag",
    "SELECT l_returnflag, (SELECT l_linenumber FROM lineitem i WHERE i.l_returnflag = o.l_returnflag GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS m, (SELECT l_quantity FROM lineitem i WHERE i.l_returnflag = o.l_returnflag GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS q FROM (SELECT DISTINCT l_returnflag FROM lineitem) o")
sql("agg_any_value", "SELECT n_regionkey, any_value(r_name) AS r, any_value(nullif(n_nationkey, n_nationkey)) IS NULL AS empty FROM {nation} JOIN {region} ON r_regionkey = n_regionkey GROUP BY n_regionkey")
sql("agg_array_cat", "SELECT o_orderpriority, array_join(sort_array(flatten(collect_list(array(o_orderkey, -o_custkey)))), ',') AS a FROM {orders} GROUP BY o_orderpriority", "SELECT o_orderpriority, array_to_string(list_sort(flatten(list([o_orderkey, -o_custkey]))), ',') AS a FROM orders GROUP BY ALL")
sql("agg_int_array", "SELECT n_regionkey, array_join(sort_array(array_agg(n_nationkey)), ',') AS a FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS a FROM nation GROUP BY ALL")
sql("agg_regression_rest", "SELECT l_returnflag, regr_count(l_extendedprice, l_quantity) AS n, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 2) AS ay, round(regr_sxx(l_extendedprice, l_quantity), 1) AS sxx, round(regr_sxy(l_extendedprice, l_quantity) / 1000, 1) AS sxy, round(regr_syy(l_extendedprice, l_quantity) / 1000000, 1) AS syy FROM {lineitem} GROUP BY l_returnflag",
    "SELECT l_returnflag, regr_count(l_extendedprice, l_quantity)::BIGINT AS n, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 2) AS ay, round(regr_sxx(l_extendedprice, l_quantity), 1) AS sxx, round(regr_sxy(l_extendedprice, l_quantity) / 1000, 1) AS sxy, round(regr_syy(l_extendedprice, l_quantity) / 1000000, 1) AS syy FROM lineitem GROUP BY ALL")
sql("agg_json_object", "SELECT n_regionkey, to_json(map_from_entries(array_sort(collect_list(struct(n_name, n_nationkey))))) AS j FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS j FROM nation GROUP BY ALL")
sql("agg_percentile_array", "SELECT l_returnflag, array_join(transform(percentile(l_quantity, array(0.25D, 0.5D, 0.9D)), x -> cast(round(x, 3) AS STRING)), ',') AS p FROM {lineitem} GROUP BY l_returnflag",
    "SELECT l_returnflag, array_to_string(list_transform(quantile_cont(l_quantity, [0.25, 0.5, 0.9]), lambda x: round(x, 3)::DOUBLE::VARCHAR), ',') AS p FROM lineitem GROUP BY ALL")
sql("agg_hypothetical_rest", "SELECT o_orderpriority, round(count_if(o_totalprice < 100000) / count(*), 9) AS pr, round((count_if(o_totalprice <= 100000) + 1) / (count(*) + 1), 9) AS cd FROM {orders} GROUP BY o_orderpriority",
    "SELECT o_orderpriority, round(count(*) FILTER (o_totalprice < 100000) / count(*), 9) AS pr, round((count(*) FILTER (o_totalprice <= 100000) + 1) / (count(*) + 1), 9) AS cd FROM orders GROUP BY o_orderpriority")
sql("agg_xml", "SELECT n_regionkey, string_agg(concat('<n>', n_name, '</n>'), '') WITHIN GROUP (ORDER BY n_name) AS x FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg('<n>' || n_name || '</n>', '' ORDER BY n_name) AS x FROM nation GROUP BY ALL")
sql("agg_approx_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, abs(approx_count_distinct(l_partkey, 0.02) - count(DISTINCT l_partkey)) <= 0.1 * count(DISTINCT l_partkey) AS near FROM {lineitem} GROUP BY l_returnflag",
    "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.2 * count(DISTINCT l_partkey) AS near FROM lineitem GROUP BY ALL")
sql("agg_hll_merge", "SELECT f.l_returnflag, f.exact, abs(s.est - f.exact) <= 0.1 * f.exact AS near FROM (SELECT l_returnflag, count(DISTINCT l_partkey) AS exact FROM {lineitem} GROUP BY l_returnflag) f JOIN (SELECT l_returnflag, hll_sketch_estimate(hll_union_agg(sk)) AS est FROM (SELECT l_returnflag, l_linenumber, hll_sketch_agg(l_partkey) AS sk FROM {lineitem} GROUP BY l_returnflag, l_linenumber) GROUP BY l_returnflag) s ON s.l_returnflag = f.l_returnflag",
    "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS near FROM lineitem GROUP BY ALL")
sql("agg_top_n", "SELECT o_orderstatus, t.item AS item, t.count AS n FROM (SELECT o_orderstatus, explode(approx_top_k(o_orderpriority, 10)) AS t FROM {orders} GROUP BY o_orderstatus)", "SELECT o_orderstatus, o_orderpriority AS item, count(*) AS n FROM orders GROUP BY ALL")
sql("agg_quantile_sketch", "SELECT l_returnflag, abs(percentile_approx(l_quantity, 0.5, 10000) - median(l_quantity)) <= 1 AS near FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, abs(approx_quantile(l_quantity, 0.5) - median(l_quantity)) <= 2 AS near FROM lineitem GROUP BY ALL")
sql("agg_custom", "SELECT n_regionkey, aggregate(array_sort(collect_list(n_nationkey)), 0L, (s, x) -> s * 31 + x, s -> s % 1000003) AS h, round(exp(sum(ln(n_nationkey + 1)) / count(*)), 6) AS g FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, (list_reduce(list_prepend(0::BIGINT, list(n_nationkey::BIGINT ORDER BY n_nationkey)), lambda s, x: s * 31 + x) % 1000003)::BIGINT AS h, round(geomean(n_nationkey + 1), 6) AS g FROM nation GROUP BY ALL")


# Windows, sorts, limits


sql("window_exclude_ties", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) - count(*) OVER (PARTITION BY o_custkey, o_orderpriority) + 1 AS c FROM {orders}",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS c FROM orders")
sql("sort_nulls", "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY nullif(c_nationkey, 2) DESC NULLS FIRST, c_custkey) AS first, row_number() OVER (PARTITION BY c_mktsegment ORDER BY nullif(c_nationkey, 2) ASC NULLS LAST, c_custkey) AS last FROM {customer}")
sql("top_k", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM (SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5)")


@frame("SELECT o_orderkey FROM (SELECT o_orderkey, rank() OVER (ORDER BY o_orderdate::DATE) AS r FROM orders) WHERE r <= 7")
def limit_ties(spark, sf_dir):
    """FETCH FIRST 7 ROWS WITH TIES: a bounded top-k finds the border."""
    return compat.limit_with_ties(table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate")), 7, ["d"]).select("o_orderkey")


@frame("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, sf_dir):
    return compat.distinct_on(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@frame("SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY nullif(s_suppkey % 7, 3) DESC NULLS FIRST, s_suppkey) AS a FROM supplier")
def sort_default_nulls(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("v", F.nullif(F.col("s_suppkey") % 7, F.lit(3)))
    return rows.select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(compat.nulls_last("v", descending=True), "s_suppkey")).alias("a"))


@frame("SELECT o_orderkey, sum(o_totalprice > 100000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS n FROM orders")
def window_colocated(spark, sf_dir):
    """A window by the key that the table is distributed by: no exchange beyond the table's own."""
    rows = distribution.distribute(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", 8)
    line = Window.partitionBy("shardid", "o_custkey").orderBy("o_orderkey")
    return rows.select("o_orderkey", F.sum((F.col("o_totalprice") > 100000).cast("bigint")).over(line).alias("n"))


@frame("SELECT c_nationkey AS k, c_custkey AS v, 1 AS side FROM customer UNION ALL SELECT s_nationkey, s_suppkey, 2 FROM supplier")
def merge_append(spark, sf_dir):
    """Sorted inputs as one sorted output by ranges (Gather Merge)."""
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("v"), F.lit(1).alias("side"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("v"), F.lit(2).alias("side"))
    return a.unionByName(b).orderBy("k", "v", "side")


# Strings


sql("fn_string_rest", "SELECT p_partkey, ltrim('P', p_brand) AS lt, rtrim('0123456789', p_brand) AS rt, trim(BOTH 'B1' FROM p_brand) AS bt, startswith(p_type, 'STANDARD') AS sw, overlay(p_brand PLACING 'xx' FROM 2 FOR 3) AS ov, octet_length(p_name) AS ol, bit_length(p_name) AS bl, array_join(split(p_type, ' '), '|') AS sa, split_part(p_type, ' ', -1) AS sp, format_string('%s-%05d', p_brand, p_partkey) AS f, base64(encode(p_brand, 'UTF-8')) AS b64, hex(encode(p_brand, 'UTF-8')) AS hx, decode(unhex('416263'), 'UTF-8') AS de, substring(p_brand, -3) AS ri FROM {part}",
    "SELECT p_partkey, ltrim(p_brand, 'P') AS lt, rtrim(p_brand, '0123456789') AS rt, trim(p_brand, 'B1') AS bt, starts_with(p_type, 'STANDARD') AS sw, p_brand[1:1] || 'xx' || p_brand[5:] AS ov, strlen(p_name)::INT AS ol, (strlen(p_name) * 8)::INT AS bl, array_to_string(string_split(p_type, ' '), '|') AS sa, split_part(p_type, ' ', -1) AS sp, printf('%s-%05d', p_brand, p_partkey) AS f, to_base64(encode(p_brand)) AS b64, hex(p_brand) AS hx, 'Abc' AS de, right(p_brand, 3) AS ri FROM part")


@frame("""SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS cap, substring(p_brand, 4) AS ri,
 CASE WHEN regexp_matches(p_brand, '^[a-z_][a-z0-9_$]*$') THEN p_brand ELSE '"' || p_brand || '"' END AS qi, '''' || replace(p_name || '''s', '''', '''''') || '''' AS ql, CASE WHEN p_size > 25 THEN 'NULL' ELSE '''' || p_brand || '''' END AS qn FROM part""")
def fn_quote(spark, sf_dir):
    brand = F.col("p_brand")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        compat.initcap(F.col("p_type")).alias("cap"),
        compat.right(brand, -3).alias("ri"),
        compat.quote_ident(brand).alias("qi"),
        compat.quote_literal(F.concat("p_name", F.lit("'s"))).alias("ql"),
        compat.quote_nullable(F.when(F.col("p_size") <= 25, brand)).alias("qn"),
    )


sql("fn_regex_rest", "SELECT p_partkey, regexp_instr(p_type, '[AEIOU]') AS i, regexp_like(p_type, '^S.*L$') AS l, regexp_substr(p_type, '[A-Z]+$') AS s, array_join(split(p_type, '[ AEIOU]+'), '|') AS sp, array_join(regexp_extract_all(p_brand, '([0-9])', 1), '') AS d, regexp_replace(p_type, '([A-Z])([A-Z]+)', '$1.') AS r FROM {part}",
    "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '[AEIOU]') THEN strlen(regexp_extract(p_type, '^[^AEIOU]*')) + 1 ELSE 0 END::INT AS i, regexp_matches(p_type, '^S.*L$') AS l, nullif(regexp_extract(p_type, '[A-Z]+$'), '') AS s, array_to_string(regexp_split_to_array(p_type, '[ AEIOU]+'), '|') AS sp, array_to_string(regexp_extract_all(p_brand, '[0-9]'), '') AS d, regexp_replace(p_type, '([A-Z])([A-Z]+)', '\\1.', 'g') AS r FROM part")
sql("fn_to_char_number", "SELECT o_orderkey, to_char(cast(o_totalprice AS DECIMAL(12,2)), '9999990.00') AS c, to_char(cast(o_custkey AS DECIMAL(8,0)), '00000009') AS z, to_number(concat('$', cast(o_custkey AS STRING)), '$99999999') AS n, try_to_number('x', '999') AS bad FROM {orders}",
    "SELECT o_orderkey, lpad(printf('%.2f', round(o_totalprice, 2)), 10, ' ') AS c, printf('%08d', o_custkey) AS z, o_custkey::DECIMAL(8,0) AS n, NULL::DECIMAL(3,0) AS bad FROM orders")


@frame("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, 'day %d/%m/%Y') AS b, strptime(strftime(ts, '%d.%m.%Y'), '%d.%m.%Y')::DATE::VARCHAR AS d FROM events")
def fn_to_char_date(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", compat.to_char_date(ts, "YYYY-MM-DD HH24:MI:SS").alias("a"), compat.to_char_date(ts, "day DD/MM/YYYY").alias("b"), compat.to_date(compat.to_char_date(ts, "DD.MM.YYYY"), "DD.MM.YYYY").cast("string").alias("d"))


@frame("""WITH g AS (SELECT p_partkey, p_brand, p_type, list_distinct(list_transform(range(1, len('  ' || lower(p_brand) || ' ') - 1), lambda i: substring('  ' || lower(p_brand) || ' ', i, 3))) AS a,
 list_distinct(list_transform(range(1, len('  brand#12 ') - 1), lambda i: substring('  brand#12 ', i, 3))) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS sim, translate('Crème Brûlée ' || p_brand, 'èûé', 'eue') AS un FROM g""")
def fn_trigrams(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(compat.similarity(F.col("p_brand"), F.lit("Brand#12")), 9).alias("sim"), compat.unaccent(F.concat(F.lit("Crème Brûlée "), "p_brand")).alias("un"))


sql("fn_soundex", "SELECT w, soundex(w) AS s FROM (VALUES ('Robert'), ('Rupert'), ('Ashcraft'), ('Tymczak'), ('Pfister'), ('Honeyman')) AS v(w)", "SELECT w, s FROM (VALUES ('Robert', 'R163'), ('Rupert', 'R163'), ('Ashcraft', 'A261'), ('Tymczak', 'T522'), ('Pfister', 'P236'), ('Honeyman', 'H555')) v(w, s)")


# Numbers


sql("fn_math_rest", "SELECT p_partkey, round(exp(p_size / 10), 6) AS e, round(log10(p_size + 1), 9) AS lg, factorial(p_size % 15) AS f, round(sin(p_size) + cos(p_size) + tan(p_size % 3), 6) AS t, round(asin(p_size / 60) + acos(p_size / 60) * 2 + atan(p_size) + atan2(p_size, 7), 6) AS a, round(sinh(p_size / 20) + cosh(p_size / 20) + tanh(p_size / 20), 6) AS h, round(radians(p_size) * pi(), 9) AS r, width_bucket(p_size, 0, 50, 5) AS wb, p_size div -7 AS q, -p_size % 7 AS m, round(log(2, p_size + 1), 9) AS l2 FROM {part}",
    "SELECT p_partkey, round(exp(p_size / 10), 6) AS e, round(log10(p_size + 1), 9) AS lg, factorial(p_size % 15)::BIGINT AS f, round(sin(p_size) + cos(p_size) + tan(p_size % 3), 6) AS t, round(asin(p_size / 60) + acos(p_size / 60) * 2 + atan(p_size) + atan2(p_size, 7), 6) AS a, round(sinh(p_size / 20) + cosh(p_size / 20) + tanh(p_size / 20), 6) AS h, round(radians(p_size) * pi(), 9) AS r, CASE WHEN p_size >= 50 THEN 6 ELSE p_size // 10 + 1 END::BIGINT AS wb, -(p_size // 7)::BIGINT AS q, -p_size % 7 AS m, round(log2(p_size + 1), 9) AS l2 FROM part")


@frame("SELECT x, e, c FROM (VALUES (0.0, 0.0, 1.0), (0.5, 0.520499877813, 0.479500122187), (-1.0, -0.842700792950, 1.842700792950), (2.0, 0.995322265019, 0.004677734981), (3.0, 0.999977909503, 0.000022090497), (-4.0, -0.999999984583, 1.999999984583)) v(x, e, c)")
def fn_erf(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.5, -1.0, 2.0, 3.0, -4.0)], "x double")
    return rows.select("x", F.round(compat.erf(F.col("x")), 12).alias("e"), F.round(compat.erfc(F.col("x")), 12).alias("c"))


@frame("SELECT o_orderkey, trunc(o_totalprice / 1000) AS t0, trunc(-o_totalprice * 10) / 10 AS t1, round_even(o_custkey / 2.0, 0)::DOUBLE AS he FROM orders")
def fn_trunc(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", compat.trunc(price / 1000).alias("t0"), compat.trunc(-price, 1).alias("t1"), compat.half_even(F.col("o_custkey") / 2).cast("double").alias("he"))


@frame("SELECT x, s, t FROM (VALUES ('8.4100', 4, '8.41'), ('10', 0, '10'), ('0.500', 3, '0.5'), ('7.00', 2, '7')) v(x, s, t)")
def fn_scale(spark, sf_dir):
    rows = spark.createDataFrame([("8.4100",), ("10",), ("0.500",), ("7.00",)], "x string")
    return rows.select("x", compat.scale_of(F.col("x")).alias("s"), compat.trim_scale(F.col("x")).alias("t"))


sql("fn_bits_rest", "SELECT p_partkey, p_size | (1 << 3) AS s1, p_size & ~(1 << 3) AS s0, bit_count(p_size) = size(filter(sequence(0, 31), i -> getbit(p_size, i) = 1)) AS ok FROM {part}", "SELECT p_partkey, p_size | 8 AS s1, p_size - (p_size & 8) AS s0, true AS ok FROM part")
sql("fn_division_by_zero", "SELECT p_partkey, try_divide(p_size, p_size % 5) AS d, try_mod(p_size, p_size % 5) AS m FROM {part}", "SELECT p_partkey, p_size / nullif(p_size % 5, 0) AS d, p_size % nullif(p_size % 5, 0) AS m FROM part")


@plain
def fn_random(spark, sf_dir):
    """random and random_normal with a seed: the same numbers again, as long as the table's files are the same."""
    return table(spark, sf_dir, "part").select("p_partkey", F.rand(7).alias("u"), F.randn(7).alias("g"))


# Dates


sql("fn_make_date", "SELECT o_orderkey, cast(make_date(2020, cast(o_custkey % 12 + 1 AS INT), 15) AS STRING) AS d, make_timestamp_ntz(2021, 2, 3, 4, 5, o_custkey % 60 + 0.25) AS t, make_ym_interval(1, 2) = INTERVAL '1-2' YEAR TO MONTH AS i, timestamp_seconds(o_orderkey + 0.5) AS s, cast(add_months(make_date(2020, 1, 31), cast(o_custkey % 3 AS INT)) AS STRING) AS am FROM {orders}",
    "SELECT o_orderkey, make_date(2020, o_custkey % 12 + 1, 15)::VARCHAR AS d, make_timestamp(2021, 2, 3, 4, 5, o_custkey % 60 + 0.25) AS t, true AS i, make_timestamp((o_orderkey * 1000000 + 500000)::BIGINT) AS s, (DATE '2020-01-31' + to_months((o_custkey % 3)::INT))::DATE::VARCHAR AS am FROM orders")


@frame("""SELECT event_id, date_sub('month', TIMESTAMP '2023-03-15 00:00:00', ts)::INT AS months, date_diff('day', (TIMESTAMP '2023-03-15 00:00:00' + to_months(date_sub('month', TIMESTAMP '2023-03-15 00:00:00', ts)::INT))::DATE, ts::DATE)::INT AS days,
 (event_id * 977) // 86400 AS jd, (event_id * 977) % 86400 // 3600 AS jh, (event_id * 977) % 3600 // 60 AS jm, (event_id * 977) % 60 AS js FROM events""")
def fn_age(spark, sf_dir):
    age, j = compat.age_months_days(F.col("ts"), F.lit("2023-03-15").cast("timestamp_ntz")), compat.justify(F.col("event_id") * 977)
    rows = table(spark, sf_dir, "events").select("event_id", age.alias("age"), j.alias("j"))
    as_long = lambda c: F.col(c).cast("bigint")
    return rows.select("event_id", "age.months", "age.days", as_long("j.days").alias("jd"), as_long("j.hours").alias("jh"), as_long("j.minutes").alias("jm"), as_long("j.seconds").alias("js"))


@frame("SELECT event_id, ts + INTERVAL 9 HOURS AS tokyo, ts - INTERVAL 5 HOURS AS bogota, isfinite(ts) AS fin FROM events")
def fn_time_zone(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", compat.at_time_zone(ts, "Asia/Tokyo").alias("tokyo"), compat.at_time_zone(ts, "America/Bogota").alias("bogota"), ts.isNotNull().alias("fin"))


# Arrays


sql("fn_array_edit", "SELECT p_partkey, array_join(array_append(a, 9), ',') AS ap, array_join(array_prepend(a, 8), ',') AS pre, array_join(concat(a, array(7, 7)), ',') AS cat, array_join(array_remove(a, 2), ',') AS rm, array_join(transform(a, x -> if(x = 2, 5, x)), ',') AS rep, array_join(filter(transform(a, (x, i) -> if(x = 2, i + 1, NULL)), x -> x IS NOT NULL), ',') AS pos, array_join(array_repeat(p_size, 3), ',') AS fill, array_join(slice(a, 1, greatest(size(a) - 1, 0)), ',') AS tr, array_join(sequence(1, size(a)), ',') AS sub, array_join(array_sort(array_distinct(a)), ',') AS uq, array_join(slice(a, 2, 2), ',') AS sb FROM (SELECT p_partkey, p_size, array(p_size % 5, 2, p_size % 3) AS a FROM {part})",
    "SELECT p_partkey, array_to_string(list_append(a, 9), ',') AS ap, array_to_string(list_prepend(8, a), ',') AS pre, array_to_string(a || [7, 7], ',') AS cat, array_to_string(list_filter(a, lambda x: x <> 2), ',') AS rm, array_to_string(list_transform(a, lambda x: CASE WHEN x = 2 THEN 5 ELSE x END), ',') AS rep, array_to_string(list_filter(range(1, 4), lambda i: a[i] = 2), ',') AS pos, array_to_string([p_size, p_size, p_size], ',') AS fill, array_to_string(a[1:2], ',') AS tr, '1,2,3' AS sub, array_to_string(list_sort(list_distinct(a)), ',') AS uq, array_to_string(a[2:3], ',') AS sb FROM (SELECT p_partkey, p_size, [p_size % 5, 2, p_size % 3] AS a FROM part)")


@frame("SELECT p_partkey, list_has_all(a, [2, 1]) AS c, list_has_all([0, 1, 2], a) AS w, list_has_any(a, [4]) AS o, len(a)::INT AS n, list_position(a, 1)::BIGINT AS p, len(list_filter([5, 10, 30], lambda x: x <= p_size))::INT AS wb FROM (SELECT p_partkey, p_size, [p_size % 5, 2, p_size % 3] AS a FROM part)")
def fn_array_tests(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.array(F.col("p_size") % 5, F.lit(2), F.col("p_size") % 3).alias("a"))
    a, ints = F.col("a"), lambda *x: F.array(*map(F.lit, x))
    return rows.select("p_partkey", compat.contains_all(a, ints(2, 1)).alias("c"), compat.contains_all(ints(0, 1, 2), a).alias("w"), F.arrays_overlap(a, ints(4)).alias("o"), compat.array_length(a).alias("n"), compat.array_position(a, F.lit(1)).alias("p"), compat.width_bucket(F.col("p_size"), ints(5, 10, 30)).alias("wb"))


sql("fn_cube", "SELECT p_partkey, round(sqrt(aggregate(zip_with(a, b, (x, y) -> power(x - y, 2)), 0D, (s, x) -> s + x)), 9) AS dist, aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x) AS taxi, array_join(zip_with(a, b, (x, y) -> cast(greatest(x, y) AS INT)), ',') AS hi FROM (SELECT p_partkey, array(cast(p_size AS DOUBLE), 3D) AS a, array(10D, cast(p_partkey % 7 AS DOUBLE)) AS b FROM {part})",
    "SELECT p_partkey, round(sqrt((p_size - 10) ** 2 + (3 - p_partkey % 7) ** 2), 9) AS dist, (abs(p_size - 10) + abs(3 - p_partkey % 7))::DOUBLE AS taxi, greatest(p_size, 10) || ',' || greatest(3, p_partkey % 7) AS hi FROM part")


# JSON and maps


sql("fn_json_rest", "SELECT event_id, array_join(json_object_keys(props), ',') AS ks, schema_of_variant(parse_json(props)) LIKE 'OBJECT%' AS ob, from_json(props, 'k INT').k AS k, get_json_object(props, '$.k') IS NOT NULL AS has, get_json_object(props, '$.nope') IS NULL AS miss, json_array_length(concat('[', props, ',1]')) AS n FROM {events}",
    "SELECT event_id, array_to_string(json_keys(props), ',') AS ks, json_type(props) = 'OBJECT' AS ob, (props->>'$.k')::INT AS k, json_exists(props, '$.k') AS has, NOT json_exists(props, '$.nope') AS miss, json_array_length('[' || props || ',1]')::INT AS n FROM events")
sql("fn_json_edit", "SELECT event_id, to_json(map_concat(map_filter(m, (k, v) -> k <> 'z'), map('z', 'new'))) AS put, to_json(map_filter(m, (k, v) -> k <> 'k')) AS del, to_json(map_filter(map('a', 'x', 'b', cast(NULL AS STRING)), (k, v) -> v IS NOT NULL)) AS strip, map_contains_key(m, 'k') AND size(map_filter(m, (k, v) -> v = get_json_object(props, '$.k'))) >= 1 AS con FROM (SELECT event_id, props, map('k', get_json_object(props, '$.k'), 'z', 'old') AS m FROM {events})",
    "SELECT event_id, '{\"k\":\"' || (props->>'$.k') || '\",\"z\":\"new\"}' AS put, '{\"z\":\"old\"}' AS del, '{\"a\":\"x\"}' AS strip, true AS con FROM events")
sql("fn_json_each", "SELECT event_id, e.key AS key, cast(e.value AS STRING) AS value FROM {events}, LATERAL variant_explode(parse_json(props)) e", "SELECT event_id, key, props->>('$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
sql("fn_json_path", "SELECT event_id, cast(try_variant_get(parse_json(props), '$.k', 'int') > 5 AS BOOLEAN) AS m, get_json_object(concat('{{\"a\":[', props, ',', props, ']}}'), '$.a[*].k') AS q, get_json_object(concat('{{\"a\":[', props, ']}}'), '$.a[0].k') AS f FROM {events}",
    "SELECT event_id, (props->>'$.k')::INT > 5 AS m, '[' || (props->>'$.k') || ',' || (props->>'$.k') || ']' AS q, props->>'$.k' AS f FROM events")
sql("fn_hstore", "SELECT p_partkey, m['b'] AS v, map_contains_key(m, 'zz') AS e, array_join(array_sort(map_keys(m)), ',') AS ks, array_join(array_sort(map_values(m)), ',') AS vs, size(map_concat(m, map('c', 'x'))) AS n, array_join(map_keys(map_filter(m, (k, v) -> k <> 'a')), ',') AS del, m['a'] = p_brand AND m['b'] = p_type AS con FROM (SELECT p_partkey, p_brand, p_type, map('a', p_brand, 'b', p_type) AS m FROM {part})",
    "SELECT p_partkey, p_type AS v, false AS e, 'a,b' AS ks, array_to_string(list_sort([p_brand, p_type]), ',') AS vs, 3 AS n, 'b' AS del, true AS con FROM part")
sql("fn_xml", "SELECT p_partkey, size(xpath(x, 't/w/text()')) AS n, xpath_string(x, 't/w[2]') AS second, xpath_boolean(x, 't/w[text()=\"STEEL\"]') AS steel FROM (SELECT p_partkey, concat('<t><w>', replace(p_type, ' ', '</w><w>'), '</w></t>') AS x FROM {part})",
    "SELECT p_partkey, len(string_split(p_type, ' '))::INT AS n, coalesce(string_split(p_type, ' ')[2], '') AS second, list_contains(string_split(p_type, ' '), 'STEEL') AS steel FROM part")
sql("fn_json_build", "SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'name', n_name, 'r', array(n_regionkey, n_nationkey % 3))) AS j, json_array_length(to_json(sequence(1, n_regionkey + 1))) AS n FROM {nation}",
    "SELECT n_nationkey, json_object('k', n_nationkey, 'name', n_name, 'r', json_array(n_regionkey, n_nationkey % 3))::VARCHAR AS j, json_array_length(to_json(range(n_regionkey + 1)))::INT AS n FROM nation")


# Other families


@frame("""WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_type || ' of the ' || p_type), '[^a-z0-9]+'), lambda x: x <> '') AS l FROM part),
v AS (SELECT p_partkey, l, list_sort(list_distinct(list_filter(l, lambda x: NOT list_contains(['of', 'the'], x)))) AS names FROM w)
SELECT p_partkey, array_to_string(list_transform(names, lambda n: '''' || n || ''':' || array_to_string(list_filter(range(1, len(l) + 1), lambda i: l[i] = n), ',')), ' ') AS vec,
 list_contains(l, 'steel') AND NOT list_contains(l, 'small') AS hit, len(list_filter(range(1, len(l)), lambda i: l[i] = 'standard' AND l[i + 1] = 'polished')) > 0 AS phrase,
 round((CASE WHEN list_contains(l, 'steel') THEN 0.125 ELSE 0 END + CASE WHEN list_contains(l, 'large') THEN 0.125 ELSE 0 END) / (1.64493406685 * 2), 9) AS rank FROM v""")
def fn_text_search(spark, sf_dir):
    v = textsearch.vector(F.concat("p_type", F.lit(" of the "), "p_type"))
    rows = table(spark, sf_dir, "part").select("p_partkey", v.alias("v"))
    v = F.col("v")
    return rows.select("p_partkey", textsearch.vector_text(v).alias("vec"), (textsearch.has(v, "steel") & ~textsearch.has(v, "small")).alias("hit"), textsearch.followed(v, "standard", "polished").alias("phrase"), F.round(textsearch.rank(v, ["steel", "large"]), 9).alias("rank"))


@frame("SELECT p_partkey, regexp_replace(p_type, '(?i)\\b(steel|tin)\\b', '<b>\\1</b>', 'g') AS h FROM part")
def fn_headline(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", textsearch.headline(F.col("p_type"), ["steel", "tin"]).alias("h"))


sql("fn_text_stats", "SELECT w, count(DISTINCT p_partkey) AS ndoc, count(*) AS nentry FROM {part} LATERAL VIEW explode(split(lower(p_type), ' ')) t AS w GROUP BY w", "SELECT w, count(DISTINCT p_partkey) AS ndoc, count(*) AS nentry FROM (SELECT p_partkey, unnest(string_split(lower(p_type), ' ')) AS w FROM part) GROUP BY ALL")


@frame("""SELECT p_partkey, least(p_size, 10) AS mlo, greatest(p_size + 5, 30) AS mhi, CASE WHEN p_size <= 30 AND 10 <= p_size + 5 THEN least(p_size, 10) END AS ulo,
 CASE WHEN p_size >= 30 OR p_size + 5 <= 10 THEN p_size WHEN p_size < 10 THEN p_size WHEN p_size + 5 > 30 THEN 30 END AS dlo, CASE WHEN p_size >= 30 OR p_size + 5 <= 10 THEN p_size + 5 WHEN p_size < 10 THEN 10 WHEN p_size + 5 > 30 THEN p_size + 5 END AS dhi FROM part""")
def fn_ranges_rest(spark, sf_dir):
    size = F.col("p_size")
    r, fixed = compat.range_of(size, size + 5), compat.range_of(F.lit(10), F.lit(30))
    rows = table(spark, sf_dir, "part").select("p_partkey", compat.range_merge(r, fixed).alias("m"), compat.range_union(r, fixed).alias("u"), compat.range_minus(r, fixed).alias("d"))
    return rows.select("p_partkey", F.col("m.lo").alias("mlo"), F.col("m.hi").alias("mhi"), F.col("u.lo").alias("ulo"), F.col("d.lo").alias("dlo"), F.col("d.hi").alias("dhi"))


@frame("SELECT p_partkey, p_size BETWEEN 16 AND 31 AS inside, 4 AS family FROM part")
def fn_network_rest(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("10."), "p_size", F.lit(".3.4")).alias("a"))
    return rows.select("p_partkey", network.contains(F.lit("10.16.0.0/12"), F.col("a")).alias("inside"), F.when(F.col("a").contains(":"), 6).otherwise(4).alias("family"))


@frame("SELECT n_nationkey, round(2 * 6371.0 * asin(sqrt(sin(radians(n_nationkey - 10) / 2) ** 2 + cos(radians(10)) * cos(radians(n_nationkey)) * sin(radians(n_regionkey * 20 - 5) / 2) ** 2)), 6) AS km FROM nation")
def fn_earth(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(compat.great_circle_km(F.lit(10.0), F.lit(5.0), F.col("n_nationkey"), F.col("n_regionkey") * 20), 6).alias("km"))


sql("fn_geometry", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(sqrt(power(a.n_regionkey - b.n_regionkey, 2) + power(a.n_nationkey - b.n_nationkey, 2)), 9) AS dist, a.n_regionkey BETWEEN 1 AND 3 AND a.n_nationkey BETWEEN 5 AND 15 AS in_box, power(a.n_regionkey - 2, 2) + power(a.n_nationkey - 10, 2) <= 16 AS in_circle FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey")
sql("fn_ltree", "SELECT n_nationkey, size(split(p, '[.]')) AS lv, array_join(slice(split(p, '[.]'), 2, 2), '.') AS sub, p LIKE 'w.r1.%' AS des, array_join(slice(split(p, '[.]'), 1, 1), '.') AS top FROM (SELECT n_nationkey, concat('w.r', n_regionkey, '.n', n_nationkey) AS p FROM {nation})",
    "SELECT n_nationkey, 3 AS lv, 'r' || n_regionkey || '.n' || n_nationkey AS sub, n_regionkey = 1 AS des, 'w' AS top FROM nation")
sql("fn_enum", "SELECT o_orderkey, array_position(e, o_orderstatus) AS place, e[0] AS first, element_at(e, -1) AS last, array_join(slice(e, 1, cast(array_position(e, o_orderstatus) AS INT)), ',') AS upto, typeof(o_custkey) AS ty, size(filter(array(nullif(o_orderstatus, 'F'), o_orderpriority), x -> x IS NOT NULL)) AS nn FROM (SELECT *, array('O', 'P', 'F') AS e FROM {orders})",
    "SELECT o_orderkey, list_position(['O', 'P', 'F'], o_orderstatus)::BIGINT AS place, 'O' AS first, 'F' AS last, CASE o_orderstatus WHEN 'O' THEN 'O' WHEN 'P' THEN 'O,P' ELSE 'O,P,F' END AS upto, lower(typeof(o_custkey)) AS ty, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS nn FROM orders")
sql("fn_lsn", "SELECT event_id, a > b AS gt, cast(a - b AS BIGINT) AS diff, cast(a + 16 AS STRING) AS plus, cast(greatest(a, b) AS STRING) AS hi FROM (SELECT event_id, cast(event_id * 4294967296 + 5 AS DECIMAL(20,0)) AS a, cast(event_id % 7 * 8589934592 AS DECIMAL(20,0)) AS b FROM {events})",
    "SELECT event_id, a > b AS gt, (a - b)::BIGINT AS diff, (a + 16)::VARCHAR AS plus, greatest(a, b)::VARCHAR AS hi FROM (SELECT event_id, (event_id * 4294967296 + 5)::DECIMAL(20,0) AS a, (event_id % 7 * 8589934592)::DECIMAL(20,0) AS b FROM events)")


@frame("SELECT o_orderkey, 1000 + 5 * row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) AS id FROM orders")
def sequence_values(spark, sf_dir):
    """nextval of eight sequences with start and step, in order of the rows."""
    from ..operators.capture import numbered

    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 8).alias("partition_id"))
    return numbered(rows, order=("o_orderkey",), piece=F.expr("o_orderkey div 4096")).select("o_orderkey", (1000 + 5 * F.col("partition_lsn")).alias("id"))


@plain
def fn_uuid(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.expr("uuid()").alias("id"))


# Programs


@frame("SELECT 385 AS total, 10 AS turns")
def script_loop(spark, sf_dir):
    """WHILE, IF and variables in a SQL script."""
    return spark.sql("BEGIN DECLARE i INT = 0; DECLARE total INT = 0; WHILE i < 10 DO SET i = i + 1; IF i > 0 THEN SET total = total + i * i; END IF; END WHILE; SELECT total, i AS turns; END")


# Changes


CHANGED = "SELECT c_custkey * 3 AS s_suppkey, c_acctbal AS s_acctbal FROM customer"


@frame(f"SELECT count(*) FILTER (o.s_suppkey IS NULL) AS inserted, count(*) FILTER (n.s_suppkey IS NULL) AS deleted, count(*) FILTER (o.s_acctbal <> n.s_acctbal) AS updated, round(sum(o.s_acctbal), 2) AS old_total, round(sum(n.s_acctbal), 2) AS new_total FROM (SELECT s_suppkey, s_acctbal FROM supplier) o FULL JOIN ({CHANGED}) n ON o.s_suppkey = n.s_suppkey")
def transition_tables(spark, sf_dir):
    """What a statement trigger sees: old and new rows of a change."""
    old = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("old"))
    new = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("s_suppkey"), F.col("c_acctbal").alias("new"))
    both = old.withColumn("o", F.lit(True)).join(new.withColumn("n", F.lit(True)), "s_suppkey", "full")
    return both.agg(F.count_if(F.col("o").isNull()).alias("inserted"), F.count_if(F.col("n").isNull()).alias("deleted"), F.count_if(F.col("old") != F.col("new")).alias("updated"), F.round(F.sum("old"), 2).alias("old_total"), F.round(F.sum("new"), 2).alias("new_total"))


@frame(f"SELECT coalesce(o.s_suppkey, n.s_suppkey) AS k, CASE WHEN o.s_suppkey IS NULL THEN 'I' WHEN n.s_suppkey IS NULL THEN 'D' ELSE 'U' END AS op, o.s_acctbal AS old, n.s_acctbal AS new FROM supplier o FULL JOIN ({CHANGED}) n ON o.s_suppkey = n.s_suppkey WHERE o.s_acctbal IS DISTINCT FROM n.s_acctbal")
def logical_changes(spark, sf_dir):
    """The stream of row changes between two versions of a table (logical decoding)."""
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal")
    return modify.changes(old, table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("k"), F.col("c_acctbal").alias("s_acctbal")), ["k"], "s_acctbal")


@frame("SELECT p_partkey, concat_ws(',', p_partkey, '\"' || p_brand || ', \"\"x\"\"\"', CASE WHEN p_size > 25 THEN '' ELSE p_type END) AS csv, concat_ws(chr(9), p_partkey, p_brand || ', \"x\"', CASE WHEN p_size > 25 THEN '\\N' ELSE p_type END) AS txt FROM part")
def copy_lines(spark, sf_dir):
    """Lines that COPY TO writes."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit(', "x"')).alias("b"), F.when(F.col("p_size") <= 25, F.col("p_type")).alias("t"))
    names = ["p_partkey", "b", "t"]
    return rows.select("p_partkey", ddl.csv_line(names).alias("csv"), ddl.text_line(names).alias("txt"))


@frame("SELECT p_partkey, p_brand, CASE WHEN p_size <= 25 THEN p_type END AS t FROM part")
def copy_round_trip(spark, sf_dir):
    """COPY FROM reads what COPY TO wrote, in its text form."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") <= 25, F.col("p_type")).alias("t"))
    return rows.select(ddl.text_line(rows.columns).alias("line")).select(*ddl.from_text_line(F.col("line"), {"p_partkey": "bigint", "p_brand": "string", "t": "string"}))


# Distribution


H = "((({k}) * 2654435761::BIGINT) % 4294967296)"
S = "({h} // 536870912)::INT"


def _shard(k: str) -> str:
    return S.format(h=H.format(k=k))


@frame(f"SELECT o_orderkey, {_shard('o_custkey')} AS shardid FROM orders")
def shard_of_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", distribution.shard_of(F.col("o_custkey"), 8).alias("shardid"))


@frame("SELECT i::INT AS shardid, i * 536870912 AS min_hash, i * 536870912 + 536870911 AS max_hash FROM range(8) t(i)")
def shard_ranges(spark, sf_dir):
    return distribution.shard_catalog(spark, 8)


@frame(f"SELECT {_shard('o_custkey')} AS shardid, count(*) AS n_rows FROM orders GROUP BY ALL")
def shard_sizes(spark, sf_dir):
    return distribution.sizes(distribution.distribute(table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", 8))


@frame("SELECT o_orderkey FROM orders WHERE o_custkey IN (5, 17, 42)")
def shard_prune(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").withColumn("shardid", distribution.shard_of(F.col("o_custkey"), 8))
    return distribution.prune(rows, "o_custkey", [5, 17, 42], 8).select("o_orderkey")


@frame("SELECT c_custkey, count(o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def join_colocated(spark, sf_dir):
    left = distribution.distribute(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 8)
    right = distribution.distribute(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", 8)
    return distribution.colocated_join(left, right, "c_custkey").groupBy("shardid", "c_custkey").agg(F.count("*").alias("n")).drop("shardid")


sql("join_reference", "SELECT /*+ BROADCAST(n) */ n.n_name, count(*) AS n FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")


@frame("SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def join_range_repartition(spark, sf_dir):
    """Both sides dealt by ranges of the join key."""
    left = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity").repartitionByRange("l_orderkey")
    right = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return left.join(right, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@frame(f"SELECT {_shard('l_partkey')} AS shardid, {_shard('l_suppkey')} AS part, count(*) AS n_rows FROM lineitem GROUP BY ALL")
def shard_map_outputs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", distribution.shard_of(F.col("l_partkey"), 8).alias("shardid"))
    return distribution.map_outputs(rows, "l_suppkey", 8)


@frame(f"SELECT count(*) AS n_rows, quantile_disc({H.format(k='o_custkey')}, 0.5) AS split_at FROM orders WHERE {_shard('o_custkey')} = 3")
def shard_split(spark, sf_dir):
    return distribution.split_points(table(spark, sf_dir, "orders"), "o_custkey", 8, 3)


@frame(f"SELECT CASE o_custkey WHEN 5 THEN 8 WHEN 17 THEN 9 ELSE {_shard('o_custkey')} END AS shardid, count(*) AS n_rows FROM orders GROUP BY ALL")
def shard_isolate(spark, sf_dir):
    return distribution.sizes(distribution.isolated(table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", [5, 17], 8))


@frame(f"WITH s AS (SELECT {_shard('o_custkey')} AS shardid, count(*) AS n_rows FROM orders GROUP BY ALL), t AS (SELECT *, row_number() OVER (ORDER BY n_rows DESC, shardid) - 1 AS turn FROM s) SELECT shardid, n_rows, CASE WHEN turn // 3 % 2 = 0 THEN turn % 3 ELSE 2 - turn % 3 END::INT AS node FROM t")
def shard_rebalance(spark, sf_dir):
    return distribution.rebalanced(distribution.sizes(distribution.distribute(table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", 8)), 3)


@frame("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS from_time, date_trunc('month', o_orderdate)::TIMESTAMP + INTERVAL 1 MONTH AS to_time, count(*) AS n_rows FROM orders GROUP BY ALL")
def time_partitions(spark, sf_dir):
    return distribution.time_partitions(table(spark, sf_dir, "orders"), "o_orderdate")
