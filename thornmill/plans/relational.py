"""Scans, projection, predicates, joins, subqueries, aggregation, sorting and set operations."""

from pyspark.sql import functions as F

from .base import Family, load

F1 = Family()

# --- projection and predicates
F1.same("scan_projection", "SELECT o_orderkey, o_totalprice * 2 AS double_price, o_orderstatus AS status FROM {orders}")
F1.same("no_from", "SELECT 1 + 2 AS three, 'a' AS letter, CAST(NULL AS INTEGER) AS nothing")
F1.same("pk_lookup", "SELECT * FROM {orders} WHERE o_orderkey = 100")
F1.same("range_seek", "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderkey >= 50 AND o_orderkey < 500")
F1.same("filter_cmp", "SELECT p_partkey, p_size FROM {part} WHERE p_size <> 10 AND p_retailprice > 1200 AND NOT (p_size < 5 OR p_size >= 40)")
F1.same("filter_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.09")
F1.same("filter_in", "SELECT c_custkey, c_mktsegment FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
F1.both("filter_in_empty", "SELECT n_nationkey FROM {nation} WHERE n_nationkey NOT IN (SELECT r_regionkey FROM {region} WHERE false)", "SELECT n_nationkey FROM nation")
F1.both("filter_like", "SELECT p_partkey, p_name FROM {part} WHERE p_name ILIKE '%RE%' AND p_name NOT ILIKE 'a%'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RE%' AND p_name NOT ILIKE 'a%'")
F1.same("filter_like_escape", "SELECT p_partkey FROM {part} WHERE p_type || '_x' LIKE '%!_x' ESCAPE '!'")
F1.both("filter_regexp", "SELECT p_partkey, p_brand FROM {part} WHERE p_brand RLIKE '[13]$'", "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '[13]$')")
F1.same("filter_isnull", "SELECT o.o_orderkey, c.c_custkey IS NULL AS missing, c.c_name IS NOT NULL AS named FROM {orders} o LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 5000")
F1.same("is_distinct", "SELECT n_nationkey, nullif(n_regionkey, 1) IS DISTINCT FROM 2 AS other, nullif(n_regionkey, 1) IS NOT DISTINCT FROM CAST(NULL AS INTEGER) AS unknown FROM {nation}")
F1.same("null_logic", "SELECT n_nationkey, (nullif(n_regionkey, 1) = 2) AND true AS a, (nullif(n_regionkey, 1) = 2) OR true AS o, NOT (nullif(n_regionkey, 1) = 2) AS n FROM {nation}")
F1.same("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band FROM {orders}")
F1.same("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM {orders}")
F1.both(
    "cast_types",
    "SELECT p_partkey, CAST(p_retailprice AS BIGINT) AS whole, CAST(p_size AS DOUBLE) AS real, CAST(p_size AS STRING) AS text, try_cast(p_brand AS INT) AS bad, coalesce(try_cast(regexp_extract(concat(p_size, 'cm'), '^[ ]*([+-]?[0-9]+)', 1) AS BIGINT), 0) AS prefix FROM {part}",
    "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS whole, CAST(p_size AS DOUBLE) AS real, CAST(p_size AS VARCHAR) AS text, TRY_CAST(p_brand AS INTEGER) AS bad, CAST(p_size AS BIGINT) AS prefix FROM part",
)
F1.both(
    "arith_ops",
    "SELECT l_orderkey, l_linenumber, l_quantity + 1 AS a, l_quantity - 2 AS s, round(l_extendedprice * l_tax, 6) AS m, round(try_divide(l_extendedprice, l_linenumber - 1), 6) AS d, try_mod(l_orderkey, CAST(l_linenumber - 1 AS BIGINT)) AS r, -l_quantity AS n FROM {lineitem}",
    "SELECT l_orderkey, l_linenumber, l_quantity + 1 AS a, l_quantity - 2 AS s, round(l_extendedprice * l_tax, 6) AS m, CASE WHEN l_linenumber <> 1 THEN round(l_extendedprice / (l_linenumber - 1), 6) END AS d, CASE WHEN l_linenumber <> 1 THEN l_orderkey % (l_linenumber - 1) END AS r, -l_quantity AS n FROM lineitem",
)
F1.both(
    "bit_ops",
    "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, ~o_orderkey AS n, shiftleft(o_orderkey, 3) AS l, shiftright(o_orderkey, 2) AS r FROM {orders}",
    "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, ~o_orderkey AS n, o_orderkey << 3 AS l, o_orderkey >> 2 AS r FROM orders",
)
F1.same("concat_op", "SELECT n_nationkey, n_name || '-' || n_regionkey AS label, n_name || nullif(n_name, n_name) AS nothing FROM {nation}")
F1.both("row_values", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE struct(l_orderkey, l_linenumber) > struct(100L, 2) AND (l_returnflag, l_linestatus) IN (('R', 'F'), ('A', 'F'))", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 2) AND (l_returnflag, l_linestatus) IN (('R', 'F'), ('A', 'F'))")
F1.same("precedence", "SELECT n_nationkey, 1 + 2 * 3 - 4 AS a, NOT false AND false OR true AS b, 10 - 4 - 3 AS c FROM {nation} WHERE n_nationkey < 2 OR n_regionkey = 1 AND n_nationkey > 5")
F1.both("collate_nocase", "SELECT p_partkey FROM {part} WHERE upper(p_name) COLLATE UTF8_LCASE = p_name", "SELECT p_partkey FROM part WHERE lower(upper(p_name)) = lower(p_name)")
F1.same("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}")
F1.same("star_and_qualified", "SELECT n.*, r.r_name FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey")


@F1.code("params_named", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'")
def _params(spark, sf_dir):
    return spark.sql("SELECT o_orderkey FROM {orders} WHERE o_totalprice > :least AND o_orderstatus = :status".replace("{orders}", f"parquet.`{sf_dir}/orders.parquet`"), args={"least": 150000, "status": "F"})


@F1.code("params_positional", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 100 AND 900")
def _positional(spark, sf_dir):
    return spark.sql(f"SELECT c_custkey FROM parquet.`{sf_dir}/customer.parquet` WHERE c_acctbal BETWEEN ? AND ?", args=[100, 900])


# --- joins
F1.same("join_inner", "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 0")
F1.same("join_left", "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000")
F1.same("join_right", "SELECT o.o_orderkey, c.c_custkey FROM {orders} o RIGHT JOIN {customer} c ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'")
F1.same("join_full", "SELECT a.s_suppkey AS left_key, b.c_custkey AS right_key FROM (SELECT * FROM {supplier} WHERE s_acctbal > 0) a FULL OUTER JOIN {customer} b ON a.s_suppkey = b.c_custkey")
F1.same("join_cross", "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n")
F1.same("join_comma", "SELECT n.n_name, r.r_name FROM {nation} n, {region} r WHERE n.n_regionkey = r.r_regionkey")
F1.same("join_natural", "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM {nation}) a NATURAL JOIN (SELECT s_nationkey AS k, s_name FROM {supplier}) b")


@F1.code("join_using", "SELECT k, c_name, s_name FROM (SELECT c_nationkey AS k, c_name FROM customer) a JOIN (SELECT s_nationkey AS k, s_name FROM supplier) b USING (k)")
def _using(spark, sf_dir):
    from ..operators.relational import few_keys_join

    customers, suppliers = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    return few_keys_join(customers.select(F.col("c_nationkey").alias("k"), "c_name"), suppliers.select(F.col("s_nationkey").alias("k"), "s_name"), "k")


F1.same("join_self", "SELECT a.n_name AS one, b.n_name AS other FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
F1.same("join_multiway", "SELECT c.c_mktsegment, r.r_name, CAST(count(*) AS BIGINT) AS n, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY c.c_mktsegment, r.r_name")
F1.same("join_subquery", "SELECT o.o_orderkey, t.lines FROM {orders} o JOIN (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS lines FROM {lineitem} GROUP BY l_orderkey HAVING count(*) > 5) t ON o.o_orderkey = t.l_orderkey")
F1.same("semi_exists", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
F1.same("anti_not_exists", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)")
F1.same("semi_in", "SELECT s_suppkey FROM {supplier} WHERE s_suppkey IN (SELECT l_suppkey FROM {lineitem} WHERE l_quantity > 49)")


@F1.code("anti_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.05)")
def _not_in(spark, sf_dir):
    from ..operators.relational import not_in

    return not_in(load(spark, sf_dir, "part").select("p_partkey"), "p_partkey", load(spark, sf_dir, "lineitem").where("l_discount > 0.05"), "l_partkey")


F1.same("scalar_subquery", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})")
F1.same("correlated_subquery", "SELECT c.c_custkey, (SELECT CAST(count(*) AS BIGINT) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS n FROM {customer} c")
F1.same("agg_over_join", "SELECT n.n_name, CAST(count(*) AS BIGINT) AS customers, round(avg(c.c_acctbal), 4) AS balance FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
F1.same("window_over_join", "SELECT o.o_orderkey, CAST(row_number() OVER (PARTITION BY c.c_mktsegment ORDER BY o.o_totalprice DESC, o.o_orderkey) AS BIGINT) AS place FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey")


@F1.code(
    "join_range",
    "SELECT e.event_id, b.lo FROM events e JOIN (SELECT range * 50 AS lo, range * 50 + 80 AS hi FROM range(0, 20)) b ON e.value >= b.lo AND e.value < b.hi",
)
def _range_join(spark, sf_dir):
    from ..operators.relational import range_join

    events = load(spark, sf_dir, "events").select("event_id", "value")
    spans = spark.range(20).select((F.col("id") * 50).alias("lo"), (F.col("id") * 50 + 80).alias("hi"))
    return range_join(events, spans, "value", "lo", "hi", width=50.0).select("event_id", "lo")


# --- aggregation
F1.same("agg_group", "SELECT l_returnflag, l_linenumber, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS q, min(l_shipdate) AS first, max(l_discount) AS most FROM {lineitem} GROUP BY l_returnflag, l_linenumber")
F1.same("agg_global", "SELECT CAST(count(*) AS BIGINT) AS n, round(avg(l_quantity), 6) AS q, round(sum(l_extendedprice), 2) AS s FROM {lineitem}")
F1.same("agg_having", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS s FROM {orders} GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 100000")
F1.same("agg_count_distinct", "SELECT l_shipdate < CAST('1995-01-01' AS TIMESTAMP) AS early, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS s, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS f FROM {lineitem} GROUP BY 1")
F1.same("agg_sum_distinct", "SELECT p_brand, CAST(sum(DISTINCT p_size) AS BIGINT) AS s FROM {part} GROUP BY p_brand")
F1.same("agg_filter", "SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_quantity > 25) AS BIGINT) AS large, round(sum(l_tax) FILTER (WHERE l_discount = 0), 6) AS tax FROM {lineitem} GROUP BY l_returnflag")
F1.same("agg_empty", "SELECT CAST(count(*) AS BIGINT) AS n, sum(l_quantity) AS s, avg(l_tax) AS a, min(l_orderkey) AS m FROM {lineitem} WHERE l_quantity < 0")
F1.same("agg_total", "SELECT CAST(coalesce(sum(CAST(l_quantity AS DOUBLE)), 0.0) AS DOUBLE) AS total FROM {lineitem} WHERE l_quantity < 0")
F1.same("agg_null_keys", "SELECT nullif(n_regionkey, 2) AS k, CAST(count(*) AS BIGINT) AS n, CAST(count(nullif(n_nationkey, 3)) AS BIGINT) AS c FROM {nation} GROUP BY nullif(n_regionkey, 2)")
F1.same("agg_order_by_aggregate", "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM {customer} GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment LIMIT 3")
F1.both("agg_group_concat", "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
F1.both("agg_json_array", "SELECT n_regionkey, to_json(sort_array(collect_list(n_nationkey))) AS keys FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']' AS keys FROM nation GROUP BY n_regionkey")
F1.both("agg_json_object", "SELECT n_regionkey, to_json(map_from_entries(sort_array(collect_list(struct(n_name, n_nationkey))))) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS names FROM nation GROUP BY n_regionkey")
F1.same("agg_rollup", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
F1.same("agg_cube", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
F1.same("agg_grouping_sets", "SELECT l_returnflag, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())")
F1.same("count_star", "SELECT CAST(count(*) AS BIGINT) AS n FROM {lineitem}")

# --- sorting, limits, set operations, CTEs, views
F1.same("order_nulls", "SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM {nation} ORDER BY k ASC NULLS LAST, n_nationkey DESC LIMIT 12")
F1.same("order_nulls_first", "SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM {nation} ORDER BY k DESC NULLS FIRST, n_name LIMIT 9")
F1.same("order_ordinal", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY 2 DESC, 1 LIMIT 25")
F1.same("order_hidden_key", "SELECT c_name FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
F1.same("limit_offset", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 20 OFFSET 35")
F1.same("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
F1.same("set_union", "SELECT n_regionkey AS k FROM {nation} UNION SELECT r_regionkey FROM {region}")
F1.same("set_union_all", "SELECT n_regionkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region}")
F1.same("set_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
F1.same("set_except", "SELECT p_partkey AS k FROM {part} EXCEPT SELECT l_partkey FROM {lineitem} WHERE l_quantity > 10")
F1.same("set_intersect_all", "SELECT n_regionkey AS k FROM {nation} INTERSECT ALL SELECT s_nationkey FROM {supplier} WHERE s_nationkey < 5")
F1.same("set_except_all", "SELECT s_nationkey AS k FROM {supplier} EXCEPT ALL SELECT n_nationkey FROM {nation}")
F1.same("values_rows", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")
F1.same("cte_multi", "WITH big AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_custkey), top AS (SELECT * FROM big WHERE n >= 15) SELECT c.c_name, t.n FROM top t JOIN {customer} c ON c.c_custkey = t.o_custkey")
F1.same("cte_recursive", "WITH RECURSIVE steps(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM steps WHERE n < 20) SELECT n, f FROM steps")
F1.same("cte_recursive_tree", "WITH RECURSIVE tree(k, depth) AS (SELECT n_nationkey, 0 FROM {nation} WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.depth + 1 FROM tree t JOIN {nation} n ON n.n_nationkey = t.k * 2 + 1 OR n.n_nationkey = t.k * 2 + 2) SELECT k, depth FROM tree")
F1.same("from_subquery", "SELECT s, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_custkey, CASE WHEN sum(o_totalprice) > 1000000 THEN 'big' ELSE 'small' END AS s FROM {orders} GROUP BY o_custkey) t GROUP BY s")


@F1.code("view_agg", "SELECT c_mktsegment, n FROM (SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY c_mktsegment) WHERE n > 10")
def _view(spark, sf_dir):
    from ..session import Engine

    engine = Engine(spark)
    engine.attach("customer", load(spark, sf_dir, "customer"))
    engine.execute("CREATE VIEW segments AS SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment")
    return engine.execute("SELECT c_mktsegment, n FROM segments WHERE n > 10")
