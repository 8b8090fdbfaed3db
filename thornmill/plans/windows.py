"""Window functions and frames."""

from pyspark.sql import functions as F

from .base import Family, load

F2 = Family()
_O = "FROM {orders}"

F2.same("win_row_number", f"SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn {_O}")
F2.same("win_rank", f"SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS BIGINT) AS r {_O}")
F2.same("win_dense_rank", f"SELECT o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS BIGINT) AS r {_O}")
F2.same("win_ntile", f"SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS t {_O}")
F2.same("win_lag_lead", f"SELECT o_orderkey, lag(o_totalprice, 1, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after {_O}")
F2.same("win_first_last_nth", f"SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n {_O} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
F2.same("win_percent_cume", f"SELECT o_orderkey, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c {_O} WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_custkey)")
F2.same("win_running_sum_range", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey), 2) AS q FROM {lineitem}")
F2.same("win_rows_frame", f"SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS q {_O}")
F2.same("win_range_frame", f"SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT) AS n {_O}")
F2.same("win_whole_partition", f"SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS share, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most {_O}")
F2.same("win_named", f"SELECT o_orderkey, CAST(count(*) OVER w AS BIGINT) AS n, min(o_totalprice) OVER w AS m {_O} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
F2.both("win_filter", f"SELECT o_orderkey, CAST(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS n {_O}", "SELECT o_orderkey, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS n FROM orders")
F2.both("win_group_concat", "SELECT n_nationkey, array_join(collect_list(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), ',') AS names FROM {nation}", "SELECT n_nationkey, string_agg(n_name, ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS names FROM nation")
F2.same("win_outer_order", f"SELECT o_orderkey, CAST(rank() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r {_O} ORDER BY r LIMIT 10")
F2.same("topk_per_group", "SELECT s_nationkey, s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM {supplier}) t WHERE rn <= 2")


@F2.code("win_groups_frame", "SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS n, round(sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s FROM orders")
def _groups(spark, sf_dir):
    from ..operators.relational import groups_window

    rows, w = groups_window(load(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_custkey"], -2, 1)
    return rows.select("o_orderkey", F.count("*").over(w).alias("n"), F.round(F.sum("o_totalprice").over(w), 2).alias("s"))


@F2.code("win_exclude_current", "SELECT o_orderkey, CAST(count(*) OVER w AS BIGINT) AS n, round(coalesce(sum(o_totalprice) OVER w, 0), 2) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW)")
def _exclude(spark, sf_dir):
    from ..operators.relational import excluding_current

    n, s = excluding_current("o_totalprice", ["o_custkey"], ["o_orderkey"], -2, 2)
    return load(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), F.round(F.coalesce(s, F.lit(0.0)), 2).alias("s"))
