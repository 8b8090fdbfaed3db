"""Registered queries read their tables whole: rows of high ids count like the others."""

import duckdb
import pytest
from pyspark.sql import functions as F

from thornmill import plans
from thornmill.operators import relational


def rows(spark, folder, name, **tables):
    """The query's rows over small tables, each given as (schema, rows)."""
    for table, (schema, data) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{table}.parquet")
    return [tuple(r) for r in plans.queries()[name](spark, str(folder)).collect()]


def test_highlight_marks_every_document(spark, tmp_path):
    docs = [(1, "All rights reserved"), (300, "RIGHTS, copyrights"), (987_654, "no match"), (None, "Rights")]
    got = rows(spark, tmp_path, "fts_highlight", documents=("doc_id long, text string", docs))
    assert sorted(got, key=str) == sorted([(1, "All [rights] reserved"), (300, "[RIGHTS], copyrights"), (987_654, "no match"), (None, "[Rights]")], key=str)


def test_rank_is_over_all_orders(spark, tmp_path):
    orders = [(k, k, float(k)) for k in range(1, 201)] + [(201, 7, 200.0)]
    got = rows(spark, tmp_path, "win_outer_order", orders=("o_orderkey long, o_custkey long, o_totalprice double", orders))
    assert got == [(200, 1), (201, 2)] + [(200 - k, k + 2) for k in range(1, 9)]


def test_using_joins_whole_tables(spark, tmp_path):
    customers = [(1, "a", 5), (100, "b", 5), (70_000, "c", 6), (70_001, "d", None)]
    suppliers = [(2, "x", 5), (40, "y", 5), (9_000, "z", 6), (9_001, "u", None)]
    got = rows(spark, tmp_path, "join_using", customer=("c_custkey long, c_name string, c_nationkey int", customers), supplier=("s_suppkey long, s_name string, s_nationkey int", suppliers))
    assert sorted(got) == [(5, "a", "x"), (5, "a", "y"), (5, "b", "x"), (5, "b", "y"), (6, "c", "z")]


CUSTOMERS = ("c_custkey long, c_name string", [(1, "a"), (60, "b"), (500, "c"), (70_000, "d"), (None, "e")])


def test_full_join_keeps_both_sides(spark, tmp_path):
    got = rows(spark, tmp_path, "join_full", customer=CUSTOMERS, supplier=("s_suppkey long, s_acctbal double", [(60, 1.0), (70_000, 1.0), (2, 1.0), (500, -1.0)]))
    assert sorted(got, key=str) == sorted([(60, 60), (70_000, 70_000), (2, None), (None, 1), (None, 500), (None, None)], key=str)


def test_left_join_keeps_every_customer(spark, tmp_path):
    orders = [(10, 70_000, 300_000.0), (11, 70_000, 250_001.0), (12, 500, 250_000.0), (13, 1, 260_000.0), (14, None, 260_000.0)]
    got = rows(spark, tmp_path, "join_left", customer=CUSTOMERS, orders=("o_orderkey long, o_custkey long, o_totalprice double", orders))
    assert sorted(got, key=str) == sorted([(1, 13), (60, None), (500, None), (70_000, 10), (70_000, 11), (None, None)], key=str)


def test_rounding_keeps_ties(spark, tmp_path):
    prices = [0.05, 0.25, 1.15, 2.5, 1234.35, 499_999.95, -0.25, -2.5, 1.24, None]
    got = rows(spark, tmp_path, "fn_round", orders=("o_orderkey long, o_totalprice double", list(enumerate(prices))))
    tenths, whole = [0.1, 0.3, 1.2, 2.5, 1234.4, 500_000.0, -0.3, -2.5, 1.2, None], [0.0, 0.0, 1.0, 3.0, 1234.0, 500_000.0, 0.0, -3.0, 1.0, None]
    assert sorted(got) == list(zip(range(10), tenths, whole))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(con.sql(plans.oracle_sql()["fn_round"]).fetchall()) == sorted(got)


def test_dates_of_any_year_equal_duckdb(spark, tmp_path):
    days = [0, 2_932_896, 2_932_897, 6_000_000, 100_000_000, -719_528, -719_529, -800_000, None]
    got = rows(spark, tmp_path, "fn_from_unixepoch", events=("event_id long", [(d,) for d in days]))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(con.sql(plans.oracle_sql()["fn_from_unixepoch"]).fetchall(), key=str)
    assert dict(got)[2_932_897] == "10000-01-01 00:00:00"


@pytest.mark.parametrize("lines", [[(3, 0.06), (5, 0.05)], [(3, 0.06), (None, 0.06)], [(3, 0.05), (None, None)], [(None, 0.05), (1, 0.06), (1, 0.07)]])
def test_not_in_follows_sql_without_a_broadcast(spark, tmp_path, lines):
    got = rows(spark, tmp_path, "anti_not_in", part=("p_partkey long", [(1,), (3,), (None,)]), lineitem=("l_partkey long, l_discount double", lines))
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(con.sql(plans.oracle_sql()["anti_not_in"]).fetchall(), key=str)
    # the table of the subquery is never sent whole: with broadcasts off, Spark still broadcasts for NOT IN
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plans.queries()["anti_not_in"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in plan


def test_few_keys_join_cuts_large_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(relational, "PART", 7)
    monkeypatch.setattr(relational, "TASK_PAIRS", 100)
    customers = [(i, f"c{i % 90}", 5 if i % 3 else 6) for i in range(120)] + [(200, "n", None), (201, "alone", 7), (202, None, 8)]
    suppliers = [(i, f"s{i % 40}", 5 if i % 5 else 6) for i in range(50)] + [(60, "n", None), (61, "none", 9), (62, "eight", 8)]
    got = rows(spark, tmp_path, "join_using", customer=("c_custkey long, c_name string, c_nationkey int", customers), supplier=("s_suppkey long, s_name string, s_nationkey int", suppliers))
    want = [(k, c, s) for _, c, k in customers for _, s, n in suppliers if k is not None and k == n]
    assert sorted(got, key=str) == sorted(want, key=str)
    found = plans.queries()["join_using"](spark, str(tmp_path))
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 8 and max(sizes) < len(want) / 3  # by the key alone, one task makes more than half
