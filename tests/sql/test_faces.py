"""The shell, the DB-API and windows over events."""

import io

import pytest
from pyspark.sql import functions as F

from thornmill import dbapi
from thornmill.cli import Shell
from thornmill.session import Engine
from thornmill.sources.tables import elements, generate_series
from thornmill.streaming import sessions, tumbling


def test_shell(spark):
    out = io.StringIO()
    Shell(Engine(spark), out).run(["CREATE TABLE t (a INT, b TEXT);\n", "INSERT INTO t VALUES (1, 'x'),\n", "(2, NULL);\n", ".headers on\n", ".mode csv\n", "SELECT * FROM t ORDER BY a;\n", ".tables\n", "SELECT nope FROM t;\n", ".quit\n", "SELECT 9;\n"])
    lines = out.getvalue().splitlines()
    assert lines[:4] == ["a,b", "1,x", "2,", "t"] and lines[4].startswith("Error:") and len(lines) == 5


def test_dbapi(spark):
    con = dbapi.connect(spark)
    con.execute("CREATE TABLE t (a INT)")
    with con:
        con.cursor().executemany("INSERT INTO t VALUES (?)", [(1,), (2,)])
    with pytest.raises(ZeroDivisionError), con:
        con.execute("DELETE FROM t")
        1 / 0
    cursor = con.execute("SELECT a FROM t ORDER BY a")
    assert cursor.description[0][0] == "a" and cursor.fetchone() == (1,) and cursor.fetchall() == [(2,)]


def test_table_functions(spark):
    assert [r.value for r in generate_series(spark, 5, -5, -5).collect()] == [5, 0, -5]
    assert [e[6] for e in elements('{"a":[1,{"b":null}]}', deep=True)] == ["$", "$.a", "$.a[0]", "$.a[1]", "$.a[1].b"]
    assert [e[:3] for e in elements("[true, 2.5]", deep=False)] == [("0", "1", "true"), ("1", "2.5", "real")]
    assert list(elements("no json", True)) == list(elements(None, True)) == []


def test_windows_of_events(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "u"), ("2024-01-01 00:04:00", "u"), ("2024-01-01 00:31:00", "u")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in tumbling(rows, "ts", "5 minutes", ["k"]).collect()) == [1, 2]
    assert sorted(r.n for r in sessions(rows, "ts", "10 minutes", ["k"]).collect()) == [1, 2]
    rows.write.parquet(str(tmp_path / "in"))
    stream = tumbling(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "5 minutes", ["k"])
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n for r in spark.table("windows").collect()) == [1, 2]
