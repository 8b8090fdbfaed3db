"""What the engine's statements leave, beyond what the registered queries compare."""

import io

import pytest

from thornmill.cli import Shell
from thornmill.dialect import tokenize
from thornmill.errors import ConstraintError, EngineError, SyntaxProblem
from thornmill.frames import rewrite_windows
from thornmill.operators.relational import asof_join
from thornmill.operators.stemming import stem
from thornmill.session import Engine
from thornmill.sources.sinks import lines, render

T = "CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT); "


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_inserted_rows_are_numbered_part_by_part(spark):
    engine = Engine(spark)
    engine.attach("src", spark.range(1_000).repartition(7).withColumnRenamed("id", "x"))
    engine.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, x INT); INSERT INTO t (x) SELECT x FROM src; INSERT INTO t (k, x) SELECT CASE WHEN x = 5 THEN 5000 END, x FROM src")
    keys = [r.k for r in engine.execute("SELECT k FROM t").collect()]
    assert len(set(keys)) == 2_000 and set(range(1, 1_001)) <= set(keys) and 5_000 in keys
    plan = engine.table("t").df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_a_later_row_of_the_same_key_meets_what_the_earlier_left(spark):
    engine = Engine(spark)
    got = engine.execute(T + "INSERT INTO t VALUES (1, 'x'); INSERT INTO t VALUES (1, 'a'), (2, 'b'), (1, 'c'), (2, 'd') ON CONFLICT (a) DO UPDATE SET b = b || excluded.b WHERE excluded.b <> 'd'; SELECT * FROM t")
    assert rows(got) == [(1, "xac"), (2, "b")]


def test_unique_keys_are_checked_against_old_and_new_rows(spark):
    engine = Engine(spark)
    engine.execute(T + "INSERT INTO t VALUES (1, 'x'), (2, 'y')")
    for bad in ("INSERT INTO t VALUES (2, 'z')", "INSERT INTO t VALUES (7, 'a'), (7, 'b')", "UPDATE t SET a = 2 WHERE a = 1", "UPDATE t SET a = 9"):
        with pytest.raises(ConstraintError):
            engine.execute(bad)
    assert rows(engine.execute("UPDATE t SET a = a + 1; SELECT * FROM t")) == [(2, "x"), (3, "y")]


def test_a_trigger_that_meets_a_row_twice_runs_row_by_row(spark):
    engine = Engine(spark)
    engine.execute(T + "CREATE TABLE n (v INT); INSERT INTO n VALUES (0); CREATE TRIGGER g AFTER INSERT ON t BEGIN UPDATE n SET v = v + NEW.a; END; INSERT INTO t VALUES (1, 'x'), (2, 'y'), (4, 'z')")
    assert rows(engine.execute("SELECT v FROM n")) == [(7,)]


def test_views_follow_their_tables(spark):
    engine = Engine(spark)
    engine.execute(T + "CREATE VIEW v AS SELECT count(*) AS n FROM t; CREATE VIEW w AS SELECT n + 1 AS m FROM v; INSERT INTO t VALUES (1, 'x'), (2, 'y')")
    assert rows(engine.execute("SELECT m FROM w")) == [(3,)]
    engine.execute("BEGIN; DELETE FROM t; ROLLBACK; DELETE FROM t WHERE a = 1")
    assert rows(engine.execute("SELECT m FROM w")) == [(2,)]


def test_a_change_of_a_table_that_is_computed_anew_reads_it_once(spark):
    engine = Engine(spark)
    engine.attach("r", spark.range(500).selectExpr("id", "rand() AS x").repartition(3))
    engine.execute("DELETE FROM r WHERE x < 0.5")
    left = engine.execute("SELECT min(x) AS low, count(*) AS n FROM r").first()
    assert left.low >= 0.5 and left.n == engine.execute("SELECT count(*) AS n FROM r").first().n


def test_databases_are_folders(spark, tmp_path):
    engine = Engine(spark)
    engine.execute(T + "INSERT INTO t VALUES (1, 'x')")
    engine.save(f"file://{tmp_path}/db")
    other = Engine(spark)
    other.execute(f"ATTACH 'file://{tmp_path}/db' AS old; CREATE TABLE t AS SELECT a + 1 AS a FROM old.t")
    assert rows(other.execute("SELECT main.t.a, o.b FROM main.t, old.t AS o")) == [(2, "x")]
    other.execute("DETACH DATABASE old")
    with pytest.raises(Exception, match="(?i)not.*found"):
        other.execute("SELECT * FROM `old.t`").collect()


def test_frames_that_cannot_be_written_are_refused():
    for sql in ("SELECT sum(a) OVER (ORDER BY b RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) FROM t", "SELECT sum(a) OVER (ORDER BY b ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) FROM t"):
        with pytest.raises(SyntaxProblem):
            rewrite_windows(tokenize(sql))
    plain = tokenize("SELECT sum(a) OVER (ORDER BY b) FROM t")
    assert rewrite_windows(plain) is plain


def test_frames_keep_the_columns_of_a_star(spark):
    engine = Engine(spark)
    engine.attach("t", spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "o int, v int"))
    got = engine.execute("SELECT *, sum(v) OVER (ORDER BY o GROUPS BETWEEN CURRENT ROW AND CURRENT ROW EXCLUDE CURRENT ROW) AS s FROM t x WHERE x.v > 0 ORDER BY v")
    assert got.columns == ["o", "v", "s"] and [tuple(r) for r in got.collect()] == [(1, 5, 6), (1, 6, 5), (2, 7, None)]


def test_asof_join_takes_the_latest_not_later(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 9), (5, "a", None)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 49), ("a", 7, 70), (None, 1, 1), ("b", None, 3)], "k string, at int, v int")
    assert rows(asof_join(left, right, ["k"], "t", "at", ["v"]).select("id", "v")) == [(1, 50), (2, None), (3, None), (4, None), (5, None)]


def test_stems():
    assert [stem(w) for w in ("caresses", "relational", "hopping", "happy", "as", "naïve", "adjustable")] == ["caress", "relat", "hop", "happi", "as", "naïve", "adjust"]


def test_shell_times_and_streams(spark):
    shell = Shell(Engine(spark), io.StringIO())
    shell.run([".timer on", ".headers on", "SELECT 1 AS a, 'x' AS b;", ".databases"])
    assert [x if "Run Time" not in x else "time" for x in shell.out.getvalue().splitlines()] == ["a|b", "1|x", "time", "main: "]
    for mode in ("list", "csv", "insert", "json", "box", "column", "markdown"):
        assert "\n".join(lines(["a"], [(1,), (None,)], mode, True)) == render(["a"], [(1,), (None,)], mode, True)


def test_errors_have_codes(spark):
    assert ConstraintError("UNIQUE", "t(a)").code == 19 and EngineError("x").code == 1
