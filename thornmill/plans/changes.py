"""Statements that change data, each ending in the table that it leaves; the SQL computes that table directly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .base import Family, load

F5 = Family()


def _script(name: str, tables: dict[str, tuple[str, ...]], script: str, oracle: str) -> None:
    """Run a script on tables (with their keys) and return the last statement's result."""

    @F5.code(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..session import Engine

        engine = Engine(spark)
        for t, key in tables.items():
            engine.attach(t, load(spark, sf_dir, t), key)
        return engine.execute(script)


_S, _N, _C = {"supplier": ("s_suppkey",)}, {"nation": ("n_nationkey",)}, {"customer": ("c_custkey",)}

_script("dml_insert_values", _N, "INSERT INTO nation VALUES (90, 'ATLANTIS', 1), (91, 'LEMURIA', 2); SELECT n_nationkey, n_name, n_regionkey FROM nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL VALUES (90, 'ATLANTIS', 1), (91, 'LEMURIA', 2)")
_script("dml_insert_columns", _N, "INSERT INTO nation (n_name, n_nationkey) VALUES ('NOWHERE', 99); SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey > 20", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey > 20 UNION ALL SELECT 99, 'NOWHERE', NULL")
_script("dml_insert_select", _S, "INSERT INTO supplier SELECT s_suppkey + 100000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 5000; SELECT * FROM supplier", "SELECT * FROM supplier UNION ALL SELECT s_suppkey + 100000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 5000")
_script("dml_update", _S, "UPDATE supplier SET s_acctbal = s_acctbal + 1, s_name = lower(s_name) WHERE s_nationkey < 10; SELECT * FROM supplier", "SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN lower(s_name) ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_nationkey < 10 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier")
_script("dml_update_from", {**_S, **_N}, "UPDATE supplier SET s_name = n.n_name FROM nation n WHERE n.n_nationkey = supplier.s_nationkey AND n.n_regionkey = 1; SELECT s_suppkey, s_name FROM supplier", "SELECT s.s_suppkey, CASE WHEN n.n_regionkey = 1 THEN n.n_name ELSE s.s_name END AS s_name FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey")
_script("dml_delete", _C, "DELETE FROM customer WHERE c_acctbal < 0 OR c_mktsegment LIKE 'b%'; SELECT c_custkey FROM customer", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment ILIKE 'b%')")
_script("dml_delete_limit", _S, "DELETE FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 3; SELECT s_suppkey FROM supplier", "SELECT s_suppkey FROM supplier EXCEPT ALL (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 3)")
_script("dml_delete_in", {**_S, **_N}, "DELETE FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3); SELECT s_suppkey FROM supplier", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)")
_script("dml_upsert_update", _N, "INSERT INTO nation VALUES (1, 'X', 4), (77, 'Y', 4) ON CONFLICT (n_nationkey) DO UPDATE SET n_name = n_name || '+' || excluded.n_name; SELECT n_nationkey, n_name, n_regionkey FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN n_name || '+X' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 77, 'Y', 4")
_script("dml_upsert_nothing", _N, "INSERT INTO nation VALUES (1, 'X', 4), (78, 'Y', 4) ON CONFLICT DO NOTHING; SELECT n_nationkey, n_name, n_regionkey FROM nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 78, 'Y', 4")
_script("dml_insert_or_ignore", _N, "INSERT OR IGNORE INTO nation VALUES (2, 'X', 4), (79, 'Y', 4); SELECT n_nationkey, n_name FROM nation", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 79, 'Y'")
_script("dml_insert_or_replace", _N, "INSERT OR REPLACE INTO nation VALUES (2, 'X', 4), (79, 'Y', 4); SELECT n_nationkey, n_name, n_regionkey FROM nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey <> 2 UNION ALL VALUES (2, 'X', 4), (79, 'Y', 4)")
_script("dml_returning", _S, "UPDATE supplier SET s_acctbal = 0 WHERE s_suppkey <= 5 RETURNING s_suppkey, s_acctbal * 2 + 1 AS one", "SELECT s_suppkey, CAST(1 AS DOUBLE) AS one FROM supplier WHERE s_suppkey <= 5")
_script("gen_col_stored", _N, "CREATE TABLE g (a INT, b INT GENERATED ALWAYS AS (a * 2) VIRTUAL, c INT GENERATED ALWAYS AS (a + 1) STORED); INSERT INTO g (a) SELECT n_nationkey FROM nation; SELECT a, b, c FROM g", "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey * 2 AS BIGINT) AS b, CAST(n_nationkey + 1 AS BIGINT) AS c FROM nation")
_FK = "CREATE TABLE p (id INT PRIMARY KEY); INSERT INTO p SELECT n_nationkey FROM nation; CREATE TABLE c (id INT, pid INT {} REFERENCES p(id) {}); INSERT INTO c SELECT s_suppkey, s_nationkey FROM supplier; {}; SELECT id, pid FROM c"
_I = "CAST(s_suppkey AS BIGINT) AS id, "
_script("fk_cascade", {**_S, **_N}, _FK.format("", "ON DELETE CASCADE", "DELETE FROM p WHERE id < 5"), f"SELECT {_I} CAST(s_nationkey AS BIGINT) AS pid FROM supplier WHERE s_nationkey >= 5")
_script("fk_set_null", {**_S, **_N}, _FK.format("", "ON DELETE SET NULL", "DELETE FROM p WHERE id < 5"), f"SELECT {_I} CAST(CASE WHEN s_nationkey >= 5 THEN s_nationkey END AS BIGINT) AS pid FROM supplier")
_script("fk_set_default", {**_S, **_N}, _FK.format("DEFAULT 9", "ON DELETE SET DEFAULT", "DELETE FROM p WHERE id < 5"), f"SELECT {_I} CAST(CASE WHEN s_nationkey >= 5 THEN s_nationkey ELSE 9 END AS BIGINT) AS pid FROM supplier")
_script("fk_update_cascade", {**_S, **_N}, _FK.format("", "ON UPDATE CASCADE", "UPDATE p SET id = id + 100 WHERE id < 5"), f"SELECT {_I} CAST(CASE WHEN s_nationkey < 5 THEN s_nationkey + 100 ELSE s_nationkey END AS BIGINT) AS pid FROM supplier")
_script("txn_rollback", _S, "BEGIN; DELETE FROM supplier; INSERT INTO supplier VALUES (1, 'x', 1, 1.0); ROLLBACK; SELECT s_suppkey FROM supplier", "SELECT s_suppkey FROM supplier")
_script("txn_savepoint", _S, "BEGIN; DELETE FROM supplier WHERE s_suppkey > 50; SAVEPOINT a; DELETE FROM supplier; ROLLBACK TO a; COMMIT; SELECT s_suppkey FROM supplier", "SELECT s_suppkey FROM supplier WHERE s_suppkey <= 50")
_script("trigger_after_insert", _N, "CREATE TABLE log (k INT, name TEXT); CREATE TRIGGER t AFTER INSERT ON nation WHEN NEW.n_regionkey = 2 BEGIN INSERT INTO log VALUES (NEW.n_nationkey, NEW.n_name || '!'); END; INSERT INTO nation SELECT n_nationkey + 500, n_name, n_regionkey FROM nation; SELECT k, name FROM log", "SELECT CAST(n_nationkey + 500 AS BIGINT) AS k, n_name || '!' AS name FROM nation WHERE n_regionkey = 2")
_script("trigger_instead_of", _N, "CREATE VIEW v AS SELECT n_nationkey, n_name FROM nation; CREATE TRIGGER t INSTEAD OF INSERT ON v BEGIN INSERT INTO nation VALUES (NEW.n_nationkey, NEW.n_name, 4); END; INSERT INTO v VALUES (300, 'SEEN'); SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey >= 20", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT 300, 'SEEN', 4")
_script("ddl_alter", _N, "ALTER TABLE nation ADD COLUMN pop INT DEFAULT 7; ALTER TABLE nation RENAME COLUMN n_name TO title; ALTER TABLE nation DROP COLUMN n_regionkey; SELECT * FROM nation", "SELECT n_nationkey, n_name AS title, CAST(7 AS BIGINT) AS pop FROM nation")
_script("ddl_create_as", _C, "CREATE TABLE rich AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000; SELECT * FROM rich", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000")
_script("cte_delete", _S, "WITH poor AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal < 0) DELETE FROM supplier WHERE s_suppkey IN (SELECT k FROM poor); SELECT s_suppkey FROM supplier", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0")
_script("pragma_table_info", {}, "CREATE TABLE t (a INT PRIMARY KEY, b TEXT NOT NULL DEFAULT 'x'); PRAGMA table_info(t)", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'a', 'INT', CAST(0 AS BIGINT), NULL, CAST(1 AS BIGINT)), (1, 'b', 'TEXT', 1, '''x''', 0)) AS t(cid, name, type, \"notnull\", dflt_value, pk)")
_script("dialect_mix", {"events": ()}, "SELECT event_id, typeof(value) AS t, props ->> '$.k' AS k, event_type GLOB 'c*' AS g, value IS NOT 5 AS n, ifnull(NULL, 3) AS i, CAST('12ab' AS INTEGER) AS c FROM events WHERE event_type REGEXP '^[cpv]' AND user_id NOTNULL", "SELECT event_id, 'real' AS t, json_extract_string(props, '$.k') AS k, starts_with(event_type, 'c') AS g, value IS DISTINCT FROM 5 AS n, 3 AS i, CAST(12 AS BIGINT) AS c FROM events WHERE regexp_matches(event_type, '^[cpv]') AND user_id IS NOT NULL")
