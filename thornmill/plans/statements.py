"""Statements of the dialect through the engine: what they return, or what they leave."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import asof_join
from .base import Family, load

F6 = Family()


def _engine(spark: SparkSession, sf_dir: str, tables: dict[str, tuple[str, ...]]):
    from ..session import Engine

    engine = Engine(spark)
    for t, key in tables.items():
        engine.attach(t, load(spark, sf_dir, t), key)
    return engine


def _script(name: str, tables: dict[str, tuple[str, ...]] | str, script: str, oracle: str) -> None:
    """The last statement's result; statements between !! and ; must be refused."""
    keys = {t: () for t in tables.split()} if isinstance(tables, str) else tables

    @F6.code(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..errors import EngineError

        engine, out = _engine(spark, sf_dir, keys), None
        for k, part in enumerate(script.split("!!")):
            bad, _, rest = part.partition(";") if k else ("", "", part)
            if bad:
                try:
                    engine.execute(bad)
                except EngineError:
                    pass
                else:
                    raise AssertionError(f"not refused: {bad}")
            out = engine.execute(rest) if rest.strip() else out
        return out


_N, _S = {"nation": ("n_nationkey",)}, {"supplier": ("s_suppkey",)}
_D = "CREATE VIRTUAL TABLE d USING fts5(text, source{}); INSERT INTO d SELECT text, source FROM documents; "
_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"

# --- scans, tables and definitions
_script("index_range", "orders", "CREATE INDEX i ON orders (o_orderdate); SELECT o_orderkey FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1996-07-01'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'")
_script("index_unique", "nation", "CREATE UNIQUE INDEX u ON nation (n_name); !!INSERT INTO nation SELECT 99, min(n_name), 1 FROM nation; SELECT count(*) AS n, count(DISTINCT n_name) AS names FROM nation", "SELECT count(*) AS n, count(DISTINCT n_name) AS names FROM nation")
_script("mem_table", "", "CREATE TABLE m (k INTEGER PRIMARY KEY, v TEXT); INSERT INTO m (v) VALUES ('a'), ('b'), ('c'); SELECT k, v FROM m", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, 'b'), (3, 'c')) t(k, v)")
_script("ddl_drop", "nation", "CREATE TABLE gone (a INT); DROP TABLE gone; DROP TABLE IF EXISTS gone; CREATE TABLE gone AS SELECT n_name FROM nation; SELECT n_name FROM gone", "SELECT n_name FROM nation")
_script("ddl_default_values", "", "CREATE TABLE e (k INTEGER PRIMARY KEY, a INT DEFAULT 5, b TEXT); INSERT INTO e DEFAULT VALUES; INSERT INTO e DEFAULT VALUES; SELECT k, a, b FROM e", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(5 AS BIGINT), CAST(NULL AS VARCHAR)), (2, 5, NULL)) t(k, a, b)")
_script("ddl_strict", "", "CREATE TABLE s (a INT, b TEXT) STRICT; INSERT INTO s VALUES (1, 'x'); !!INSERT INTO s VALUES ('y', 'x'); SELECT a, b FROM s", "SELECT CAST(1 AS BIGINT) AS a, 'x' AS b")
_script("ddl_without_rowid", "nation", "CREATE TABLE w (a INT, b INT, c TEXT, PRIMARY KEY (a, b)) WITHOUT ROWID; INSERT INTO w SELECT n_regionkey, n_nationkey, n_name FROM nation; !!INSERT INTO w SELECT n_regionkey, n_nationkey, 'again' FROM nation; SELECT a, b, c FROM w", "SELECT CAST(n_regionkey AS BIGINT) AS a, CAST(n_nationkey AS BIGINT) AS b, n_name AS c FROM nation")
_script("view_after_insert", _N, "CREATE VIEW v AS SELECT n_nationkey, upper(n_name) AS u FROM nation; INSERT INTO nation VALUES (70, 'mu', 1); DELETE FROM nation WHERE n_nationkey < 5; SELECT n_nationkey, u FROM v", "SELECT n_nationkey, upper(n_name) AS u FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT 70, 'MU'")
_script("rowid_alias", _S, "CREATE TABLE r (k INTEGER PRIMARY KEY, n TEXT); INSERT INTO r SELECT s_suppkey, s_name FROM supplier; SELECT rowid AS a, oid AS b, n FROM r WHERE _rowid_ % 7 = 0", "SELECT s_suppkey AS a, s_suppkey AS b, s_name AS n FROM supplier WHERE s_suppkey % 7 = 0")
_script("select_all_for_update", "nation", "SELECT ALL n_nationkey FROM nation FOR UPDATE", "SELECT n_nationkey FROM nation")
_script("join_limit", "orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 2", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 2")

# --- table functions, windows and collations in the engine's SQL
_script("sql_generate_series", "nation", "SELECT n_nationkey, value FROM nation, generate_series(1, n_regionkey) AS s UNION ALL SELECT -1, value FROM generate_series(5, 100, 5)", "SELECT n_nationkey, s.v AS value FROM nation, LATERAL (SELECT unnest(range(1, n_regionkey + 1)) AS v) s UNION ALL SELECT -1, generate_series FROM generate_series(5, 100, 5)")
_script("sql_json_each", "events", "SELECT event_id, e.key, e.value, e.type, e.fullkey FROM events, json_each(events.props) AS e", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value, 'integer' AS type, '$.k' AS fullkey FROM events")
_script("sql_json_tree", "events", "SELECT event_id, e.key, e.type, e.fullkey FROM events, json_tree(events.props) AS e", "SELECT event_id, CAST(NULL AS VARCHAR) AS key, 'object' AS type, '$' AS fullkey FROM events UNION ALL SELECT event_id, 'k', 'integer', '$.k' FROM events")
_G = "SELECT o_orderkey, CAST(count(*) OVER w AS BIGINT) AS n, round(coalesce(sum(o_totalprice) OVER w, 0), 2) AS s FROM orders WINDOW w AS (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_custkey {})"
for _name, _frame in {"sql_groups_frame": "GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING", "sql_exclude_group": "GROUPS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE GROUP", "sql_exclude_ties": "GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES"}.items():
    _script(_name, "orders", _G.format(_frame), _G.format(_frame))
_X = "SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS m FROM orders"
_script("sql_exclude_current", "orders", _X, _X)
_O = "SELECT o_orderkey, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS n FROM orders"
_script("sql_filter_over", "orders", _O, _O)
_script("sql_group_concat_over", "nation", "SELECT n_nationkey, group_concat(n_name, '-') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS names, total(n_nationkey) OVER (PARTITION BY n_regionkey) AS t FROM nation", "SELECT n_nationkey, string_agg(n_name, '-') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS names, CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey) AS DOUBLE) AS t FROM nation")
_script("sql_collate", "part", "SELECT p_partkey FROM part WHERE upper(p_name) COLLATE NOCASE = p_name AND p_brand = p_brand || '  ' COLLATE RTRIM", "SELECT p_partkey FROM part WHERE lower(upper(p_name)) = lower(p_name)")
_script("sql_distinct_aggregates", "orders", "SELECT o_orderstatus, length(group_concat(DISTINCT o_orderpriority)) AS c, total(DISTINCT o_custkey) AS t FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(length(string_agg(DISTINCT o_orderpriority, ',')) AS INTEGER) AS c, CAST(sum(DISTINCT o_custkey) AS DOUBLE) AS t FROM orders GROUP BY o_orderstatus")
_script("sql_json_array_nulls", "nation", "SELECT n_regionkey, json_array_length(json_group_array(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END)) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(count(*) AS INTEGER) AS n FROM nation GROUP BY n_regionkey")

# --- functions
_script("fn_like_glob", "part", "SELECT p_partkey, like('%A%', p_name) AS l, glob('*a*', p_name) AS g FROM part", "SELECT p_partkey, p_name ILIKE '%A%' AS l, contains(p_name, 'a') AS g FROM part")
_script("fn_changes", _S, "UPDATE supplier SET s_acctbal = 1 WHERE s_nationkey = 3; DELETE FROM supplier WHERE s_nationkey = 4; SELECT changes() AS c, total_changes() AS t", "SELECT count(*) FILTER (WHERE s_nationkey = 4) AS c, count(*) FILTER (WHERE s_nationkey IN (3, 4)) AS t FROM supplier")
_script("fn_last_insert_rowid", "nation", "CREATE TABLE r (k INTEGER PRIMARY KEY, n TEXT); INSERT INTO r (n) SELECT n_name FROM nation; SELECT last_insert_rowid() AS k", "SELECT count(*) AS k FROM nation")
_script("fn_random", "events", "SELECT count(*) AS n, count(DISTINCT r) > 0.99 * count(*) AS spread, min(typeof(r)) AS t FROM (SELECT random() AS r FROM events) x", "SELECT count(*) AS n, true AS spread, 'integer' AS t FROM events")
_script("fn_rand", "events", "SELECT count(*) AS n, min(r) >= -1 AND max(r) < 1 AS inside, min(r) < 0 AND max(r) > 0 AS signs FROM (SELECT rand() AS r FROM events) x", "SELECT count(*) AS n, true AS inside, true AS signs FROM events")
_script("json_minify", "events", "SELECT event_id, json(props) AS j FROM events", "SELECT event_id, replace(props, ' ', '') AS j FROM events")
_script("json_quote_pretty", "nation", "SELECT n_nationkey, json_quote(n_name) AS q, replace(replace(json_pretty('{\"k\":' || n_nationkey || '}'), ' ', ''), char(10), '') AS p FROM nation", "SELECT n_nationkey, '\"' || n_name || '\"' AS q, '{\"k\":' || n_nationkey || '}' AS p FROM nation")
_script("json_paths", "nation", "SELECT n_nationkey, json_extract('{\"a b\":[1,[2,{\"c\":' || n_nationkey || '}]]}', '$.\"a b\"[1][1].c') AS c, json_extract('{\"z\":[1,2,3]}', '$.z[#-1]') AS e FROM nation", "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS c, '3' AS e FROM nation")

# --- changes: repeated keys and policies
_script("dml_upsert_repeated", "", "CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT); INSERT INTO t VALUES (5, 'a'), (5, 'b'), (6, 'x'), (5, 'c') ON CONFLICT (a) DO UPDATE SET b = t.b || excluded.b; SELECT a, b FROM t", "SELECT * FROM (VALUES (CAST(5 AS BIGINT), 'abc'), (6, 'x')) t(a, b)")
_script("dml_upsert_counts", "orders", "CREATE TABLE t (a INTEGER PRIMARY KEY, p TEXT); INSERT INTO t SELECT o_custkey % 100, o_orderpriority FROM orders ORDER BY o_orderkey ON CONFLICT (a) DO UPDATE SET p = excluded.p; SELECT count(*) AS n, count(p) AS p FROM t", "SELECT count(DISTINCT o_custkey % 100) AS n, count(DISTINCT o_custkey % 100) AS p FROM orders")
_script("dml_replace_repeated", "", "CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT); REPLACE INTO t VALUES (5, 'a'), (5, 'b'), (6, 'x'), (5, 'c'); SELECT a, b FROM t", "SELECT * FROM (VALUES (CAST(5 AS BIGINT), 'c'), (6, 'x')) t(a, b)")
_script("dml_ignore_check", "supplier", "CREATE TABLE t (a INTEGER PRIMARY KEY, b REAL NOT NULL CHECK (b >= 0)); INSERT OR IGNORE INTO t SELECT s_suppkey, s_acctbal FROM supplier; SELECT a, b FROM t", "SELECT s_suppkey AS a, s_acctbal AS b FROM supplier WHERE s_acctbal >= 0")
_script("dml_nothing_not_null", "", "CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT NOT NULL); !!INSERT INTO t VALUES (1, NULL) ON CONFLICT DO NOTHING; INSERT INTO t VALUES (1, 'x'); INSERT INTO t VALUES (1, 'y') ON CONFLICT DO NOTHING; SELECT a, b FROM t", "SELECT CAST(1 AS BIGINT) AS a, 'x' AS b")
_script("dml_or_fail", "", "CREATE TABLE t (a INTEGER PRIMARY KEY); INSERT INTO t VALUES (3); !!INSERT OR FAIL INTO t VALUES (1), (2), (3), (4); !!INSERT OR ABORT INTO t VALUES (5), (3); SELECT a FROM t", "SELECT * FROM (VALUES (CAST(1 AS BIGINT)), (2), (3)) t(a)")
_script("dml_or_rollback", "", "CREATE TABLE t (a INTEGER PRIMARY KEY); INSERT INTO t VALUES (3); BEGIN; INSERT INTO t VALUES (4); !!INSERT OR ROLLBACK INTO t VALUES (5), (3); SELECT a FROM t", "SELECT CAST(3 AS BIGINT) AS a")
_script("dml_update_or_ignore", _S, "UPDATE OR IGNORE supplier SET s_suppkey = s_suppkey + 1 WHERE s_suppkey % 2 = 1; SELECT s_suppkey, s_name FROM supplier", "SELECT CASE WHEN s_suppkey % 2 = 1 AND s_suppkey + 1 NOT IN (SELECT s_suppkey FROM supplier) THEN s_suppkey + 1 ELSE s_suppkey END AS s_suppkey, s_name FROM supplier")
_script("fk_deferred", _N, "CREATE TABLE p (id INT PRIMARY KEY); CREATE TABLE c (pid INT REFERENCES p(id) DEFERRABLE INITIALLY DEFERRED); BEGIN; INSERT INTO c SELECT n_nationkey FROM nation; INSERT INTO p SELECT n_nationkey FROM nation; COMMIT; BEGIN; INSERT INTO c VALUES (-1); !!COMMIT; ROLLBACK; SELECT pid FROM c", "SELECT CAST(n_nationkey AS BIGINT) AS pid FROM nation")
_script("trigger_instead_of_update", _N, "CREATE VIEW v AS SELECT n_nationkey AS k, n_name AS n FROM nation; CREATE TRIGGER g INSTEAD OF UPDATE ON v BEGIN UPDATE nation SET n_name = NEW.n || '/' || OLD.n WHERE n_nationkey = OLD.k; END; UPDATE v SET n = lower(n) WHERE k > 9; SELECT n_nationkey, n_name FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey > 9 THEN lower(n_name) || '/' || n_name ELSE n_name END AS n_name FROM nation")
_script("trigger_updates_at_once", {**_S, **_N}, "CREATE TABLE log (k INT, n INT); INSERT INTO log SELECT n_nationkey, 0 FROM nation; CREATE TRIGGER g AFTER DELETE ON nation BEGIN UPDATE log SET n = OLD.n_regionkey + 1 WHERE k = OLD.n_nationkey; END; DELETE FROM nation WHERE n_nationkey > 4; SELECT k, n FROM log", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(CASE WHEN n_nationkey > 4 THEN n_regionkey + 1 ELSE 0 END AS BIGINT) AS n FROM nation")
_script("trigger_raise", _S, "CREATE TRIGGER g BEFORE INSERT ON supplier WHEN NEW.s_acctbal < 0 BEGIN SELECT RAISE(ABORT, 'no debts'); END; !!INSERT INTO supplier VALUES (-1, 'x', 1, -5.0); INSERT INTO supplier VALUES (-2, 'y', 1, 5.0); SELECT s_suppkey FROM supplier WHERE s_suppkey < 0", "SELECT CAST(-2 AS BIGINT) AS s_suppkey")

# --- pragmas and the like
_script("pragma_settings", "", "PRAGMA user_version = 7; PRAGMA user_version", "SELECT CAST(7 AS BIGINT) AS user_version")
_script("pragma_collations", "", "PRAGMA collation_list", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'BINARY'), (1, 'NOCASE'), (2, 'RTRIM')) t(seq, name)")
_script("pragma_integrity", _N, "PRAGMA integrity_check", "SELECT 'ok' AS integrity_check")
_script("pragma_foreign_keys", _N, "CREATE TABLE c (pid INT REFERENCES nation (n_nationkey) ON DELETE CASCADE); PRAGMA foreign_key_list(c)", "SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS seq, 'nation' AS \"table\", 'pid' AS \"from\", 'n_nationkey' AS \"to\", 'NO ACTION' AS on_update, 'CASCADE' AS on_delete")
_script("pragma_indexes", "nation", "CREATE UNIQUE INDEX u ON nation (n_name); PRAGMA index_info(u)", "SELECT CAST(0 AS BIGINT) AS seqno, CAST(1 AS BIGINT) AS cid, 'n_name' AS name")
_script("maintenance", _N, "ANALYZE; REINDEX; VACUUM; SELECT n_nationkey, n_name FROM nation", "SELECT n_nationkey, n_name FROM nation")


@F6.code("explain_plan", "SELECT true AS scans, true AS pushed")
def _explain(spark, sf_dir):
    plan = _engine(spark, sf_dir, {"orders": ()}).execute("EXPLAIN QUERY PLAN SELECT o_orderkey FROM orders WHERE o_custkey = 5")
    return plan.select(F.contains("plan", F.lit("Scan parquet")).alias("scans"), F.contains("plan", F.lit("EqualTo(o_custkey,5)")).alias("pushed"))


# --- full text through MATCH
def _found(name: str, query: str, oracle: str, options: str = "") -> None:
    _script(name, "documents", _D.format(options) + f"SELECT text, source FROM d WHERE d MATCH '{query}'", f"SELECT text, source FROM (SELECT text, source, {_W} AS w FROM documents) WHERE {oracle}")


_found("match_phrase", 'text : "all rights reserved"', "contains(' ' || array_to_string(w, ' ') || ' ', ' all rights reserved ')")
_found("match_expression", "text : (licensed OR rights) NOT text : version".replace("text : (licensed OR rights)", "(text : licensed OR text : rights)"), "(list_contains(w, 'licensed') OR list_contains(w, 'rights')) AND NOT list_contains(w, 'version')")
_found("match_ascii", "text : license", "list_contains(regexp_extract_all(lower(text), '[a-z0-9_]+'), 'license')", ", tokenize='ascii'")
_found("match_trigram", "text : ghts", "contains(lower(text), 'ghts')", ", tokenize='trigram'")
_script("fts_select", "documents", _D.format("") + "SELECT count(*) AS n, count(DISTINCT docid) AS ids FROM d", "SELECT count(*) AS n, count(*) AS ids FROM documents")
_script("fts_change", "documents", _D.format("") + "DELETE FROM d WHERE source = 'src1'; UPDATE d SET text = 'zebra ' || source WHERE source = 'src2'; SELECT source FROM d WHERE d MATCH 'zebra'", "SELECT source FROM documents WHERE source = 'src2'")
_script("fts_porter", "nation", "CREATE VIRTUAL TABLE d USING fts5(t, tokenize='porter'); INSERT INTO d SELECT n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' running dogs' ELSE ' sleeping dog' END FROM nation; SELECT t FROM d WHERE d MATCH 'runs'", "SELECT n_name || ' running dogs' AS t FROM nation WHERE n_nationkey % 2 = 0")
_script("fts_marks", "nation", "CREATE VIRTUAL TABLE d USING fts5(t, u); INSERT INTO d SELECT 'the ' || lower(n_name) || ' fox', 'x' FROM nation; SELECT highlight(d, 0, '<', '>') AS h, snippet(d, 0, '[', ']', '..', 1) AS s FROM d WHERE d MATCH 'fox' AND bm25(d, 2.0, 1.0) < 0", "SELECT 'the ' || lower(n_name) || ' <fox>' AS h, '..[fox]' AS s FROM nation")


# --- faces and files
@F6.code("udf_collation", "SELECT n_name, CAST(row_number() OVER (ORDER BY reverse(n_name)) AS BIGINT) AS at FROM nation")
def _collation(spark, sf_dir):
    engine = _engine(spark, sf_dir, {"nation": ()})
    engine.create_collation("backwards", lambda s: s[::-1])
    return engine.execute("SELECT n_name, CAST(row_number() OVER (ORDER BY n_name COLLATE backwards) AS BIGINT) AS at FROM nation")


@F6.code("udaf_merged", "SELECT l_returnflag, round(sum(l_quantity * l_quantity), 2) AS s FROM lineitem GROUP BY l_returnflag")
def _merged(spark, sf_dir):
    """A Python aggregate with merge(): parts are added up before they meet."""
    from ..operators.aggregates import merged_aggregate
    from .scalar import SumOfSquares

    class Merging(SumOfSquares):
        def merge(self, other) -> None:
            self.total += other.total

    rows = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    return merged_aggregate(rows, ["l_returnflag"], ["l_quantity"], Merging, "s", "double").select("l_returnflag", F.round("s", 2).alias("s"))


@F6.code("save_attach", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def _saved(spark, sf_dir):
    from ..session import shared_folder

    engine = _engine(spark, sf_dir, {"nation": (), "region": ()})
    engine.save(path := shared_folder(spark))
    other = _engine(spark, sf_dir, {})
    other.execute(f"ATTACH DATABASE '{path}' AS old")
    return other.execute("SELECT a.n_nationkey, a.n_name, old.region.r_name FROM old.nation AS a JOIN old.region ON old.region.r_regionkey = a.n_regionkey")


@F6.code("sink_modes", "SELECT n_nationkey || ',' || n_name AS line FROM nation UNION ALL SELECT 'INSERT INTO x VALUES(' || n_nationkey || ',''' || n_name || ''');' FROM nation")
def _sinks(spark, sf_dir):
    from ..sources.sinks import lines

    rows = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    text = [x for mode in ("csv", "insert") for x in lines(rows.columns, rows.toLocalIterator(), mode, table="x")]
    return spark.createDataFrame([(x,) for x in text], "line string")


@F6.code("shell_commands", "SELECT n_nationkey || '|' || n_name AS line FROM nation UNION ALL VALUES ('nation'), ('main: ')")
def _shell(spark, sf_dir):
    from ..cli import Shell

    shell = Shell(_engine(spark, sf_dir, {"nation": ()}), io.StringIO())
    shell.run([".tables", ".databases", ".mode list", "SELECT n_nationkey, n_name\n", "FROM nation;"])
    return spark.createDataFrame([(x,) for x in shell.out.getvalue().splitlines()], "line string")


@F6.code("dbapi_cursor", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 500, 'added'")
def _dbapi(spark, sf_dir):
    from ..dbapi import Connection

    con = Connection(_engine(spark, sf_dir, {"nation": ("n_nationkey",)}))
    con.cursor().executemany("INSERT INTO nation VALUES (?, ?, ?)", [(500, "added", 2), (501, "elsewhere", 3)])
    rows = con.execute("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = ?", (2,)).fetchall()
    return spark.createDataFrame(rows, "n_nationkey int, n_name string")


@F6.code("error_codes", "SELECT 'ConstraintError' AS kind, 19 AS code UNION ALL SELECT 'SyntaxProblem', 1 UNION ALL SELECT 'TransactionError', 1")
def _errors(spark, sf_dir):
    from ..errors import EngineError

    engine, found = _engine(spark, sf_dir, {"nation": ("n_nationkey",)}), []
    for bad in ("INSERT INTO nation VALUES (1, 'x', 1)", "NONSENSE", "COMMIT"):
        try:
            engine.execute(bad)
        except EngineError as e:
            found.append((type(e).__name__, e.code))
    return spark.createDataFrame(found, "kind string, code int")


@F6.code("join_asof", "SELECT e.event_id, p.event_id AS earlier FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def _asof(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("earlier"))
    return asof_join(events.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "at", ["earlier"]).select("event_id", "earlier")
