"""The engine end to end on small tables."""

import pytest

from thornmill.errors import ConstraintError, EngineError, TransactionError
from thornmill.session import Engine


@pytest.fixture
def db(spark):
    return Engine(spark)


def rows(db, sql, params=None):
    return [tuple(r) for r in db.execute(sql, params).collect()]


def test_insert_defaults_generated_and_keys(db):
    db.execute("CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT DEFAULT 'd', c INT CHECK (c < 100), v INT GENERATED ALWAYS AS (c * 2) VIRTUAL, s INT AS (c + 1) STORED)")
    assert rows(db, "INSERT INTO t (c) VALUES (5), (6) RETURNING *") == [(1, "d", 5, 10, 6), (2, "d", 6, 12, 7)]
    for bad in ("INSERT INTO t (a, c) VALUES (1, 1)", "INSERT INTO t (c) VALUES (100)"):
        with pytest.raises(ConstraintError):
            db.execute(bad)
    assert rows(db, "SELECT count(*) FROM t") == [(2,)]


def test_conflicts(db):
    db.execute("CREATE TABLE t (a INT PRIMARY KEY, b TEXT); INSERT INTO t VALUES (1, 'x')")
    db.execute("INSERT INTO t VALUES (1, 'y'), (2, 'z') ON CONFLICT (a) DO UPDATE SET b = excluded.b || t.b")
    assert rows(db, "SELECT * FROM t ORDER BY a") == [(1, "yx"), (2, "z")]
    db.execute("INSERT OR IGNORE INTO t VALUES (1, 'no'), (3, 'w')")
    db.execute("REPLACE INTO t VALUES (2, 'new')")
    assert rows(db, "SELECT * FROM t ORDER BY a") == [(1, "yx"), (2, "new"), (3, "w")]


def test_foreign_keys(db):
    db.execute("CREATE TABLE p (id INT PRIMARY KEY); CREATE TABLE c (pid INT REFERENCES p(id) ON DELETE CASCADE ON UPDATE CASCADE); INSERT INTO p VALUES (1), (2); INSERT INTO c VALUES (1), (2)")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO c VALUES (9)")
    db.execute("UPDATE p SET id = 20 WHERE id = 2; DELETE FROM p WHERE id = 1")
    assert rows(db, "SELECT pid FROM c") == [(20,)]
    db.execute("CREATE TABLE r (pid INT REFERENCES p(id)); INSERT INTO r VALUES (20)")
    with pytest.raises(ConstraintError):
        db.execute("DELETE FROM p")
    assert rows(db, "SELECT count(*) FROM c") == [(1,)]  # nothing of the failed statement remains


def test_transactions(db):
    db.execute("CREATE TABLE t (a INT); INSERT INTO t VALUES (1)")
    db.execute("BEGIN; DELETE FROM t; ROLLBACK")
    assert rows(db, "SELECT a FROM t") == [(1,)]
    db.execute("BEGIN; INSERT INTO t VALUES (2); SAVEPOINT s; DELETE FROM t; ROLLBACK TO s; COMMIT")
    assert rows(db, "SELECT count(*) FROM t") == [(2,)]
    with pytest.raises(TransactionError):
        db.execute("COMMIT")


def test_triggers(db):
    db.execute("CREATE TABLE t (a INT); CREATE TABLE log (a INT, m TEXT)")
    db.execute("CREATE TRIGGER g AFTER INSERT ON t WHEN NEW.a > 1 BEGIN INSERT INTO log VALUES (NEW.a, 'in'); END")
    db.execute("CREATE TRIGGER no BEFORE DELETE ON t WHEN OLD.a = 3 BEGIN SELECT RAISE(ABORT, 'kept'); END")
    db.execute("INSERT INTO t VALUES (1), (2), (3)")
    assert rows(db, "SELECT a, m FROM log ORDER BY a") == [(2, "in"), (3, "in")]
    with pytest.raises(ConstraintError, match="kept"):
        db.execute("DELETE FROM t")
    assert rows(db, "SELECT count(*) FROM t") == [(3,)]


def test_full_text(db):
    db.execute("CREATE VIRTUAL TABLE f USING fts5(title, body); INSERT INTO f VALUES ('hello world', 'apple banana'), ('goodbye world', 'banana cherry'), ('x', 'cherry date')")
    find = lambda q: sorted(r[0] for r in rows(db, f"SELECT title FROM f WHERE f MATCH '{q}'"))
    assert find("banana NOT apple") == ["goodbye world"]
    assert find("world OR date") == ["goodbye world", "hello world", "x"]
    assert find('"hello world"') == ["hello world"]
    assert find("cher*") == ["goodbye world", "x"]
    assert find("body:cherry AND title:x") == ["x"]
    assert find("NEAR(goodbye world, 1)") == ["goodbye world"]
    assert rows(db, "SELECT title FROM f WHERE f MATCH 'apple OR cherry' ORDER BY bm25(f), title LIMIT 1") == [("hello world",)]


def test_dialect(db):
    assert rows(db, "SELECT 1 / 0, 5 / 2, 1 == 1, 2 IS NOT 3, 1 IN (), 1 NOT IN (), 'abc' LIKE 'A%', 'abc' GLOB 'a?c', CAST('12x' AS INTEGER), typeof(x'00')") == [(None, 2.5, True, True, False, True, True, True, 12, "blob")]
    assert rows(db, "SELECT date('2024-01-31', '+1 day'), strftime('%Y/%m', '2024-03-05'), julianday('2024-01-01'), date('2024-01-01', 'weekday 0')") == [("2024-02-01", "2024/03", 2460310.5, "2024-01-07")]
    assert rows(db, """SELECT json_extract('{"a":{"b":42}}', '$.a.b'), json_set('{"b":1}', '$.a', 2, '$.c', 'x'), json_remove('[1,2,3]', '$[1]'), json_type('{"a":1.5}', '$.a'), '{"a":[7]}' ->> '$.a[0]'""") == [("42", '{"b":1,"a":2,"c":"x"}', "[1,3]", "real", "7")]
    assert rows(db, "SELECT ?2 - ?1", [1, 5]) == [(4,)] and rows(db, "SELECT :a + @b", {"a": 1, "b": 2}) == [(3,)]


def test_definitions(db):
    db.execute("CREATE TABLE s (a INT, b TEXT) STRICT; INSERT INTO s VALUES (1, 'x')")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO s VALUES ('abc', 'x')")
    db.execute("ALTER TABLE s ADD COLUMN z INT DEFAULT 7; ALTER TABLE s RENAME COLUMN b TO bb; CREATE UNIQUE INDEX i ON s (a)")
    assert rows(db, "SELECT * FROM s") == [(1, "x", 7)]
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO s (a) VALUES (1)")
    assert [r[1] for r in rows(db, "PRAGMA table_info(s)")] == ["a", "bb", "z"]
    assert rows(db, "PRAGMA integrity_check") == [("ok",)]
    db.execute("DROP TABLE s; DROP TABLE IF EXISTS s")
    with pytest.raises(EngineError):
        db.execute("DELETE FROM s")
