"""A thin DB-API 2.0 face of the engine."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from .errors import ConstraintError, EngineError
from .session import Engine

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"
Error = DatabaseError = EngineError
IntegrityError = ConstraintError


class Cursor:
    def __init__(self, connection: Connection) -> None:
        self.connection, self.description, self.rowcount, self._rows = connection, None, -1, iter(())

    def execute(self, sql: str, params=None) -> Cursor:
        result = self.connection.engine.execute(sql, params)
        self.rowcount = self.connection.engine.changed if result is None else -1
        self.description = None if result is None else [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in result.schema]
        self._rows = iter(()) if result is None else (self.connection.row_factory(self, tuple(r)) for r in result.toLocalIterator())
        return self

    def executemany(self, sql: str, many: Iterable) -> Cursor:
        for params in many:
            self.execute(sql, params)
        return self

    def fetchone(self):
        return next(self._rows, None)

    def fetchmany(self, size: int = 1) -> list:
        return [r for r, _ in zip(self._rows, range(size), strict=False)]

    def fetchall(self) -> list:
        return list(self._rows)

    def __iter__(self) -> Iterator:
        return self._rows

    def close(self) -> None:
        self._rows = iter(())


class Connection:
    """Commits when its block ends well, rolls back otherwise."""

    def __init__(self, engine: Engine) -> None:
        self.engine, self.row_factory = engine, lambda cursor, row: row

    def cursor(self) -> Cursor:
        return Cursor(self)

    def execute(self, sql: str, params=None) -> Cursor:
        return self.cursor().execute(sql, params)

    def commit(self) -> None:
        if self.engine.saved:
            self.engine.execute("COMMIT")

    def rollback(self) -> None:
        if self.engine.saved:
            self.engine.execute("ROLLBACK")

    def close(self) -> None:
        self.rollback()
        self.engine.close()

    def __enter__(self) -> Connection:
        if not self.engine.saved:
            self.engine.execute("BEGIN")
        return self

    def __exit__(self, kind, value, trace) -> None:
        self.rollback() if kind else self.commit()


def connect(spark: SparkSession | None = None) -> Connection:
    return Connection(Engine(spark or SparkSession.builder.getOrCreate()))
