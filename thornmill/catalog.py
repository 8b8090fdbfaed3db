"""What the engine knows of its tables: immutable descriptions beside immutable DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Column:
    name: str
    declared: str = ""
    kind: str = "string"  # Spark's type
    not_null: bool = False
    default: str | None = None  # SQL text in Spark's spelling
    generated: str | None = None
    stored: bool = False
    collation: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    targets: tuple[str, ...]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"
    deferred: bool = False


@dataclass(frozen=True)
class Table:
    name: str
    df: DataFrame
    columns: tuple[Column, ...]
    key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: tuple[str, ...] = ()
    foreign: tuple[ForeignKey, ...] = ()
    strict: bool = False
    without_rowid: bool = False
    fulltext: str | None = None  # the tokenizer
    sql: str = ""
    writes: int = 0  # since the rows were last written out
    settled: bool = False  # the rows are read from files of our own

    @property
    def stored(self) -> list[Column]:
        return [c for c in self.columns if not c.generated or c.stored]

    @property
    def integer_key(self) -> str | None:
        """The column that numbers rows, if the key is one INTEGER column."""
        return self.key[0] if len(self.key) == 1 and self.column(self.key[0]).kind == "bigint" and not self.without_rowid else None

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name.lower() == name.lower())

    def keys(self) -> list[tuple[str, ...]]:
        return [k for k in (self.key, *self.unique) if k]

    def with_rows(self, df: DataFrame) -> Table:
        return replace(self, df=df, writes=self.writes + 1, settled=False)


@dataclass(frozen=True)
class Trigger:
    name: str
    table: str
    time: str
    event: str
    columns: tuple[str, ...]
    when: tuple | None
    body: tuple


@dataclass(frozen=True)
class Index:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool
    where: str | None = None


@dataclass
class Snapshot:
    """Everything a transaction may change; copied when one begins."""

    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    triggers: dict[str, Trigger] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)

    def copy(self) -> Snapshot:
        return Snapshot(dict(self.tables), dict(self.views), dict(self.triggers), dict(self.indexes))
