"""The engine: statements in, DataFrames out.

Queries go to Spark after a rewriting of spellings. Statements that change data make new
DataFrames from old ones (Spark can't update Parquet tables in place), check constraints
by queries, and swap the table's entry in the catalog, so a failed statement leaves nothing
and a transaction is a copy of the catalog. After MOST_WRITES statements a table's rows are
written to the shared folder, which ends their lineage.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import Column, ForeignKey, Index, Snapshot, Table, Trigger
from .dialect import Token, name_of, rewrite, statements, tokenize
from .errors import ConstraintError, EngineError, SyntaxProblem, TransactionError
from .frames import rewrite_windows
from .functions import jsontext
from .operators import fulltext
from .sources.tables import register_elements

MOST_WRITES = 8
#: Spark's type for a declared name, by what the name holds; the first that fits.
AFFINITY = (("BOOL", "bigint"), ("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("DATE", "string"), ("TIME", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("NUMERIC", "double"), ("DECIMAL", "double"))


def affinity(declared: str) -> str:
    return next((kind for part, kind in AFFINITY if part in declared.upper()), "string")


class _Reader:
    """A cursor over a statement's tokens."""

    def __init__(self, tokens: list[Token]) -> None:
        self.tokens, self.at = tokens, 0

    def peek(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.tokens[k].upper if k < len(self.tokens) else ""

    def take(self) -> Token:
        if self.at >= len(self.tokens):
            raise SyntaxProblem("the statement ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def name(self) -> str:
        found = name_of(self.take())
        while self.peek() == ".":
            self.take()
            found = name_of(self.take())
        return found

    def word(self, *words: str) -> bool:
        """Read these words if they come next."""
        if all(self.peek(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.word(*words):
            raise SyntaxProblem(f"{' '.join(words)} is needed before {self.peek() or 'the end'}")

    def until(self, *stops: str) -> list[Token]:
        """Tokens up to one of the words or signs outside parentheses, or the end."""
        out, depth = [], 0
        while self.at < len(self.tokens):
            up = self.peek()
            if depth == 0 and up in stops or depth == 0 and up == ")":
                break
            t = self.take()
            depth += (t.text == "(") - (t.text == ")") if t.kind == "sign" else (up == "CASE") - (up == "END")
            out.append(t)
        return out

    def group(self) -> list[Token]:
        """What is in the parentheses that come next."""
        self.need("(")
        out, depth = [], 0
        while True:
            t = self.take()
            if t.text == ")" and depth == 0 and t.kind == "sign":
                return out
            depth += (t.text == "(") - (t.text == ")") if t.kind == "sign" else 0
            out.append(t)

    def names(self) -> tuple[str, ...]:
        return tuple(name_of(p[0]) for p in split(self.group()))

    def rest(self) -> list[Token]:
        out, self.at = self.tokens[self.at :], len(self.tokens)
        return out


def split(tokens: list[Token]) -> list[list[Token]]:
    """Parts between commas outside parentheses."""
    parts, now, depth = [], [], 0
    for t in tokens:
        if t.text == "," and depth == 0 and t.kind == "sign":
            parts.append(now)
            now = []
            continue
        depth += (t.text == "(") - (t.text == ")") if t.kind == "sign" else 0
        now.append(t)
    return [*parts, now] if now or parts else []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a single machine may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("THORNMILL_SHARED")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise EngineError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.environ["THORNMILL_SHARED"] = "file://" + tempfile.mkdtemp(prefix="thornmill-")
    return f"{base.rstrip('/')}/engine/{uuid.uuid4().hex}"


class _Stopped(Exception):
    """A statement that ended at a row, and what its changes so far are."""

    def __init__(self, reason: Exception) -> None:
        self.reason = reason


class _Repeated(Exception):
    """A row would be changed by several rows of the source."""


class Engine:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark.newSession()
        for key, value in (("spark.sql.ansi.enabled", "false"), ("spark.sql.session.timeZone", "UTC"), ("spark.sql.caseSensitive", "false")):
            self.spark.conf.set(key, value)
        self.now = Snapshot()
        self.saved: list[tuple[str, Snapshot]] = []
        self.changed = self.changes_total = self.last_id = 0
        self.settings = {"user_version": 0, "application_id": 0, "foreign_keys": 1}
        self.collations: dict[str, str] = {}
        self.databases: dict[str, str] = {}
        self.schema_version, self.home, self.folders = 0, None, 0
        jsontext.register(self.spark)
        register_elements(self.spark)
        self.spark.sql("CREATE TEMPORARY FUNCTION tm_json_list(parts ARRAY<STRING>) RETURNS STRING RETURN concat('[', array_join(transform(parts, p -> substring(p, 2, length(p) - 2)), ','), ']')")
        self.spark.sql("CREATE TEMPORARY FUNCTION tm_json_list1(part STRING) RETURNS STRING RETURN substring(part, 2, length(part) - 2)")
        self.depth = 0

    # --- the outside

    def attach(self, name: str, df: DataFrame, key: tuple[str, ...] = ()) -> None:
        """A DataFrame as a table; its rows stay where they are until a statement changes them."""
        frame = self._own(df)
        columns = tuple(Column(f.name, f.dataType.simpleString().upper(), f.dataType.simpleString()) for f in frame.schema)
        self._put(Table(name, frame, columns, key))

    def execute(self, sql: str, params: dict | list | tuple | None = None) -> DataFrame | None:
        """The result of the last statement; queries stay lazy."""
        results = self.script(sql, params)
        return results[-1] if results else None

    def script(self, sql: str, params: dict | list | tuple | None = None) -> list[DataFrame | None]:
        args = {f"p{k + 1}": v for k, v in enumerate(params)} if isinstance(params, (list, tuple)) else {str(k).lstrip(":@$"): v for k, v in (params or {}).items()}
        return [self._statement(s, args) for s in statements(sql)]

    def create_function(self, name: str, nargs: int, function, deterministic: bool = False, returns: str = "string") -> None:
        """A Python scalar function, called with Arrow batches."""
        made = F.udf(function, returns, useArrow=True)
        self.spark.udf.register(name, made if deterministic else made.asNondeterministic())

    def create_aggregate(self, name: str, nargs: int, cls, returns: str = "double") -> None:
        """A class with step() and final(); each group goes through one object, so it can't be added up in parts."""
        import pandas as pd

        def run(*columns: pd.Series):
            one = cls()
            for values in zip(*columns, strict=True):
                one.step(*values)
            return one.final()

        names = ", ".join(f"c{k}: pd.Series" for k in range(nargs))
        scope: dict = {"pd": pd, "run": run}
        exec(f"def aggregate({names}) -> float:\n    return run({', '.join(f'c{k}' for k in range(nargs))})", scope)
        self.spark.udf.register(name, F.pandas_udf(scope["aggregate"], returns))

    def create_collation(self, name: str, key) -> None:
        """An order of texts: ``x COLLATE name`` stands for key(x), a Python function that gives the text to compare by."""
        function = f"tm_collation_{name.lower()}"
        self.spark.udf.register(function, F.udf(lambda x: None if x is None else key(x), "string", useArrow=True))
        self.collations[name.upper()] = function

    def create_table_function(self, name: str, function, returns: str) -> None:
        """A generator of rows as a function to be used in FROM."""

        class Rows:
            def eval(self, *args):
                yield from function(*args)

        self.spark.udtf.register(name, F.udtf(Rows, returnType=returns))

    def schema_objects(self) -> DataFrame:
        rows = [("table", t.name, t.name, t.sql) for t in self.now.tables.values()]
        rows += [("view", n, n, q) for n, q in self.now.views.items()]
        rows += [("trigger", t.name, t.table, None) for t in self.now.triggers.values()]
        rows += [("index", i.name, i.table, None) for i in self.now.indexes.values()]
        return self.spark.createDataFrame(rows, "type string, name string, tbl_name string, sql string")

    def _folder(self) -> str:
        """A new folder within the engine's own, which goes when the engine is closed or the driver ends."""
        if self.home is None:
            self.home = shared_folder(self.spark)
            atexit.register(self.close)
        self.folders += 1
        return f"{self.home}/{self.folders}"

    def close(self) -> None:
        """Remove what the engine has written; its tables can't be read any more, nor results that aren't collected."""
        if self.home is not None:
            with contextlib.suppress(Exception):  # the session may be gone, and the folder is only scratch
                target = self.spark._jvm.org.apache.hadoop.fs.Path(self.home)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
            self.home = None

    def save(self, path: str) -> None:
        """Every table as Parquet below ``path``."""
        for t in self.now.tables.values():
            t.df.write.mode("overwrite").parquet(f"{path}/{t.name}")

    # --- catalog

    def _own(self, df: DataFrame) -> DataFrame:
        """The same plan in the engine's session."""
        if df.sparkSession is self.spark:
            return df
        jvm = self.spark._jvm
        return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.queryExecution().logical()), self.spark)

    def table(self, name: str) -> Table:
        found = self.now.tables.get(name.lower())
        if found is None:
            raise EngineError(f"no such table: {name}")
        return found

    def _put(self, t: Table) -> None:
        if t.writes >= MOST_WRITES:
            path = self._folder()
            t.df.write.parquet(path)
            t = replace(t, df=self.spark.read.schema(t.df.schema).parquet(path), writes=0, settled=True)
        self.now.tables[t.name.lower()] = t
        self._publish(t)
        self._publish_views()

    def _publish(self, t: Table) -> None:
        df = t.df
        for c in t.columns:
            if c.generated and not c.stored:
                df = df.withColumn(c.name, F.expr(c.generated).cast(c.kind))
        df.select(*(F.col(f"`{c.name}`") for c in t.columns), *([F.col("docid")] if t.fulltext else [])).createOrReplaceTempView(f"`{t.name}`")

    def _restore(self, snapshot: Snapshot) -> None:
        for gone in {*self.now.tables, *self.now.views} - {*snapshot.tables, *snapshot.views}:
            self.spark.catalog.dropTempView(gone)
        self.now = snapshot
        for t in snapshot.tables.values():
            self._publish(t)
        self._publish_views()

    def _publish_views(self) -> None:
        """Views are their texts, read anew whenever a table below them has changed."""
        for name, query in self.now.views.items():
            with contextlib.suppress(AnalysisException):  # a table or column below it is gone
                self.spark.sql(query).createOrReplaceTempView(name)

    def _literals(self) -> dict[str, str]:
        return {"CHANGES": f"{self.changed}L", "TOTAL_CHANGES": f"{self.changes_total}L", "LAST_INSERT_ROWID": f"{self.last_id}L"}

    def text(self, tokens: list[Token]) -> str:
        return rewrite(tokens, self._literals(), self.collations)

    def _sql(self, text: str, args: dict | None = None) -> DataFrame:
        used = {k: v for k, v in (args or {}).items() if f":{k}" in text}
        return self.spark.sql(text, args=used) if used else self.spark.sql(text)

    # --- statements

    def _statement(self, tokens: list[Token], args: dict) -> DataFrame | None:
        tokens = self._of_databases(tokens)
        r = _Reader(tokens)
        up = r.peek()
        if up == "EXPLAIN":
            r.take()
            r.word("QUERY", "PLAN")
            return self._sql("EXPLAIN FORMATTED " + self.text(r.rest()), args)
        if up in ("SELECT", "VALUES", "WITH"):
            return self._query(tokens, args)
        handler = {
            "CREATE": self._create, "DROP": self._drop, "ALTER": self._alter, "PRAGMA": self._pragma, "BEGIN": self._begin, "COMMIT": self._commit, "END": self._commit,
            "ATTACH": self._attach_files, "DETACH": self._detach, "ROLLBACK": self._rollback, "SAVEPOINT": self._savepoint, "RELEASE": self._release, "ANALYZE": self._nothing, "REINDEX": self._nothing, "VACUUM": self._vacuum,
        }.get(up)
        if handler:
            self.schema_version += up in ("CREATE", "DROP", "ALTER")
            return handler(r)
        if up in ("INSERT", "REPLACE", "UPDATE", "DELETE"):
            return self._change(r, args)
        raise SyntaxProblem(f"unknown statement: {tokens[0].text}")

    def _query(self, tokens: list[Token], args: dict) -> DataFrame | None:
        if tokens[0].upper == "WITH":  # WITH may stand before a change
            r, depth = _Reader(tokens), 0
            for k, t in enumerate(tokens):
                depth += (t.text == "(") - (t.text == ")") if t.kind == "sign" else 0
                if depth == 0 and t.upper in ("INSERT", "UPDATE", "DELETE"):
                    r.take()
                    for name, query in self._ctes(tokens[1:k]):
                        self._sql(self.text(query), args).createOrReplaceTempView(name)
                    return self._change(_Reader(tokens[k:]), args)
        return self._sql(self.text(rewrite_windows(self._row_ids(self._matches(tokens)))), args)

    def _row_ids(self, tokens: list[Token]) -> list[Token]:
        """rowid, _rowid_ and oid are the integer key of the one table that has such a key, or a full-text table's docid."""
        if not any(t.upper in ("ROWID", "_ROWID_", "OID") for t in tokens):
            return tokens
        used = {t.name.lower(): t for x in tokens if x.kind in ("word", "quoted") and (t := self.now.tables.get(name_of(x).lower()))}
        keys = {"docid" if t.fulltext else t.integer_key for t in used.values()} - {None}
        if len(keys) != 1:
            return tokens
        return [Token("quoted", f"`{next(iter(keys))}`") if t.upper in ("ROWID", "_ROWID_", "OID") else t for t in tokens]

    def _ctes(self, tokens: list[Token]) -> Iterator[tuple[str, list[Token]]]:
        for part in split(tokens):
            r = _Reader(part)
            name = r.name()
            if r.peek() == "(":
                r.group()
            r.need("AS")
            yield name, r.group()

    def _matches(self, tokens: list[Token]) -> list[Token]:
        """MATCH on a full-text table becomes a semi-join with what the search finds; bm25(t) and rank its score (smaller is better)."""
        if not any(t.upper == "MATCH" for t in tokens):
            return tokens
        names = {t.name.lower(): t for t in self.now.tables.values() if t.fulltext}
        used = next((names[name_of(t).lower()] for t in tokens if t.kind in ("word", "quoted") and name_of(t).lower() in names), None)
        if used is None:
            raise EngineError("MATCH needs a full-text table")
        columns, out, k = [c.name for c in used.columns], [], 0
        view = f"__match_{uuid.uuid4().hex[:8]}"
        at = next(j for j, t in enumerate(tokens) if t.upper == "MATCH")
        query = tokens[at + 1].text[1:-1].replace("''", "'")
        chosen = [next(c for c in columns if c.lower() == name_of(tokens[at - 1]).lower())] if name_of(tokens[at - 1]).lower() in {c.lower() for c in columns} else columns
        more: dict[str, F.Column] = {}
        weights, ranked = None, False

        def call(j: int) -> tuple[list[str], int]:
            """Texts of the arguments of the call whose parenthesis opens at j, and where it ends."""
            r = _Reader(tokens[j:])
            parts = [" ".join(t.text for t in p) for p in split(r.group())]
            return parts, j + r.at

        text = lambda a: a[1:-1].replace("''", "'")
        while k < len(tokens):
            t, calls = tokens[k], k + 1 < len(tokens) and tokens[k + 1].text == "("
            if k + 1 == at:
                out += tokenize(f"{used.name}.docid IN (SELECT docid FROM {view})")
                k += 3
            elif t.upper == "BM25" and calls:
                parts, k = call(k + 1)
                weights, ranked = [float(x.replace(" ", "")) for x in parts[1:]] or None, True
                out += tokenize("(-__score)")
            elif t.upper in ("HIGHLIGHT", "SNIPPET") and calls:
                parts, k = call(k + 1)
                column = columns[max(0, int(parts[1].replace(" ", "")))]
                name, ranked = f"__shown{len(more)}", True
                stems = used.fulltext if used.fulltext == "porter" else "unicode61"
                if t.upper == "HIGHLIGHT":
                    more[name] = fulltext.highlight(column, query, text(parts[2]), text(parts[3]), stems)
                else:
                    more[name] = fulltext.snippet(column, query, int(parts[5]) if len(parts) > 5 else 10, text(parts[2]), text(parts[3]), text(parts[4]))
                out.append(Token("quoted", f"`{name}`"))
            elif t.upper == "RANK" and not calls:
                ranked = True
                out += tokenize("(-__score)")
                k += 1
            else:
                out.append(t)
                k += 1
        found = fulltext.search(used.df, query, chosen, used.fulltext, weights=weights, indexed=columns)
        found.select("*", *(c.alias(n) for n, c in more.items())).createOrReplaceTempView(view)
        if ranked:  # the rows that match, with their scores, in place of the table
            shown = tokenize(f"(SELECT docid, {', '.join(f'`{c}`' for c in [*columns, *more])}, score AS __score FROM {view}) AS {used.name}")
            out = [y for j, x in enumerate(out) for y in (shown if j and out[j - 1].upper in ("FROM", "JOIN") and name_of(x).lower() == used.name.lower() else [x])]
        return out

    def _nothing(self, r: _Reader) -> None:
        return None

    # --- further databases: folders of Parquet tables, as save() leaves them

    def _attach_files(self, r: _Reader) -> None:
        r.take()
        r.word("DATABASE")
        path = r.take().text[1:-1].replace("''", "'")
        r.need("AS")
        name = r.name().lower()
        if name in self.databases or name in ("main", "temp"):
            raise EngineError(f"database {name} is already in use")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found = [s.getPath() for s in folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)]
        self.databases[name] = path
        for p in found:
            self.attach(f"{name}.{p.getName().removesuffix('.parquet')}", self.spark.read.parquet(p.toString()))

    def _detach(self, r: _Reader) -> None:
        r.take()
        r.word("DATABASE")
        name = r.name().lower()
        if self.databases.pop(name, None) is None:
            raise EngineError(f"no such database: {name}")
        for t in [t for t in self.now.tables.values() if t.name.lower().startswith(f"{name}.")]:
            del self.now.tables[t.name.lower()]
            self.spark.catalog.dropTempView(t.name)

    def _of_databases(self, tokens: list[Token]) -> list[Token]:
        """main.t is t; t of another database is one name with a dot in it."""
        if not any(t.text == "." for t in tokens):
            return tokens
        out, k, names = [], 0, {t.lower() for t in self.now.tables}
        while k < len(tokens):
            t = tokens[k]
            if k + 2 < len(tokens) and tokens[k + 1].text == "." and t.kind in ("word", "quoted") and not (out and out[-1].text == "."):
                base, inner = name_of(t).lower(), name_of(tokens[k + 2])
                if base == "main" and "main" not in names:
                    out.append(tokens[k + 2])
                    k += 3
                    continue
                if base in self.databases:
                    out.append(Token("quoted", f"`{base}.{inner}`"))
                    k += 3
                    continue
            out.append(t)
            k += 1
        return out

    def _vacuum(self, r: _Reader) -> None:
        for t in list(self.now.tables.values()):
            self._put(replace(t, writes=MOST_WRITES))

    # --- transactions

    def _begin(self, r: _Reader) -> None:
        if any(name == "" for name, _ in self.saved):
            raise TransactionError("a transaction is already open")
        self.saved.append(("", self.now.copy()))

    def _commit(self, r: _Reader) -> None:
        if not self.saved:
            raise TransactionError("no transaction is open")
        if self.settings.get("foreign_keys", 1):
            for t in self.now.tables.values():
                for f in t.foreign:
                    if f.deferred and not self._orphans(t, f, t.df).isEmpty():
                        raise ConstraintError("FOREIGN KEY", f"{t.name}({', '.join(f.columns)}) refers to no row of {f.table}")
        self.saved.clear()

    def _rollback(self, r: _Reader) -> None:
        r.take()
        r.word("TRANSACTION")
        if r.word("TO"):
            r.word("SAVEPOINT")
            k = self._place(r.name())
            self._restore(self.saved[k][1].copy())
            del self.saved[k + 1 :]
            return
        if not self.saved:
            raise TransactionError("no transaction is open")
        self._restore(self.saved[0][1])
        self.saved.clear()

    def _place(self, name: str) -> int:
        for k in range(len(self.saved) - 1, -1, -1):
            if self.saved[k][0] == name.lower():
                return k
        raise TransactionError(f"no such savepoint: {name}")

    def _savepoint(self, r: _Reader) -> None:
        r.take()
        self.saved.append((r.name().lower(), self.now.copy()))

    def _release(self, r: _Reader) -> None:
        r.take()
        r.word("SAVEPOINT")
        del self.saved[self._place(r.name()) :]

    # --- definitions

    def _create(self, r: _Reader) -> None:
        r.take()
        r.word("TEMP") or r.word("TEMPORARY")
        if r.word("TABLE"):
            return self._create_table(r)
        if r.word("VIRTUAL", "TABLE"):
            return self._create_virtual(r)
        unique = r.word("UNIQUE")
        if r.word("INDEX"):
            return self._create_index(r, unique)
        if r.word("VIEW"):
            return self._create_view(r)
        if r.word("TRIGGER"):
            return self._create_trigger(r)
        raise SyntaxProblem(f"CREATE {r.peek()}")

    def _new_name(self, r: _Reader) -> str | None:
        """The name to create, or None if there is such a thing and IF NOT EXISTS was said."""
        lenient = r.word("IF", "NOT", "EXISTS")
        name = r.name()
        if name.lower() in {*self.now.tables, *self.now.views, *self.now.triggers, *self.now.indexes}:
            if lenient:
                return None
            raise EngineError(f"there is already something named {name}")
        return name

    def _create_table(self, r: _Reader) -> None:
        source = " ".join(t.text for t in r.tokens)
        name = self._new_name(r)
        if name is None:
            return
        if r.word("AS"):
            df = self._sql(self.text(r.rest()))
            columns = tuple(Column(f.name, f.dataType.simpleString().upper(), f.dataType.simpleString()) for f in df.schema)
            return self._put(Table(name, df, columns, sql=source, writes=MOST_WRITES))
        columns, key, unique, checks, foreign = [], (), [], [], []
        for part in split(r.group()):
            p = _Reader(part)
            if p.word("CONSTRAINT"):
                p.name()
            if p.word("PRIMARY", "KEY"):
                key = p.names()
            elif p.peek() == "UNIQUE" and p.peek(1) == "(":
                p.take()
                unique.append(p.names())
            elif p.peek() == "CHECK" and p.peek(1) == "(":
                p.take()
                checks.append(self.text(p.group()))
            elif p.word("FOREIGN", "KEY"):
                foreign.append(self._references(p, p.names()))
            else:
                column, more = self._column(p)
                columns.append(column)
                key = more.get("key", key)
                unique += more.get("unique", [])
                checks += more.get("checks", [])
                foreign += more.get("foreign", [])
        strict = without = False
        for option in split(r.rest()):
            words = [t.upper for t in option]
            strict |= words == ["STRICT"]
            without |= words == ["WITHOUT", "ROWID"]
        foreign = [f if f.targets else replace(f, targets=(self.now.tables[f.table.lower()].key if f.table.lower() in self.now.tables else key)) for f in foreign]
        kept = [c for c in columns if not c.generated or c.stored]
        df = self.spark.createDataFrame([], ", ".join(f"`{c.name}` {c.kind}" for c in kept))
        self._put(Table(name, df, tuple(columns), key, tuple(unique), tuple(checks), tuple(foreign), strict, without, sql=source))

    def _column(self, p: _Reader) -> tuple[Column, dict]:
        name, more = p.name(), {}
        words = ("PRIMARY", "NOT", "NULL", "UNIQUE", "CHECK", "DEFAULT", "COLLATE", "REFERENCES", "GENERATED", "AS", "CONSTRAINT", "AUTOINCREMENT")
        declared = " ".join(t.text for t in p.until(*words))
        column = Column(name, declared, affinity(declared))
        while p.peek():
            if p.word("PRIMARY", "KEY"):
                p.word("ASC") or p.word("DESC")
                more["key"] = (name,)
            elif p.word("NOT", "NULL"):
                column = replace(column, not_null=True)
            elif p.word("UNIQUE"):
                more["unique"] = [(name,)]
            elif p.word("CHECK"):
                more["checks"] = [self.text(p.group())]
            elif p.word("DEFAULT"):
                value = [Token("sign", "("), *p.group(), Token("sign", ")")] if p.peek() == "(" else [p.take(), *([p.take()] if p.tokens[p.at - 1].text in "+-" else [])]
                column = replace(column, default={"CURRENT_TIMESTAMP": "date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')", "CURRENT_DATE": "cast(current_date() AS string)", "CURRENT_TIME": "date_format(current_timestamp(), 'HH:mm:ss')"}.get(value[0].upper, self.text(value)))
            elif p.word("COLLATE"):
                column = replace(column, collation=p.name().upper())
            elif p.peek() == "REFERENCES":
                more["foreign"] = [self._references(p, (name,))]
            elif p.peek() in ("GENERATED", "AS"):
                p.word("GENERATED", "ALWAYS")
                p.need("AS")
                column = replace(column, generated=self.text(p.group()))
                column = replace(column, stored=p.word("STORED") or (p.word("VIRTUAL") and False))
            elif p.word("CONSTRAINT"):
                p.name()
            elif not (p.word("AUTOINCREMENT") or p.word("NULL")):
                raise SyntaxProblem(f"unknown column constraint: {p.peek()}")
        return column, more

    def _references(self, p: _Reader, columns: tuple[str, ...]) -> ForeignKey:
        p.need("REFERENCES")
        table, targets, actions, deferred = p.name(), (), {"DELETE": "NO ACTION", "UPDATE": "NO ACTION"}, False
        if p.peek() == "(":
            targets = p.names()
        while p.peek():
            if p.word("ON"):
                event = p.take().upper
                actions[event] = next(a for a in ("CASCADE", "SET NULL", "SET DEFAULT", "RESTRICT", "NO ACTION") if p.word(*a.split()))
            elif p.word("INITIALLY", "DEFERRED"):
                deferred = True
            elif not (p.word("DEFERRABLE") or p.word("NOT", "DEFERRABLE") or p.word("INITIALLY", "IMMEDIATE")):
                break
        return ForeignKey(columns, table, targets, actions["DELETE"], actions["UPDATE"], deferred)

    def _create_virtual(self, r: _Reader) -> None:
        name = self._new_name(r)
        r.need("USING")
        if r.name().lower() != "fts5":
            raise EngineError("the only virtual tables are full-text tables")
        columns, tokenizer = [], "unicode61"
        for part in split(r.group()):
            if len(part) > 2 and part[1].text == "=":
                if part[0].upper == "TOKENIZE":
                    tokenizer = name_of(part[2]).strip("'").split()[0]
            else:
                columns.append(Column(name_of(part[0]), "TEXT", "string"))
        if name is not None:
            df = self.spark.createDataFrame([], ", ".join(["docid bigint", *(f"`{c.name}` string" for c in columns)]))
            self._put(Table(name, df, tuple(columns), fulltext=tokenizer))

    def _create_index(self, r: _Reader, unique: bool) -> None:
        name = self._new_name(r)
        if name is None:
            return
        r.need("ON")
        t = self.table(r.name())
        columns = tuple(self.text(p[:1]).strip("`") for p in split(r.group()))
        where = self.text(r.rest()) if r.word("WHERE") else None
        if unique and where is None:
            made = replace(t, unique=(*t.unique, columns))
            self._check_unique(made, made.df)
            self._put(made)
        self.now.indexes[name.lower()] = Index(name, t.name, columns, unique, where)

    def _create_view(self, r: _Reader) -> None:
        name = self._new_name(r)
        if name is None:
            return
        names = r.names() if r.peek() == "(" else ()
        r.need("AS")
        query = self.text(rewrite_windows(r.rest()))
        if names:
            query = f"SELECT * FROM ({query}) AS v({', '.join(f'`{n}`' for n in names)})"
        self.spark.sql(query).createOrReplaceTempView(name)
        self.now.views[name.lower()] = query

    def _create_trigger(self, r: _Reader) -> None:
        name = self._new_name(r)
        time = "BEFORE" if r.word("BEFORE") else "INSTEAD OF" if r.word("INSTEAD", "OF") else "AFTER" if r.word("AFTER") else "BEFORE"
        event = r.take().upper
        columns = tuple(name_of(p[0]) for p in split(r.until("ON"))) if r.word("OF") else ()
        r.need("ON")
        table = r.name()
        r.word("FOR", "EACH", "ROW")
        when = tuple(r.until("BEGIN")) if r.word("WHEN") else None
        r.need("BEGIN")
        body, now = [], []
        for t in r.rest()[:-1]:
            if t.text == ";":
                body.append(tuple(now))
                now = []
            else:
                now.append(t)
        if name is not None:
            self.now.triggers[name.lower()] = Trigger(name, table.lower(), time, event, columns, when, tuple(b for b in [*body, tuple(now)] if b))

    def _drop(self, r: _Reader) -> None:
        r.take()
        kind = r.take().upper
        lenient = r.word("IF", "EXISTS")
        name = r.name()
        home = {"TABLE": self.now.tables, "VIEW": self.now.views, "INDEX": self.now.indexes, "TRIGGER": self.now.triggers}[kind]
        if name.lower() not in home:
            if lenient:
                return
            raise EngineError(f"no such {kind.lower()}: {name}")
        gone = home.pop(name.lower())
        if kind in ("TABLE", "VIEW"):
            self.spark.catalog.dropTempView(name)
        if kind == "INDEX" and gone.unique:
            t = self.table(gone.table)
            self._put(replace(t, unique=tuple(u for u in t.unique if u != gone.columns)))

    def _alter(self, r: _Reader) -> None:
        r.need("ALTER", "TABLE")
        t = self.table(r.name())
        if r.word("RENAME", "TO"):
            new = r.name()
            del self.now.tables[t.name.lower()]
            self.spark.catalog.dropTempView(t.name)
            return self._put(replace(t, name=new))
        if r.word("RENAME"):
            r.word("COLUMN")
            old = r.name()
            r.need("TO")
            new = r.name()
            names = lambda xs: tuple(new if x.lower() == old.lower() else x for x in xs)
            columns = tuple(replace(c, name=new) if c.name.lower() == old.lower() else c for c in t.columns)
            return self._put(replace(t, df=t.df.withColumnRenamed(old, new), columns=columns, key=names(t.key), unique=tuple(map(names, t.unique)), foreign=tuple(replace(f, columns=names(f.columns)) for f in t.foreign)))
        if r.word("ADD"):
            r.word("COLUMN")
            column, _ = self._column(_Reader(r.rest()))
            if column.not_null and column.default is None and not t.df.isEmpty():
                raise ConstraintError("NOT NULL", f"{t.name}.{column.name} needs a default")
            df = t.df if column.generated and not column.stored else t.df.withColumn(column.name, F.expr(column.generated or column.default or "NULL").cast(column.kind))
            return self._put(replace(t, df=df, columns=(*t.columns, column)))
        if r.word("DROP"):
            r.word("COLUMN")
            name = r.name()
            if name.lower() in {k.lower() for k in t.key}:
                raise EngineError(f"{name} is part of the key")
            return self._put(replace(t, df=t.df.drop(name), columns=tuple(c for c in t.columns if c.name.lower() != name.lower())))
        raise SyntaxProblem(f"ALTER TABLE {r.peek()}")

    def _pragma(self, r: _Reader) -> DataFrame | None:
        r.take()
        what = r.name().lower()
        argument = name_of(r.group()[0]).strip("'") if r.peek() == "(" else name_of(r.take()).strip("'") if r.word("=") else None
        rows, schema = self._pragma_rows(what, argument)
        return None if rows is None else self.spark.createDataFrame(rows, schema)

    def _pragma_rows(self, what: str, of: str | None) -> tuple[list | None, str]:
        if what in ("table_info", "table_xinfo"):
            t = self.table(of)
            return [(k, c.name, c.declared, int(c.not_null), c.default, t.key.index(c.name) + 1 if c.name in t.key else 0) for k, c in enumerate(t.columns)], "cid long, name string, type string, notnull long, dflt_value string, pk long"
        if what == "index_list":
            return [(k, i.name, int(i.unique), "c", int(i.where is not None)) for k, i in enumerate(x for x in self.now.indexes.values() if x.table.lower() == of.lower())], "seq long, name string, unique long, origin string, partial long"
        if what == "index_info":
            i = self.now.indexes[of.lower()]
            names = [c.name.lower() for c in self.table(i.table).columns]
            return [(k, names.index(c.lower()) if c.lower() in names else -2, c) for k, c in enumerate(i.columns)], "seqno long, cid long, name string"
        if what == "foreign_key_list":
            return [(k, n, f.table, c, f.targets[n] if n < len(f.targets) else None, f.on_update, f.on_delete) for k, f in enumerate(self.table(of).foreign) for n, c in enumerate(f.columns)], "id long, seq long, table string, from string, to string, on_update string, on_delete string"
        if what in ("integrity_check", "quick_check"):
            found = []
            for t in self.now.tables.values():
                try:
                    self._check(t, t.df)
                except ConstraintError as e:
                    found.append((str(e),))
            return found or [("ok",)], f"{what} string"
        if what == "foreign_key_check":
            found = [(t.name, f.table) for t in self.now.tables.values() for f in t.foreign if not self._orphans(t, f, t.df).isEmpty()]
            return found, "table string, parent string"
        if what == "database_list":
            return [(0, "main", ""), *((k + 2, n, p) for k, (n, p) in enumerate(self.databases.items()))], "seq long, name string, file string"
        if what == "function_list":
            return [(f.name,) for f in self.spark.catalog.listFunctions() if f.isTemporary], "name string"
        if what == "collation_list":
            return [(0, "BINARY"), (1, "NOCASE"), (2, "RTRIM")], "seq long, name string"
        if what == "compile_options":
            return [], "compile_options string"
        fixed = {"encoding": "UTF-8", "journal_mode": "memory", "schema_version": self.schema_version}  # there are no pages to count
        if of is not None and what not in fixed:
            self.settings[what] = int(of) if of.lstrip("-").isdigit() else {"ON": 1, "OFF": 0}.get(of.upper(), of)
            return None, ""
        value = fixed.get(what, self.settings.get(what))
        return ([(value,)], f"{what} {'string' if isinstance(value, str) else 'long'}") if value is not None else ([], f"{what} string")

    # --- changes

    def _change(self, r: _Reader, args: dict) -> DataFrame | None:
        """One INSERT, UPDATE or DELETE with its triggers and foreign keys; all of it or nothing."""
        before, ups = self.now.copy(), [t.upper for t in r.tokens[:3]]
        try:
            self.depth += 1
            if self.depth > 32:
                raise EngineError("triggers call each other too deeply")
            kind = r.peek()
            return self._insert(r, args) if kind in ("INSERT", "REPLACE") else self._update(r, args) if kind == "UPDATE" else self._delete(r, args)
        except _Stopped as e:  # OR FAIL: what came before stays
            raise e.reason from None
        except Exception as e:
            self._restore(before)
            if isinstance(e, ConstraintError) and self.depth == 1 and self.saved and "ROLLBACK" in ups[1:3]:
                self._restore(self.saved[0][1])
                self.saved.clear()
            raise
        finally:
            self.depth -= 1

    def _count(self, df: DataFrame) -> None:
        self.changed = df.count()
        self.changes_total += self.changed

    def _returning(self, r: _Reader, t: Table, rows: DataFrame, args: dict) -> DataFrame | None:
        if not r.word("RETURNING"):
            return None
        view = f"__returned_{uuid.uuid4().hex[:8]}"
        self._shown(t, rows).createOrReplaceTempView(view)
        return self._sql(f"SELECT {self.text(r.rest())} FROM {view} AS `{t.name}`", args)

    def _shown(self, t: Table, rows: DataFrame) -> DataFrame:
        for c in t.columns:
            if c.generated and not c.stored:
                rows = rows.withColumn(c.name, F.expr(c.generated).cast(c.kind))
        return rows.select(*(F.col(f"`{c.name}`") for c in t.columns))

    def _generated(self, t: Table, rows: DataFrame) -> DataFrame:
        for c in t.columns:
            if c.generated:
                rows = rows.withColumn(c.name, F.expr(c.generated).cast(c.kind))
        return rows.select(*([F.col("docid")] if t.fulltext else []), *(F.col(f"`{c.name}`") for c in t.stored), *(["__at"] if "__at" in rows.columns else []))

    def _insert(self, r: _Reader, args: dict) -> DataFrame | None:
        policy = "REPLACE" if r.take().upper == "REPLACE" else r.take().upper if r.word("OR") else "ABORT"
        r.need("INTO")
        name = r.name()
        view = name.lower() in self.now.views
        t = None if view else self.table(name)
        alias = r.name() if r.word("AS") else name
        targets = list(r.names()) if r.peek() == "(" else None
        if r.word("DEFAULT", "VALUES"):
            given, targets = self.spark.range(1).select(), []
        else:
            given = self._sql(self.text(r.until("ON", "RETURNING") if r.peek() == "VALUES" else self._source(r)), args)
        if view:
            columns = self.spark.table(name).columns
            return self._instead(name, "INSERT", given.toDF(*(targets or columns)))
        writable = [c.name for c in t.columns if not c.generated]
        targets = writable if targets is None else targets
        if len(given.columns) != len(targets):
            raise SyntaxProblem(f"{len(targets)} columns of {t.name} get {len(given.columns)} values")
        given = given.toDF(*targets) if targets else given
        given = given.select(*(F.col(f"`{c}`").cast("string").alias(c) if kind == "void" else F.col(f"`{c}`") for c, kind in given.dtypes))
        given = self._pin(given.withColumn("__at", F.monotonically_increasing_id()))  # __at: the statement's order
        rows = self._fill(t, given, targets)
        plain = rows.drop("__at")
        self._fire("BEFORE", "INSERT", t, plain, None)
        t = self.table(name)
        conflict, action, guard = (), None, None
        if r.word("ON", "CONFLICT"):
            conflict = r.names() if r.peek() == "(" else ()
            if r.word("WHERE"):
                r.until("DO")
            r.need("DO")
            if r.word("NOTHING"):
                policy = "NOTHING"
            else:
                r.need("UPDATE", "SET")
                action = self._assignments(r.until("WHERE", "RETURNING"))
                guard = self.text(r.until("RETURNING")) if r.word("WHERE") else None
        old, touched, failed = t.df, plain, None
        if action is not None:
            key = next((k for k in t.keys() if not conflict or {x.lower() for x in k} == {x.lower() for x in conflict}), None)
            if key is None:
                raise EngineError("ON CONFLICT names no key of the table")
            old, touched = self._upserts(t, rows, key, action, guard, alias, args)
        elif policy in ("IGNORE", "NOTHING"):
            if policy == "IGNORE":
                rows = rows.where(self._fine(t, rows))
            for key in t.keys():
                if policy == "IGNORE" or not conflict or {x.lower() for x in key} == {x.lower() for x in conflict}:
                    rows = self._first(rows, key, last=False).join(old.select(*key), list(key), "left_anti").select(*rows.columns)
            touched = self._pin(rows.drop("__at"))
        elif policy == "REPLACE":
            for key in t.keys():
                rows = self._first(rows, key, last=True)
                old = old.join(rows.select(*key), list(key), "left_anti").select(*old.columns)
            touched = rows.drop("__at")
        elif policy == "FAIL" and (end := self._first_bad(t, rows, old)) is not None:
            touched, failed = rows.where(F.col("__at") < end).drop("__at"), ConstraintError("CONSTRAINT", f"a row for {t.name} was refused; those before it stay")
        new = old.unionByName(touched)
        made = t.with_rows(new)
        self._check(made, new, touched, old)
        self._put(made)
        self._count(touched)
        if t.integer_key and (top := touched.agg(F.max(t.integer_key)).first()[0]) is not None:
            self.last_id = top
        changed = self.changed
        self._fire("AFTER", "INSERT", t, touched, None)
        self.changed = changed
        if failed is not None:
            raise _Stopped(failed)
        return self._returning(r, t, touched, args)

    def _fine(self, t: Table, rows: DataFrame) -> F.Column:
        """Whether a row keeps NOT NULL and CHECK."""
        test = F.lit(True)
        for c in t.columns:
            if c.not_null and c.name in rows.columns:
                test = test & F.col(f"`{c.name}`").isNotNull()
        for check in t.checks:
            test = test & F.coalesce(F.expr(f"({check})").cast("boolean"), F.lit(True))
        return test

    def _first_bad(self, t: Table, rows: DataFrame, old: DataFrame) -> int | None:
        """Where in the statement's order the first row comes that a constraint refuses."""
        bad = rows.where(~self._fine(t, rows)).select("__at")
        for key in t.keys():
            later = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("__at"))).where(F.col("__n") > 1).dropna(subset=list(key))
            bad = bad.union(later.select("__at")).union(rows.join(old.select(*key), list(key), "left_semi").select("__at"))
        return bad.agg(F.min("__at")).first()[0]

    def _source(self, r: _Reader) -> list[Token]:
        """The query of INSERT ... SELECT: up to ON CONFLICT or RETURNING."""
        out, depth = [], 0
        while r.peek():
            if depth == 0 and (r.peek() == "RETURNING" or r.peek() == "ON" and r.peek(1) == "CONFLICT"):
                break
            t = r.take()
            depth += (t.text == "(") - (t.text == ")") if t.kind == "sign" else 0
            out.append(t)
        return out

    def _pin(self, rows: DataFrame) -> DataFrame:
        """Rows that are about to be read several times, written once; small ones too, since a plan may hold random values."""
        path = self._folder()
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _fill(self, t: Table, given: DataFrame, targets: list[str]) -> DataFrame:
        """Given columns, defaults for the rest, numbers for an integer key without values, generated columns."""
        have = {x.lower(): x for x in targets}
        out = []
        for c in t.stored:
            if c.generated:
                continue
            if c.name.lower() in have:
                value = F.col(f"`{have[c.name.lower()]}`")
                if t.strict and dict(given.dtypes)[have[c.name.lower()]] not in (c.kind, "void"):
                    bad = given.where(value.isNotNull() & (value.try_cast(c.kind).isNull() | (F.lit(c.kind != "string") & (value.cast("string") != value.try_cast(c.kind).cast("string")) & (value.try_cast("double") != value.try_cast(c.kind).try_cast("double"))) | F.lit(c.kind == "string" or "string" in dict(given.dtypes)[have[c.name.lower()]])))
                    if not bad.isEmpty():
                        raise ConstraintError("STRICT", f"{t.name}.{c.name} holds {c.declared} only")
                value = value.cast(c.kind)
            else:
                value = F.expr(c.default).cast(c.kind) if c.default else F.lit(None).cast(c.kind)
            out.append(value.alias(c.name))
        rows = given.select(*out, "__at")
        key = "docid" if t.fulltext else t.integer_key
        if t.fulltext:
            rows = rows.withColumn("docid", F.lit(None).cast("bigint"))
        if key:
            rows = self._number(rows, key, t.df.agg(F.coalesce(F.max(key), F.lit(0))).first()[0])
        return self._generated(t, rows)

    def _number(self, rows: DataFrame, key: str, top: int) -> DataFrame:
        """Numbers for the rows without a key, in the statement's order: each part of the rows begins after those before it, so none waits for another."""
        part = F.shiftright("__at", 33)
        found = rows.groupBy(part.alias("part")).agg(F.count(F.when(F.col(key).isNull(), 1)).alias("n"), F.max(key).alias("top")).orderBy("part").collect()  # a row for each task that read the statement's rows
        if not any(r.n for r in found):
            return rows
        top, starts = max([top, *(r.top for r in found if r.top is not None)]), []
        for r in found:
            starts.append((r.part, top))
            top += r.n
        offsets = F.broadcast(self.spark.createDataFrame(starts, "__part long, __start long"))
        mine = F.count(F.when(F.col(key).isNull(), 1)).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
        placed = rows.withColumn("__part", part).join(offsets, "__part").withColumn(key, F.coalesce(F.col(key), F.col("__start") + mine).cast("bigint"))
        return placed.select(*rows.columns)

    def _first(self, rows: DataFrame, key: tuple[str, ...], last: bool) -> DataFrame:
        """One row of each key, the first or the last as they came; rows with a null in the key all stay."""
        w = Window.partitionBy(*key).orderBy(F.desc("__at") if last else F.asc("__at"))
        null = functools.reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))
        return rows.withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) | null).drop("__n")

    def _assignments(self, tokens: list[Token]) -> dict[str, str]:
        out = {}
        for part in split(tokens):
            p = _Reader(part)
            if p.peek() == "(":
                names = p.names()
                p.need("=")
                for n, value in zip(names, split(p.group()), strict=True):
                    out[n.lower()] = self.text(value)
            else:
                n = p.name()
                p.need("=")
                out[n.lower()] = self.text(p.rest())
        return out

    def _upserts(self, t: Table, rows: DataFrame, key: tuple[str, ...], action: dict[str, str], guard: str | None, alias: str, args: dict) -> tuple[DataFrame, DataFrame]:
        """(rows that stay, rows that are inserted or updated). Rows of one key come one after another, a round for each place among them; where they only overwrite, the first and the last are enough."""
        null = functools.reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))
        w = Window.partitionBy(*key)
        placed = self._pin(rows.withColumn("__n", F.when(null, 1).otherwise(F.row_number().over(w.orderBy("__at")))).withColumn("__of", F.when(null, 1).otherwise(F.count("*").over(w))))
        most = placed.agg(F.max("__n")).first()[0] or 1
        names = {c.name.lower() for c in t.columns}
        free = [re.sub(r"(?i)\bexcluded\.`?\w+`?", "", re.sub(r"'[^']*'", "", v)) for v in action.values()]
        overwrites = guard is None and not any(w_.lower() in names for v in free for w_ in re.findall(r"\w+", v))
        rounds = [F.col("__n") == 1, (F.col("__n") == F.col("__of")) & (F.col("__n") > 1)] if overwrites else [F.col("__n") == k for k in range(1, most + 1)]
        stay, done, now = t.df, None, t
        for k, one in enumerate(rounds if most > 1 else rounds[:1]):
            if k:  # what earlier rounds left is what this one meets
                now = replace(t, df=self._pin(stay.unionByName(done)))
            some = placed.where(one).select(*rows.drop("__at").columns)
            left, hit = self._upsert(now, some, key, action, guard, alias, args)
            if k:
                before = done
                done = self._pin(before.join(hit.select(*key), list(key), "left_anti").select(*before.columns).unionByName(hit))
                stay = stay.join(done.select(*key), list(key), "left_anti").select(*stay.columns)
            else:
                stay, done = left, hit
        return stay, done

    def _upsert(self, t: Table, fresh: DataFrame, key: tuple[str, ...], action: dict[str, str], guard: str | None, alias: str, args: dict) -> tuple[DataFrame, DataFrame]:
        """The same for rows of which no two have one key."""
        new, old = f"__new_{uuid.uuid4().hex[:8]}", f"__old_{uuid.uuid4().hex[:8]}"
        rows = fresh
        fresh.toDF(*(f"__x_{c}" for c in fresh.columns)).createOrReplaceTempView(new)  # bare names mean the table's columns
        named = lambda text: re.sub(r"(?i)\bexcluded\.`?(\w+)`?", r"excluded.`__x_\1`", text)
        action, guard = {k: named(v) for k, v in action.items()}, guard and named(guard)
        t.df.createOrReplaceTempView(old)
        on = " AND ".join(f"`{alias}`.`{k}` = excluded.`__x_{k}`" for k in key)
        columns = ", ".join(f"CAST({action.get(c.name.lower(), f'`{alias}`.`{c.name}`')} AS {c.kind}) AS `{c.name}`" for c in t.stored if not c.generated)
        hit = self._sql(f"SELECT {columns} FROM {old} AS `{alias}` JOIN {new} AS excluded ON {on}" + (f" WHERE {guard}" if guard else ""), args)
        hit = self._pin(self._generated(t, hit))
        joined = t.df.join(fresh.select(*key), list(key), "left_semi") if not guard else self._sql(f"SELECT `{alias}`.* FROM {old} AS `{alias}` JOIN {new} AS excluded ON {on} WHERE {guard}", args)
        stay = t.df.join(joined.select(*key), list(key), "left_anti").select(*t.df.columns)
        fresh = fresh.join(t.df.select(*key), list(key), "left_anti").select(*rows.columns)
        return stay, self._pin(fresh.unionByName(hit))

    def _chosen(self, t: Table, alias: str, where: str, order: str, args: dict, source: str = "") -> DataFrame:
        """Rows of t with their number ``__rid`` that a change is about."""
        view = f"__rows_{uuid.uuid4().hex[:8]}"
        self._numbered(t).createOrReplaceTempView(view)
        return self._sql(f"SELECT `{alias}`.__rid FROM {view} AS `{alias}`{source}" + (f" WHERE {where}" if where else "") + (f" {order}" if order else ""), args)

    def _numbered(self, t: Table) -> DataFrame:
        return self._all(t).withColumn("__rid", F.monotonically_increasing_id())

    def _all(self, t: Table) -> DataFrame:
        df = t.df
        for c in t.columns:
            if c.generated and not c.stored:
                df = df.withColumn(c.name, F.expr(c.generated).cast(c.kind))
        return df

    def _update(self, r: _Reader, args: dict, once: bool = False) -> DataFrame | None:
        """once: no row may meet several rows of the source."""
        r.take()
        policy = r.take().upper if r.word("OR") else "ABORT"
        name = r.name()
        alias = r.name() if r.word("AS") else name
        r.need("SET")
        sets = self._assignments(r.until("FROM", "WHERE", "RETURNING", "ORDER", "LIMIT"))
        source = ", " + self.text(r.until("WHERE", "RETURNING", "ORDER", "LIMIT")) if r.word("FROM") else ""
        where = self.text(r.until("RETURNING", "ORDER", "LIMIT")) if r.word("WHERE") else ""
        order = self.text(r.until("RETURNING")) if r.peek() in ("ORDER", "LIMIT") else ""
        if name.lower() in self.now.views:
            names = self.spark.table(name).columns
            values = ", ".join(f"{sets.get(c.lower(), f'`{c}`')} AS `{c}`, `{c}` AS `__old_{c}`" for c in names)
            return self._instead(name, "UPDATE", self._sql(f"SELECT {values} FROM {name}" + (f" WHERE {where}" if where else ""), args), pair=True)
        t = self._settle(self.table(name))
        view = f"__rows_{uuid.uuid4().hex[:8]}"
        self._numbered(t).createOrReplaceTempView(view)
        values = ", ".join(f"CAST({sets.get(c.name.lower(), f'`{alias}`.`{c.name}`')} AS {c.kind}) AS `{c.name}`" for c in t.stored if not c.generated)
        before = ", ".join(f"`{alias}`.`{c.name}` AS `__old_{c.name}`" for c in t.stored)
        key = f"`{alias}`.docid, " if t.fulltext else ""
        changed = self._sql(f"SELECT `{alias}`.__rid, {key}{values}, {before} FROM {view} AS `{alias}`{source}" + (f" WHERE {where}" if where else ""), args)
        if source:
            changed = self._pin(changed)
            single = changed.dropDuplicates(["__rid"])
            if once and changed.count() != single.count():
                raise _Repeated
            changed = single
        if order:
            changed = changed.join(self._chosen(t, alias, where, order, args, source), "__rid", "left_semi")
        changed = self._pin(changed)
        new = changed
        for c in t.stored:
            if c.generated:
                new = new.withColumn(c.name, F.expr(c.generated).cast(c.kind))
        after = new.select(*t.df.columns)
        old = changed.select(*(F.col(f"`__old_{c.name}`").alias(c.name) for c in t.stored))
        event = (t, after, old, set(sets))
        self._fire("BEFORE", "UPDATE", t, after, old, set(sets), new)
        stay = self._numbered(t).join(changed.select("__rid"), "__rid", "left_anti").select(*t.df.columns)
        if policy == "IGNORE":  # rows that a constraint refuses stay as they were
            numbered = new.select("__rid", *t.df.columns)
            kept = numbered.where(self._fine(t, numbered))
            for k in t.keys():
                first = kept.withColumn("__n", F.row_number().over(Window.partitionBy(*k).orderBy("__rid")))
                others = self._numbered(t).join(kept.select(F.col("__rid").alias("__own"), *(F.col(f"`{c}`").alias(f"__k{n}") for n, c in enumerate(k))), functools.reduce(lambda a, b: a & b, (F.col(f"`{c}`") == F.col(f"__k{n}") for n, c in enumerate(k))) & (F.col("__rid") != F.col("__own"))).select(F.col("__own").alias("__rid"))
                null = functools.reduce(lambda a, b: a | b, (F.col(f"`{c}`").isNull() for c in k))
                kept = first.where((F.col("__n") == 1) | null).drop("__n").join(others, "__rid", "left_anti")
            kept = self._pin(kept)
            new = new.join(kept.select("__rid"), "__rid", "left_semi")
            changed = changed.join(kept.select("__rid"), "__rid", "left_semi")
            after, old = new.select(*t.df.columns), changed.select(*(F.col(f"`__old_{c.name}`").alias(c.name) for c in t.stored))
            stay = self._numbered(t).join(kept.select("__rid"), "__rid", "left_anti").select(*t.df.columns)
            event = (t, after, old, set(sets))
        if policy == "REPLACE":
            for k in t.keys():
                stay = stay.join(after.select(*k), list(k), "left_anti").select(*t.df.columns)
        made = t.with_rows(stay.unionByName(after))
        self._check(made, made.df, after, stay)
        self._put(made)
        self._cascade_update(made, new)
        self._count(after)
        changed_rows = self.changed
        self._fire("AFTER", "UPDATE", event[0], after, old, set(sets), new)
        self.changed = changed_rows
        return self._returning(r, t, after, args)

    def _settle(self, t: Table) -> Table:
        """Rows are numbered by their place, so they must be read from one place: files, ours or those that a plan only reads, filters and projects."""
        if not t.settled and not self._in_place(t.df):
            self._put(replace(t, writes=MOST_WRITES))
        return self.table(t.name)

    def _in_place(self, df: DataFrame) -> bool:
        plan = df._jdf.queryExecution().optimizedPlan()
        names = {m[1] for line in plan.toString().splitlines() if (m := re.match(r"[\s:+|-]*(\w+)", line))}
        return plan.deterministic() and names <= {"Relation", "Project", "Filter", "LocalRelation", "LogicalRDD", "OneRowRelation"}

    def _delete(self, r: _Reader, args: dict, source: str = "") -> DataFrame | None:
        """source: a further table that the condition may name."""
        r.need("DELETE", "FROM")
        name = r.name()
        alias = r.name() if r.word("AS") else name
        where = self.text(r.until("RETURNING", "ORDER", "LIMIT")) if r.word("WHERE") else ""
        order = self.text(r.until("RETURNING")) if r.peek() in ("ORDER", "LIMIT") else ""
        if name.lower() in self.now.views:
            return self._instead(name, "DELETE", old=self._sql(f"SELECT * FROM {name}" + (f" WHERE {where}" if where else ""), args))
        t = self._settle(self.table(name))
        chosen = self._pin(self._chosen(t, alias, where, order, args, f", {source}" if source else "").distinct())
        gone = self._pin(self._numbered(t).join(chosen, "__rid", "left_semi").select(*t.df.columns))
        self._fire("BEFORE", "DELETE", t, None, gone)
        self._put(t.with_rows(self._numbered(t).join(chosen, "__rid", "left_anti").select(*t.df.columns)))
        self._cascade_delete(self.table(name), gone)
        self._count(gone)
        changed = self.changed
        self._fire("AFTER", "DELETE", t, None, gone)
        self.changed = changed
        return self._returning(r, t, gone, args)

    # --- constraints

    def _check(self, t: Table, rows: DataFrame, touched: DataFrame | None = None, rest: DataFrame | None = None) -> None:
        """rows: all of the table's; touched: those that are new, and rest, all others, if they're known."""
        some = rows if touched is None else touched
        for c in t.columns:
            if c.not_null and not some.where(F.col(f"`{c.name}`").isNull()).isEmpty():
                raise ConstraintError("NOT NULL", f"{t.name}.{c.name}")
        if t.key and (t.without_rowid or len(t.key) > 1):
            for k in t.key:
                if t.without_rowid and not some.where(F.col(f"`{k}`").isNull()).isEmpty():
                    raise ConstraintError("NOT NULL", f"{t.name}.{k}")
        for check in t.checks:
            if not self._all(replace(t, df=some)).where(f"NOT ({check})").isEmpty():
                raise ConstraintError("CHECK", check)
        if rest is None:
            self._check_unique(t, rows)
        else:
            self._check_unique(t, touched)
            for key in t.keys():  # what is new against the rest; only keys travel
                if not rest.select(*key).join(touched.select(*key), list(key), "left_semi").isEmpty():
                    raise ConstraintError("UNIQUE", f"{t.name}({', '.join(key)})")
        if self.settings.get("foreign_keys", 1):
            for f in t.foreign:
                if not (f.deferred and self.saved) and not self._orphans(t, f, some).isEmpty():
                    raise ConstraintError("FOREIGN KEY", f"{t.name}({', '.join(f.columns)}) refers to no row of {f.table}")

    def _check_unique(self, t: Table, rows: DataFrame) -> None:
        for key in t.keys():
            full = rows
            for k in key:
                full = full.where(F.col(f"`{k}`").isNotNull())
            if not full.groupBy(*key).count().where("count > 1").isEmpty():
                raise ConstraintError("UNIQUE", f"{t.name}({', '.join(key)})")

    def _orphans(self, t: Table, f: ForeignKey, rows: DataFrame) -> DataFrame:
        parent = rows if f.table.lower() == t.name.lower() else self.now.tables[f.table.lower()].df if f.table.lower() in self.now.tables else None
        child = rows.select(*(F.col(c).alias(f"__{k}") for k, c in enumerate(f.columns))).where(" AND ".join(f"__{k} IS NOT NULL" for k in range(len(f.columns))))
        if parent is None:
            return child
        if f.table.lower() == t.name.lower():
            parent = parent.unionByName(self.now.tables[t.name.lower()].df) if t.name.lower() in self.now.tables else parent
        return child.join(parent.select(*(F.col(c).alias(f"__{k}") for k, c in enumerate(f.targets))), [f"__{k}" for k in range(len(f.columns))], "left_anti")

    def _children(self, parent: Table) -> Iterator[tuple[Table, ForeignKey]]:
        if self.settings.get("foreign_keys", 1):
            for t in list(self.now.tables.values()):
                for f in t.foreign:
                    if f.table.lower() == parent.name.lower():
                        yield self.now.tables[t.name.lower()], f

    def _cascade_delete(self, parent: Table, gone: DataFrame) -> None:
        for child, f in self._children(parent):
            keys = gone.select(*(F.col(p).alias(f"__k{n}") for n, p in enumerate(f.targets))).join(self.table(parent.name).df.select(*(F.col(p).alias(f"__k{n}") for n, p in enumerate(f.targets))), [f"__k{n}" for n in range(len(f.targets))], "left_anti").distinct()
            on = functools.reduce(lambda a, b: a & b, (F.col(f"`{c}`") == F.col(f"__k{n}") for n, c in enumerate(f.columns)))
            hit = self._pin(child.df.join(keys, on, "left_semi"))
            if hit.isEmpty():
                continue
            stay = child.df.join(keys, on, "left_anti")
            if f.on_delete == "NO ACTION" and f.deferred and self.saved:
                continue
            if f.on_delete in ("RESTRICT", "NO ACTION"):
                raise ConstraintError("FOREIGN KEY", f"rows of {child.name} refer to what is deleted from {parent.name}")
            if f.on_delete == "CASCADE":
                self._put(child.with_rows(stay))
                self._cascade_delete(self.table(child.name), hit)
                continue
            self._put_changed(child, f, stay, hit, f.on_delete)

    def _put_changed(self, child: Table, f: ForeignKey, stay: DataFrame, hit: DataFrame, action: str) -> None:
        new = hit
        for c in f.columns:
            column = child.column(c)
            new = new.withColumn(c, F.expr(column.default).cast(column.kind) if action == "SET DEFAULT" and column.default else F.lit(None).cast(column.kind))
        made = child.with_rows(stay.unionByName(self._generated(child, new)))
        self._check(made, made.df, new)
        self._put(made)

    def _cascade_update(self, parent: Table, moved: DataFrame) -> None:
        """moved: new values and, as __old_*, those before."""
        for child, f in self._children(parent):
            differ = functools.reduce(lambda a, b: a | b, (~F.col(f"`{p}`").eqNullSafe(F.col(f"`__old_{p}`")) for p in f.targets))
            keys = moved.where(differ).select(*(F.col(f"`__old_{p}`").alias(f"__k{n}") for n, p in enumerate(f.targets)), *(F.col(f"`{p}`").alias(f"__v{n}") for n, p in enumerate(f.targets))).dropDuplicates([f"__k{n}" for n in range(len(f.targets))])
            on = functools.reduce(lambda a, b: a & b, (F.col(f"`{c}`") == F.col(f"__k{n}") for n, c in enumerate(f.columns)))
            hit = self._pin(child.df.join(keys, on))
            if hit.isEmpty():
                continue
            stay = child.df.join(keys, on, "left_anti")
            if f.on_update == "NO ACTION" and f.deferred and self.saved:
                continue
            if f.on_update in ("RESTRICT", "NO ACTION"):
                raise ConstraintError("FOREIGN KEY", f"rows of {child.name} refer to what is changed in {parent.name}")
            if f.on_update == "CASCADE":
                new = hit
                for n, c in enumerate(f.columns):
                    new = new.withColumn(f"__old_{c}", F.col(c)).withColumn(c, F.col(f"__v{n}"))
                made = child.with_rows(stay.unionByName(self._generated(child, new)))
                self._check_unique(made, made.df)
                self._put(made)
                for c in child.stored:
                    if c.name not in f.columns:
                        new = new.withColumn(f"__old_{c.name}", F.col(f"`{c.name}`"))
                self._cascade_update(self.table(child.name), new)
            else:
                self._put_changed(child, f, stay, hit.select(*child.df.columns), f.on_update)

    # --- triggers

    def _fire(self, time: str, event: str, t: Table, new: DataFrame | None, old: DataFrame | None, sets: set[str] = frozenset(), pair: DataFrame | None = None) -> None:
        for trigger in list(self.now.triggers.values()):
            if trigger.table == t.name.lower() and trigger.time == time and trigger.event == event and (not trigger.columns or {c.lower() for c in trigger.columns} & sets):
                delta = self._delta(new, old, pair)
                self._run_trigger(trigger, delta)

    def _delta(self, new: DataFrame | None, old: DataFrame | None, pair: DataFrame | None) -> DataFrame:
        """A row for each row that changes: its columns as new_* and old_*."""
        if pair is not None:
            names = [c for c in pair.columns if not c.startswith("__")]
            return pair.select(*(F.col(f"`{c}`").alias(f"new_{c}") for c in names), *(F.col(f"`__old_{c}`").alias(f"old_{c}") for c in names if f"__old_{c}" in pair.columns))
        one, prefix = (new, "new") if new is not None else (old, "old")
        return one.toDF(*(f"{prefix}_{c}" for c in one.columns))

    def _run_trigger(self, trigger: Trigger, delta: DataFrame) -> None:
        def moved(tokens) -> list[Token]:
            out, k = [], 0
            while k < len(tokens):
                if tokens[k].upper in ("NEW", "OLD") and k + 2 < len(tokens) and tokens[k + 1].text == ".":
                    out.append(Token("word", f"{tokens[k].text.lower()}_{name_of(tokens[k + 2])}"))
                    k += 3
                else:
                    out.append(tokens[k])
                    k += 1
            return out

        if trigger.when is not None:
            delta = delta.where(self.text(moved(trigger.when)))
        view = f"__delta_{uuid.uuid4().hex[:8]}"
        delta.createOrReplaceTempView(view)
        for statement in trigger.body:
            refers = any(x.upper in ("NEW", "OLD") for x in statement)
            words = [x.upper for x in statement]
            if words[0] == "SELECT" and "RAISE" in words:
                if not delta.isEmpty():
                    at = words.index("RAISE")
                    if words[at + 2] == "IGNORE":
                        continue
                    raise ConstraintError("TRIGGER", statement[at + 4].text.strip("'"))
            elif words[0] in ("INSERT", "REPLACE") and "VALUES" in words and refers:
                at = words.index("VALUES")
                rows = [p for p in split(list(statement[at + 1 :]))]
                for row in rows:  # one set-based insert of all rows that fired
                    values = " , ".join(" ".join(x.text for x in v) for v in split(moved(row[1:-1])))
                    self._change(_Reader([*statement[:at], *tokenize(f"SELECT {values} FROM {view}")]), {})
            elif not refers:
                for _ in range(delta.count()):
                    self._statement(list(statement), {})
            elif words[0] in ("UPDATE", "DELETE") and self._at_once(moved(statement), words[0], view):
                continue
            else:  # each row in turn, since a later one may see what an earlier one did
                for row in delta.toLocalIterator():
                    values = row.asDict()
                    filled = [y for x in moved(statement) for y in (tokenize(_sql_literal(values[x.text])) if x.kind == "word" and x.text in values else [x])]
                    self._statement(filled, {})

    def _at_once(self, statement: list[Token], kind: str, view: str) -> bool:
        """An UPDATE or DELETE for all rows that fired, as a join with them; not where one row would be changed twice, or where the statement has a source or an end of its own."""
        ups = [t.upper for t in statement]
        if {"FROM", "ORDER", "LIMIT", "RETURNING"} & set(ups[2:] if kind == "DELETE" else ups) - ({"FROM"} if kind == "DELETE" and ups.count("FROM") == 1 else set()):
            return False
        before = self.now.copy()
        try:
            if kind == "DELETE":
                self.depth += 1
                try:
                    self._delete(_Reader(statement), {}, view)
                finally:
                    self.depth -= 1
            else:
                at = ups.index("WHERE") if "WHERE" in ups else len(ups)
                self.depth += 1
                try:
                    self._update(_Reader([*statement[:at], Token("word", "FROM"), Token("word", view), *statement[at:]]), {}, once=True)
                finally:
                    self.depth -= 1
        except (_Repeated, AnalysisException):
            self._restore(before)
            return False
        return True

    def _instead(self, view: str, event: str, new: DataFrame | None = None, old: DataFrame | None = None, pair: bool = False) -> None:
        """pair: ``new`` also has the old values, as __old_*."""
        found = [t for t in self.now.triggers.values() if t.table == view.lower() and t.time == "INSTEAD OF" and t.event == event]
        if not found:
            raise EngineError(f"{view} is a view without a trigger INSTEAD OF {event}")
        delta = self._pin(self._delta(new, old, new if pair else None))
        self.changed = delta.count()
        for t in found:
            self._run_trigger(t, delta)


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"
