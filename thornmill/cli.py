"""A small shell: statements end in a semicolon, commands begin with a dot. ``python -m thornmill.cli``."""

from __future__ import annotations

import sys
import time
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import SparkSession

from .errors import EngineError
from .session import Engine
from .sources.sinks import lines

HELP = """.tables  .schema [T]  .indexes  .mode list|column|csv|json|box|markdown|insert  .headers on|off  .separator S
.nullvalue S  .import FILE T (CSV)  .output [FILE]  .read FILE  .save DIR  .open DIR  .dump [T]  .changes on|off  .echo on|off  .timer on|off  .databases  .show  .help  .quit"""


class Shell:
    def __init__(self, engine: Engine, out=sys.stdout) -> None:
        self.engine, self.out, self.screen = engine, out, out
        self.mode, self.headers, self.separator, self.null, self.echo, self.changes, self.timer = "list", False, "|", "", False, False, False

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def run(self, lines: Iterable[str]) -> None:
        held = ""
        for line in lines:
            if not held and line.lstrip().startswith("."):
                if self.command(line.strip()) is False:
                    return
                continue
            held += line
            if held.rstrip().endswith(";"):
                self.statement(held)
                held = ""
        if held.strip():
            self.statement(held)

    def statement(self, sql: str) -> None:
        if self.echo:
            self.say(sql.rstrip())
        began = time.time()
        try:
            for df in self.engine.script(sql):
                if df is not None:
                    for line in lines(df.columns, df.toLocalIterator(), self.mode, self.headers, self.separator, self.null):
                        self.say(line)
            if self.timer:
                self.say(f"Run Time: real {time.time() - began:.3f}")
            if self.changes:
                self.say(f"changes: {self.engine.changed}   total_changes: {self.engine.changes_total}")
        except (EngineError, ValueError) as error:
            self.say(f"Error: {error}")
        except Exception as error:  # Spark's own analysis errors are long
            self.say(f"Error: {str(error).splitlines()[0]}")

    def command(self, line: str) -> bool | None:
        name, *args = line[1:].split()
        flag = bool(args) and args[0].lower() == "on"
        now, spark = self.engine.now, self.engine.spark
        if name in ("quit", "exit"):
            return False
        if name == "help":
            self.say(HELP)
        elif name == "tables":
            self.say("\n".join(sorted([*(t.name for t in now.tables.values()), *now.views])))
        elif name in ("schema", "indexes"):
            rows = self.engine.schema_objects().collect()
            kinds = ("index",) if name == "indexes" else ("table", "view", "trigger", "index")
            self.say("\n".join(r.sql or f"-- {r.type} {r.name} ON {r.tbl_name}" for r in rows if r.type in kinds and (not args or r.tbl_name.lower() == args[0].lower())))
        elif name in ("mode", "separator", "nullvalue") and args:
            setattr(self, "null" if name == "nullvalue" else name, args[0])
        elif name in ("headers", "echo", "changes", "timer"):
            setattr(self, name, flag)
        elif name == "databases":
            self.say("\n".join(f"{r.name}: {r.file}" for r in self.engine.execute("PRAGMA database_list").collect()))
        elif name == "output":
            self.out = open(args[0], "w") if args else self.screen
        elif name == "read":
            with open(args[0]) as file:
                self.run(file)
        elif name == "save":
            self.engine.save(args[0])
        elif name == "open":
            for folder in sorted(Path(args[0]).iterdir()):
                self.engine.attach(folder.name, spark.read.parquet(str(folder)))
        elif name == "import":
            df = spark.read.csv(args[0], header=True, inferSchema=True)
            if args[1].lower() in now.tables:
                df.createOrReplaceTempView("__imported")
                self.engine.execute(f"INSERT INTO {args[1]} SELECT * FROM __imported")
            else:
                self.engine.attach(args[1], df)
        elif name == "dump":
            for t in list(now.tables.values()):
                if not args or t.name.lower() == args[0].lower():
                    self.say((t.sql or f"-- {t.name}") + ";")
                    for line in lines(t.df.columns, t.df.toLocalIterator(), "insert", table=t.name):
                        self.say(line)
        elif name == "show":
            self.say("\n".join(f"{k}: {getattr(self, k)}" for k in ("mode", "headers", "separator", "null", "echo", "changes")))
        else:
            self.say(f"unknown command: .{name}")
        return None


if __name__ == "__main__":
    session = SparkSession.builder.appName("thornmill").config("spark.ui.enabled", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    Shell(Engine(session)).run(sys.stdin)
