"""How queries are registered: a name, what Spark runs, and the SQL that it is held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

Query = Callable[[SparkSession, str], DataFrame]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _filled(text: str, place: Callable[[str], str]) -> str:
    return re.sub(r"\{(" + "|".join(TABLES) + r")\}", lambda m: place(m[1]), text)


def sql(text: str) -> Query:
    """A query in Spark's SQL; {table} stands for a table's files, so Catalyst prunes columns and pushes filters to the scan."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(_filled(text, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))

    return run


class Family:
    """Queries and oracles of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def same(self, name: str, text: str) -> None:
        """One text that both engines read alike."""
        self.queries[name] = sql(text)
        self.oracles[name] = _filled(text, lambda t: t)

    def both(self, name: str, spark_text: str, oracle: str) -> None:
        self.queries[name] = sql(spark_text)
        self.oracles[name] = oracle

    def code(self, name: str, oracle: str | None = None):
        def put(run: Query) -> Query:
            self.queries[name] = run
            if oracle:
                self.oracles[name] = oracle
            return run

        return put
