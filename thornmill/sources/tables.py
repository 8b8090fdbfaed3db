"""Table functions: series of numbers, and the elements of JSON texts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENT = "key string, value string, type string, atom string, id long, parent long, fullkey string, path string"


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """start, start + step, ... up to stop (included), one partitioned range."""
    if step == 0:
        raise ValueError("a series needs a step other than 0")
    return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", "value")


def _kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    return {int: "integer", float: "real", str: "text", list: "array", dict: "object"}[type(v)]


def _shown(v) -> str | None:
    if isinstance(v, (list, dict)):
        return json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    if isinstance(v, bool):
        return "1" if v else "0"
    return None if v is None else str(v)


def elements(text: str | None, deep: bool) -> Iterator[tuple]:
    """Rows of ELEMENT: the members of the outermost value, or (deep) every value from the outermost on."""
    try:
        root = json.loads(text) if text is not None else None
    except ValueError:
        return
    if text is None:
        return
    count = iter(range(1 << 62))

    def row(key, value, parent, full, path):
        me = next(count)
        shown = _shown(value)
        return me, (None if key is None else str(key), shown, _kind(value), None if isinstance(value, (list, dict)) else shown, me, parent, full, path)

    def members(value, full):
        pairs = value.items() if isinstance(value, dict) else enumerate(value)
        for k, v in pairs:
            yield k, v, f"{full}.{k}" if isinstance(value, dict) else f"{full}[{k}]"

    def walk(key, value, parent, full, path):
        me, out = row(key, value, parent, full, path)
        yield out
        if isinstance(value, (list, dict)):
            for k, v, at in members(value, full):
                yield from walk(k, v, me, at, full)

    if deep:
        yield from walk(None, root, None, "$", "$")
    elif isinstance(root, (list, dict)):
        next(count)
        for k, v, at in members(root, "$"):
            yield row(k, v, None, at, "$")[1]
    else:
        yield row(None, root, None, "$", "$")[1]


def json_rows(rows: DataFrame, column: str, deep: bool = False) -> DataFrame:
    """Each row of ``rows`` with each element of its JSON text; rows whose text is null or malformed give none."""
    fields = rows.schema.fields
    at = rows.columns.index(column)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), ELEMENT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()] * 2
        for batch in batches:
            index, found = [], [[] for _ in kinds]
            for k, text in enumerate(batch.column(at).to_pylist()):
                for element in elements(text, deep):
                    index.append(k)
                    for out, value in zip(found, element, strict=True):
                        out.append(value)
            kept = batch.take(pa.array(index, pa.int64()))
            names = [x.split()[0] for x in ELEMENT.split(", ")]
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(f, k) for f, k in zip(found, kinds, strict=True))], [*batch.schema.names, *names])

    return rows.mapInArrow(run, schema)


def register_elements(spark: SparkSession) -> None:
    """tm_json_each and tm_json_tree: the elements of a JSON text as an array of rows, for use in FROM. In Python, because a variant sorts an object's keys."""
    kind = f"array<struct<{ELEMENT.replace(' ', ':').replace(',:', ',')}>>"
    for name, deep in (("tm_json_each", False), ("tm_json_tree", True)):
        spark.udf.register(name, F.udf(lambda text, deep=deep: list(elements(text, deep)), kind, useArrow=True))
