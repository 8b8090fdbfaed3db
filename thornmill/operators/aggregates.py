"""Python aggregates whose parts can be put together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType, _parse_datatype_string

#: Groups that a task holds objects for, before it hands them on.
MOST = 50_000


def merged_aggregate(rows: DataFrame, keys: list[str], columns: list[str], cls: type, out: str, returns: str) -> DataFrame:
    """keys and ``out``: cls.final() of each group, by step() on its rows and merge(other) on objects.

    Each task has one object for each group that it meets, so a group of any size travels as one small, pickled object
    a task. Nulls go to step() as None.
    """
    kinds = rows.select(*keys).schema
    made = cloudpickle.dumps(cls)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held, types = cloudpickle.loads(made), {}, None

        def flush() -> pa.RecordBatch:
            lists = [pa.array([k[n] for k in held], types[n]) for n in range(len(keys))]
            packed = pa.array([cloudpickle.dumps(x) for x in held.values()], pa.binary())
            held.clear()
            return pa.RecordBatch.from_arrays([*lists, packed], [*keys, "part"])

        for batch in batches:
            types = [batch.column(n).type for n in range(len(keys))]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = row[: len(keys)]
                if key not in held:
                    held[key] = kind()
                held[key].step(*row[len(keys) :])
            if len(held) > MOST:
                yield flush()
        if held:
            yield flush()

    def merged(table: pa.Table) -> pa.Table:
        first, *others = (cloudpickle.loads(p) for p in table.column("part").to_pylist())
        for other in others:
            first.merge(other)
        return table.slice(0, 1).select(keys).append_column(out, pa.array([first.final()]))

    partial = rows.select(*keys, *columns).mapInArrow(steps, StructType([*kinds.fields, StructField("part", BinaryType())]))
    return partial.groupBy(*keys).applyInArrow(merged, StructType([*kinds.fields, StructField(out, _parse_datatype_string(returns))]))
