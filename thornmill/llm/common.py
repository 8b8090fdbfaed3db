"""What the operators share: tables, the folder that all executors see, words."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Bytes that end a word; the same six as bytes.split() without arguments uses.
SEPARATORS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors see.

    Where the setting is absent, a single machine (tests) gets a folder of its own; a cluster,
    whose machines don't share one, is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("THORNMILL_SHARED")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.environ["THORNMILL_SHARED"] = "file://" + tempfile.mkdtemp(prefix="thornmill-")
    path = f"{base.rstrip('/')}/thornmill/{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort at the end of the driver; the folder is only scratch."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def extended(df: DataFrame, *more: tuple[str, str]) -> StructType:
    """The schema of df with columns (name, type) after its own; types that are long to spell out stay whole."""
    return StructType([*df.schema.fields, *(StructField(name, _parse_datatype_string(kind)) for name, kind in more)])


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on, so that no name can clash with an operator's own."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


#: Bits of the maps of members that the driver hands to the executors (2 MB), whatever the data.
FILTER_BITS = 1 << 24


def membership(rows: DataFrame, column: str) -> np.ndarray:
    """A bitmap that holds every value of a column of 64-bit digests, made by the executors; others are in it by chance."""
    slots = rows.selectExpr(f"{column} & {FILTER_BITS // 64 - 1} AS at", f"shiftleft(1L, cast(shiftright({column}, 40) & 63 AS int)) AS bit")
    words = np.zeros(FILTER_BITS // 64, np.int64)
    found = slots.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    words[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return words


def present(words: np.ndarray, digest: int) -> int:
    return int(words[digest & (FILTER_BITS // 64 - 1)]) >> ((digest >> 40) & 63) & 1


#: What operators keep from task to task in a Python worker, and how to let go of it.
HELD: dict[str, Callable[[], None]] = {}
_INSIDE = [""]


def enter(operator: str) -> None:
    """A worker serves one operator after another: at each change, what the others keep goes, and freed memory goes back to the system."""
    if operator == _INSIDE[0]:
        return
    _INSIDE[0] = operator
    for name, drop in HELD.items():
        if name != operator:
            drop()
    gc.collect()
    settle()


def settle() -> None:
    """Freed memory goes back to the system: workers that wait for a task beside those at work shouldn't hold any."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8 << 20, operator: str = "") -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts hold about ``most`` bytes, so that long texts don't add up in memory."""
    enter(operator)
    for batch in batches:
        rows = batch.num_rows
        size = max(1, batch.column(batch.schema.get_field_index(text)).nbytes) if rows else 1
        step = max(1, min(rows, rows * most // size)) if rows else 1
        for at in range(0, rows, step):
            yield batch.slice(at, step)
    settle()


class Kept(dict):
    """What ``make`` gives for a key, in about ``most`` bytes; ``weigh`` tells those of an entry, its place in the table included.

    Two generations: when the young one is half of that, it becomes the old one, and what
    is asked for again moves over, so that frequent keys stay. An entry of more than ``heaviest`` bytes
    isn't kept at all.
    """

    def __init__(self, make: Callable, most: int, weigh: Callable, heaviest: int = 2_048) -> None:
        self.make, self.half, self.weigh, self.heaviest, self.old, self.size = make, most // 2, weigh, heaviest, {}, 0

    def __missing__(self, key):
        found = self.old.pop(key, None)
        if found is None:
            found = self.make(key)
        weight = self.weigh(key, found)
        if weight > self.heaviest:
            return found
        self.size += weight
        if self.size > self.half:
            self.old = dict(self)
            self.clear()
            self.size = weight
        self[key] = found
        return found
