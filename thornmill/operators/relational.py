"""Range and as-of joins, NOT IN, joins by few keys, GROUPS frames and frames without the current row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def range_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point < high, by an equi-join on cells of ``width``: each span is repeated for the cells that it touches.

    Unlike a condition on inequalities alone (a nested loop over all pairs), this hashes; a width
    near the usual span keeps the repetition near one. Null bounds and points match nothing.
    """
    cell = "__cell"
    left = points.withColumn(cell, F.floor(F.col(point) / width))
    right = spans.where(F.col(low) < F.col(high)).withColumn(cell, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return left.join(right, cell).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop(cell)


def not_in(rows: DataFrame, column: str, others: DataFrame, other: str) -> DataFrame:
    """The rows whose ``column`` is NOT IN the ``other`` column of others, by SQL's logic of nulls.

    Spark's own plan for NOT IN broadcasts all of others. Here both sides are dealt out by the key, that of
    others once for each value, and only two truths come to the driver: whether others have rows, and whether
    they have a null. Nothing is outside of a set with a null; everything, null too, is outside of an empty one.
    """
    keys = others.select(F.col(f"`{other}`").alias("__key"))
    nulls = keys.agg(F.coalesce(F.max(F.col("__key").isNull().cast("int")), F.lit(-1)).alias("n")).first().n  # -1: no rows
    if nulls < 0:
        return rows
    kept = rows.where(F.col(f"`{column}`").isNotNull())
    return kept.where(F.lit(False)) if nulls else kept.join(keys.distinct(), F.col(f"`{column}`") == F.col("__key"), "left_anti")


#: Rows of a part of ``few_keys_join``, and pairs of a task.
PART, TASK_PAIRS = 2_048, 40_000_000


def few_keys_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left JOIN right USING (key) where few keys hold most of the rows: key, left's other columns, right's.

    Dealt out by the key alone, no more tasks work than there are keys. Here the rows that either side has of a key are
    cut into parts of about PART rows, and each part of left meets each of right's in a cell; cells are what is
    dealt out. A part is repeated for the other side's parts, which is little beside the pairs that come of it.
    Keys without that many rows are one cell. Null keys match nothing.
    """
    of = lambda df, n: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n))
    counts = of(left, "__l").join(of(right, "__r"), key)
    pairs = int(counts.agg(F.sum(F.col("__l").cast("double") * F.col("__r"))).first()[0] or 0)
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))
    large = F.broadcast(counts.where((F.col("__l") > PART) | (F.col("__r") > PART)))  # a row for PART rows at most
    parts = {n: F.coalesce(F.ceil(F.col(n) / PART), F.lit(1)) for n in ("__l", "__r")}

    def cells(df: DataFrame, own: str, other: str) -> DataFrame:
        rows = df.where(F.col(key).isNotNull()).withColumn("__at", F.xxhash64(F.monotonically_increasing_id())).join(large, key, "left")
        each = rows.withColumn(f"{own}p", F.pmod("__at", parts[own])).withColumn(f"{other}p", F.explode(F.sequence(F.lit(0).cast("long"), parts[other] - 1)))
        return each.drop("__at", "__l", "__r").repartition(tasks, key, "__lp", "__rp")

    return cells(left, "__l", "__r").join(cells(right, "__r", "__l"), [key, "__lp", "__rp"]).drop("__lp", "__rp")


def groups_window(rows: DataFrame, partition: list[str], order: list[str], first: int, last: int) -> tuple[DataFrame, WindowSpec]:
    """rows with a hidden peer number, and the window GROUPS BETWEEN first AND last: a range over the dense rank of the peers."""
    rank = F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order))
    return rows.withColumn("__peer", rank), Window.partitionBy(*partition).orderBy("__peer").rangeBetween(first, last)


def excluding_current(value: str, partition: list[str], order: list[str], first: int, last: int) -> tuple[Column, Column]:
    """(count, sum) over ROWS BETWEEN first AND last EXCLUDE CURRENT ROW: the frame's two sides, added up."""
    w = Window.partitionBy(*partition).orderBy(*order)
    sides = [w.rowsBetween(first, -1), w.rowsBetween(1, last)]
    count = sum((F.count("*").over(s) for s in sides[1:]), F.count("*").over(sides[0]))
    parts = [F.sum(value).over(s) for s in sides]
    total = F.when(parts[0].isNull() & parts[1].isNull(), F.lit(None)).otherwise(sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0))))
    return count, total


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with the ``values`` of right's latest row of the same ``on`` whose time isn't later, null without one.

    Both sides are one sorted stream for each key and a running last value: one shuffle, linear in the rows,
    and no pairs. Of right rows with one time, the one with the greatest values counts. Rows with null times or keys match nothing and, on the left, stay.
    """
    names = left.columns
    one = left.select(*(F.col(f"`{c}`").alias(f"l{k}") for k, c in enumerate(names)), *(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(on)), F.col(left_time).alias("t"), F.lit(1).alias("side"), F.lit(None).alias("v"))
    kept = right.where(F.col(right_time).isNotNull())
    for c in on:
        kept = kept.where(F.col(c).isNotNull())
    other = kept.select(*(F.lit(None).alias(f"l{k}") for k in range(len(names))), *(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(on)), F.col(right_time).alias("t"), F.lit(0).alias("side"), F.struct(*values).alias("v"))
    w = Window.partitionBy(*(f"k{n}" for n in range(len(on)))).orderBy("t", "side", "v").rowsBetween(Window.unboundedPreceding, 0)
    found = one.unionByName(other).withColumn("v", F.last("v", ignorenulls=True).over(w)).where("side = 1")
    return found.select(*(F.col(f"l{k}").alias(c) for k, c in enumerate(names)), *(F.col(f"v.`{c}`").alias(c) for c in values))
