"""Sharding by extendible hashing, in DataFrame operations alone.

The directory is indexed by the leading bits of a row's hash. Bytes are summed for each cell
of the deepest level in one aggregation; cells are then added up bit by bit, as long as any sum
fits. A sum that fits while the one above it doesn't is a bucket: only buckets that are too large
are split, one bit at a time, and a single pass settles all bits of a level. Cells that are still too large
go through another pass on the next bits; after the bits of the content's hash come those
of a hash of the row's place, which part rows that are equal in all they have.

Defined results: null text has 0 bytes; a single row above the limit is a shard by itself,
marked ``oversize``, however long its text; null ids and repeated rows are kept, a shard for each row; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bits of a pass, and of the largest directory that is broadcast (at most 65,536 rows of some 30 bytes).
MOST_BITS, BROADCAST_BITS = 24, 16
LIMIT = 16 << 20


def assign(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, shard (the bits of its prefix), shard_bytes, oversize of each row; no shard of two rows or more holds over ``limit`` bytes."""
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
            F.xxhash64(id_col, text_col).alias("h"),
        ).withColumn("place", F.xxhash64("h", F.monotonically_increasing_id()))
    ).withColumn("bits", F.concat(F.lpad(F.bin("h"), 64, "0"), F.lpad(F.bin("place"), 64, "0")))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    left, done, settled = rows.withColumn("from", F.lit(0)), [], 0
    while True:
        depth = min(MOST_BITS, 128 - settled, max(8, math.ceil(math.log2(max(2, total / limit))) + 4)) if settled == 0 else min(8, 128 - settled)
        prefix, cell = F.substring("bits", 1, settled), F.substring("bits", settled + 1, depth)
        cells = cut(left.groupBy(prefix.alias("prefix"), cell.alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")))
        directory, below = None, cells.select("prefix", F.col("cell").alias("start"), "bytes", "n")
        for level in range(depth, -1, -1):
            fits = (F.col("bytes") <= limit) | (F.col("n") == 1)
            below = below.withColumn("above", F.expr(f"substring(start, 1, {max(0, level - 1)})"))
            above = cut(below.groupBy("prefix", "above").agg(F.sum("bytes").alias("all_bytes"), F.sum("n").alias("all_n"))) if level else None
            if level:
                kept = ~((F.col("all_bytes") <= limit) | (F.col("all_n") == 1))
                buckets = below.where(fits).join(above.where(kept), ["prefix", "above"])
            else:
                buckets = below.where(fits)
            buckets = buckets.select(F.col("prefix").alias("of"), "start", F.col("bytes").alias("shard_bytes"))
            named = cells.join(buckets, (F.col("prefix") == F.col("of")) & (F.expr(f"substring(cell, 1, {level})") == F.col("start"))).select("prefix", "cell", "start", "shard_bytes")
            directory = named if directory is None else directory.unionByName(named)
            if not level or below.where(fits).isEmpty():
                break
            below = above.select("prefix", F.col("above").alias("start"), F.col("all_bytes").alias("bytes"), F.col("all_n").alias("n"))
        directory = cut(directory)
        small = settled + depth <= BROADCAST_BITS or directory.count() <= 1 << BROADCAST_BITS
        directory = directory.toDF("p", "c", "start", "shard_bytes")
        matched = left.join(F.broadcast(directory) if small else directory, (prefix == F.col("p")) & (cell == F.col("c")), "left")
        last = settled + depth >= 128
        found = matched if last else matched.where("shard_bytes IS NOT NULL")
        shard = F.concat(prefix, F.coalesce("start", cell))
        done.append(found.select("doc_id", "n_bytes", shard.alias("shard"), F.coalesce("shard_bytes", "n_bytes").alias("shard_bytes")))
        fitting = directory.select("p", "c")
        over = cells.join(fitting, (F.col("prefix") == F.col("p")) & (F.col("cell") == F.col("c")), "left_anti")
        if last or over.isEmpty():
            break
        left = cut(matched.where("shard_bytes IS NULL").select("doc_id", "n_bytes", "h", "place", "bits", "from"))
        settled += depth
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("oversize", F.col("shard_bytes") > limit)
