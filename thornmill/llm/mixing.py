"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree.

Sources share all words by weight; no source's target exceeds REPEATS times its size. Each
source is cut into up to BLOCKS blocks by a hash of its documents. A source's quota is a number of
blocks: all of them for each whole pass over the source that its target holds, and, of a
permutation of them, those that fill what is left. A binary tree over the output
shards then splits the quotas: at each node, the left half's share of every source is one
draw from the multivariate hypergeometric distribution, so all shards get equally many
blocks, each is a fair sample of the whole mix, and the quotas are used up exactly. The
shards' shares cut the source's permuted blocks into disjoint runs; within a shard, rows are
ordered by a keyed hash.

Only figures per source come to the driver (the names, sizes and quotas of what is mixed);
figures per document and per block stay distributed. All randomness is hashes and a seeded
generator, so reruns agree.

Defined results: an empty table gives no rows; texts of any length are counted whole; null text has size 0; null is a source of its own, after all others;
sources without words have target 0; repeated rows share a block and are drawn
together; null ids are kept; other columns pass through ``mixed`` untouched, whatever their names, and aren't
read by ``mix``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCKS = 4_096
#: Least number of shards, and words from which there are more, so that no shard holds much more than that.
SHARDS, SHARD_WORDS = 64, 16_000_000
#: Rows of the tables of sources and blocks that may be broadcast (some 180 bytes each).
BROADCAST_ROWS = 200_000
#: A word: what bytes.split() would give.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], repeats: int = REPEATS) -> list[float]:
    """Shares of the total by weight; what exceeds ``repeats`` times a size goes to the others by weight, until none does."""
    total, capped, found = sum(sizes), set(), [0.0] * len(sizes)
    while True:
        left = total - repeats * sum(sizes[k] for k in capped)
        by = sum(w for k, w in enumerate(weights) if k not in capped)
        found = [float(repeats * sizes[k]) if k in capped else left * w / by for k, w in enumerate(weights)]
        over = {k for k in range(len(sizes)) if k not in capped and found[k] > repeats * sizes[k]}
        if not over:
            return found
        capped |= over


def split_tree(quotas: list[int], shards: int, seed: int = 0) -> np.ndarray:
    """shards x sources: how many of each source's blocks a shard gets; rows differ by one block at most, columns sum up to the quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)
    work = [(0, shards, np.array(quotas, np.int64))]
    while work:
        first, end, left = work.pop()
        if end - first == 1:
            out[first] = left
            continue
        middle = (first + end) // 2
        share = int(left.sum()) * (middle - first) // (end - first)
        part = np.random.default_rng([seed, first, end]).multivariate_hypergeometric(left, share, method="marginals") if share else np.zeros_like(left)
        work += [(first, middle, part), (middle, end, left - part)]
    return out


def _draw(plan: dict[int, tuple[float, int]], seed: int):
    """The blocks of one source (BLOCKS rows at most) -> how often each is drawn and the places of these draws in the source's sequence."""

    def run(table: pa.Table) -> pa.Table:
        source, block, size = (table.column(c).to_numpy() for c in ("source_id", "block", "size"))
        target, total = plan[int(source[0])]
        order = np.random.default_rng([seed, int(source[0])]).permutation(np.argsort(block))
        passes = min(REPEATS, int(target // total)) if total else 0
        left, extra = target - passes * total, []
        if passes < REPEATS:
            for k in order:
                if 0 < size[k] <= left:
                    extra.append(k)
                    left -= size[k]
            drawn = set(extra)
            rest = [k for k in order if size[k] > left and k not in drawn] if left > 0 else []
            if rest and size[best := min(rest, key=lambda k: size[k])] < 2 * left:  # one more comes nearer than one less
                extra.append(best)
        places = [[] for _ in block]
        for at, k in enumerate([*np.tile(order, passes), *extra]):
            places[k].append(at)
        return pa.table({"source_id": source, "block": block, "places": pa.array(places, pa.list_(pa.int64()))})

    return run


def _shards(cuts: np.ndarray):
    """Places in a source's sequence -> the shards whose run they're in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.searchsorted(cuts[:, s], p, "right").tolist() for s, p in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["source_id", "block", "shards"])

    return run


def _blocks(docs: DataFrame, weights, shards: int | None, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(a row per document: key, size, source; a row per source; a row per block with its shards; how many shards)."""
    spark = docs.sparkSession
    light = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.xxhash64(F.lit(seed), id_col, text_col).alias("key")))
    found = light.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy(F.asc_nulls_last("source")).collect()
    sizes = [r["size"] for r in found]
    shards = shards or max(SHARDS, -(-sum(sizes) // SHARD_WORDS))
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(found))]) if found else []
    rows = [(k, r["source"], r["size"], goal[k], min(BLOCKS, r["n"])) for k, r in enumerate(found)]
    sources = spark.createDataFrame(rows, "source_id int, of string, source_size long, target double, blocks int")
    if len(rows) <= BROADCAST_ROWS:
        sources = F.broadcast(sources)
    light = light.join(sources, light.source.eqNullSafe(sources.of)).withColumn("block", F.expr("cast(pmod(key, blocks) AS int)"))
    drawn = cut(
        light.groupBy("source_id", "block").agg(F.sum("size").alias("size")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source_id").groupBy("source_id").applyInArrow(_draw({k: (goal[k], sizes[k]) for k in range(len(rows))}, seed), "source_id int, block int, places array<long>")
    )
    counts = {r.source_id: r.n for r in drawn.groupBy("source_id").agg(F.sum(F.size("places")).alias("n")).collect()}
    cuts = np.cumsum(split_tree([counts.get(k, 0) for k in range(len(rows))], shards, seed), axis=0) if rows else np.zeros((shards, 0), np.int64)
    blocks = drawn.mapInArrow(_shards(cuts), "source_id int, block int, shards array<int>")
    if sum(r[4] for r in rows) <= BROADCAST_ROWS:
        blocks = F.broadcast(blocks)
    return light, sources, blocks, shards


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, shards: int | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken and shards (one for each copy that is drawn) of each row."""
    light, _, blocks, _ = _blocks(docs, weights, shards, seed, id_col, text_col, source_col)
    return light.join(blocks, ["source_id", "block"]).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, shards: int | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ordered: bool = False, shard_col: str | None = None) -> DataFrame:
    """The rows that are drawn, as often as they're drawn, with all their columns; ordered: shard by shard, shuffled within; shard_col: also with the shard's number, by that name."""
    _, sources, blocks, shards = _blocks(docs, weights, shards, seed, id_col, text_col, source_col)
    id_c, text_c, source_c = (f"c{docs.columns.index(c)}" for c in (id_col, text_col, source_col))
    kept = numbered(docs)
    names = kept.columns
    rows = kept.withColumn("key", F.xxhash64(F.lit(seed), id_c, text_c)).join(sources, F.col(source_c).eqNullSafe(F.col("of")))
    rows = rows.withColumn("block", F.expr("cast(pmod(key, blocks) AS int)")).join(blocks, ["source_id", "block"])
    rows = rows.select(*names, "key", F.posexplode("shards").alias("copy", "shard"))
    if ordered:
        rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("shard", "key", "copy"))
    return rows.select(*names, *(["shard"] if shard_col else [])).toDF(*docs.columns, *([shard_col] if shard_col else []))
