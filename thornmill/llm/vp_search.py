"""Nearest neighbours by vantage-point trees, one for each shard.

A node of a tree holds one vector, the vantage point, and halves the others by their
distance from it. A search keeps each query's k nearest so far; by the triangle inequality a
half whose distances lie in [lo, hi] holds nothing nearer than max(d - hi, lo - d), d being the
query's distance from the vantage point. The half is skipped if ``factor`` times this bound
exceeds the k-th nearest distance: factor one is exact, larger factors skip more and may lose neighbours.

Shards are the leaves of one such tree too, the directory, whose vantage points and medians come
from a sample of about SAMPLE vectors; every vector is dealt to its leaf, and the least and
largest distances of all its members from the vantage points above it are its bounds. A query is
searched in its own shard first, and then, with the k-th distance found there, in those shards only that the
bounds don't rule out. A shard of more than SHARD vectors is several parts, by a
hash of the id, and one that more than QUERIES queries visit is repeated for each block of
them, so that a task holds SHARD vectors and QUERIES queries at most. Of equal vectors only the
k + 1 smallest ids can be in a result; the others stay out, however many there are.

Distances are Euclidean, summed in double precision from the first component to the last.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither
as queries nor as candidates; only vectors of a query's length are its candidates; equal rows
count once; a query id that repeats asks once, with its smallest vector; null ids take no part; ties go to the
smaller id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, enter

SHARD, QUERIES, LEAF, BLOCK = 4_096, 8_192, 256, 1_024
#: Vectors from which the directory is made, and its most leaves.
SAMPLE, LEAVES = 8_192, 1_024


class Tree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        self.ids, self.vectors, self.leaf, self.sizes = ids, vectors, leaf, (vectors * vectors).sum(1)
        self.root = self._build(np.arange(len(ids)), np.random.default_rng(len(ids)))

    def _build(self, rows: np.ndarray, rng) -> tuple | np.ndarray:
        if len(rows) <= self.leaf:
            return rows
        at = int(rng.integers(len(rows)))
        point, rest = rows[at], np.delete(rows, at)
        d = np.sqrt(((self.vectors[rest] - self.vectors[point]) ** 2).sum(1))
        order = np.argsort(d, kind="stable")
        rest, d, half = rest[order], d[order], len(rest) // 2  # halves by rank: equal distances don't unbalance them
        return point, [(d[0], d[half - 1], self._build(rest[:half], rng)), (d[half], d[-1], self._build(rest[half:], rng))]

    def search(self, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float = 1.0, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest of each query, nearest first; infinity and -1 where there are fewer. most: distances beyond which a query asks for nothing."""
        self.k, self.factor = k, factor
        self.most = np.full(len(ids), np.inf) if most is None else most
        self.asked, self.of, self.asked_size = vectors, ids, (vectors * vectors).sum(1)
        self.near, self.found = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1, np.int64)
        self._visit(self.root, np.arange(len(ids)))
        return self.near, self.found

    def _squares(self, active: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances by one product of matrices, and how far rounding may have moved them."""
        sizes = self.asked_size[active, None] + self.sizes[rows]
        return sizes - 2 * (self.asked[active] @ self.vectors[rows].T), 1e-9 * sizes

    def _offer(self, active: np.ndarray, squares: np.ndarray, slack: np.ndarray, rows: np.ndarray) -> None:
        """Put those of ``rows`` among the nearest that belong there; only what may belong is summed up exactly."""
        limit = np.minimum(self.near[active, -1], self.most[active]) ** 2
        squares = np.where(self.ids[rows] == self.of[active, None], np.inf, squares)
        if squares.shape[1] > self.k and (fresh := np.flatnonzero(np.isinf(limit))).size:
            limit[fresh] = np.partition(squares[fresh], self.k - 1, axis=1)[:, self.k - 1] + 2 * slack[fresh].max(1)
        which, column = np.nonzero((squares <= limit[:, None] * (1 + 1e-9) + slack) & np.isfinite(squares))
        if not len(which):
            return
        total = np.zeros(len(which))
        some, others = self.asked[active[which]], self.vectors[rows[column]]
        for d in range(some.shape[1]):
            gap = some[:, d] - others[:, d]
            total += gap * gap
        exact, ids = np.sqrt(total), self.ids[rows[column]]
        starts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        for first, end in zip(starts, [*starts[1:], len(which)], strict=True):
            q = active[which[first]]
            d, v = np.concatenate([self.near[q], exact[first:end]]), np.concatenate([self.found[q], ids[first:end]])
            order = np.lexsort((v, d))[: self.k]
            self.near[q], self.found[q] = d[order], v[order]

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            if len(node):
                self._offer(active, *self._squares(active, node), node)
            return
        point, halves = node
        squares, slack = self._squares(active, np.array([point]))
        self._offer(active, squares, slack, np.array([point]))
        d, error = np.sqrt(np.maximum(squares[:, 0], 0)), np.sqrt(slack[:, 0])
        bounds = [np.maximum(np.maximum(d - hi, lo - d) - error, 0.0) for lo, hi, _ in halves]
        inner_first = bounds[0] <= bounds[1]
        for first in (0, 1):
            mine = inner_first if first == 0 else ~inner_first
            for side in (first, 1 - first):
                some, bound = active[mine], bounds[side][mine]
                far = np.minimum(self.near[some, -1], self.most[some])
                self._visit(halves[side][2], some[self.factor * bound <= far * (1 + 1e-9) + 1e-12])


class Directory:
    """The tree over the shards of vectors of one length: vantage points, medians, and the vantage points above each leaf."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        depth = max(0, int(leaves - 1).bit_length())
        self.points, self.medians, self.depth = np.zeros(((1 << depth) - 1, sample.shape[1])), np.full((1 << depth) - 1, np.inf), depth
        rng, parts = np.random.default_rng(len(sample)), {0: sample}
        for node in range(len(self.points)):  # children of a node are 2 node + 1 and 2 node + 2
            rows = parts.pop(node, sample[:0])
            if len(rows):
                self.points[node] = rows[int(rng.integers(len(rows)))]
                d = np.sqrt(((rows - self.points[node]) ** 2).sum(1))
                self.medians[node] = np.median(d)
                parts[2 * node + 1], parts[2 * node + 2] = rows[d <= self.medians[node]], rows[d > self.medians[node]]

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """From every vantage point."""
        return np.stack([np.sqrt(((vectors - p) ** 2).sum(1)) for p in self.points], 1) if len(self.points) else np.zeros((len(vectors), 0))

    def leaf(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distances from the vantage points above it) of each vector."""
        node, path = np.zeros(len(vectors), np.int64), np.zeros((len(vectors), self.depth))
        for level in range(self.depth):
            path[:, level] = np.sqrt(((vectors - self.points[node]) ** 2).sum(1))
            node = 2 * node + 1 + (path[:, level] > self.medians[node])
        return node - len(self.points), path

    def above(self, leaf: int) -> list[int]:
        """The nodes above a leaf, from the root."""
        node, found = leaf + len(self.points), []
        while node:
            node = (node - 1) // 2
            found.append(node)
        return found[::-1]


def _vectors(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column(0).to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim)) if (dims != dim).any() else batch


def _deal(directories):
    """(dim, leaf, vec_id, embedding, path) of rows (dim, vec_id, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("vp_search")
        for whole in batches:
            for dim, batch in _by_dim(whole):
                leaf, path = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 0))
                if dim in directories.value:
                    leaf, path = directories.value[dim].leaf(_vectors(batch.column(2)))
                offsets = pa.array(np.arange(len(leaf) + 1) * path.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaf, pa.int32()), batch.column(1), batch.column(2), pa.ListArray.from_arrays(offsets, pa.array(path.ravel()))], ["dim", "leaf", "vec_id", "embedding", "path"])

    return run


def _route(directories, bounds: dict, factor: float):
    """(dim, leaf, vec_id, embedding, most) for each other shard that may hold something nearer than ``most``; rows: dim, leaf (the query's own), vec_id, embedding, most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("vp_search")
        for whole in batches:
            for dim, batch in _by_dim(whole):
                if dim not in directories.value:
                    continue
                directory, of = directories.value[dim], bounds[dim]
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    d, own, most = directory.distances(_vectors(part.column(3))), part.column(1).to_numpy(), part.column(4).to_numpy()
                    for leaf, (low, high) in of.items():
                        mine = d[:, directory.above(leaf)]
                        bound = np.maximum(mine - high, low - mine).max(1)
                        goes = (own != leaf) & (factor * (bound - 1e-9 * (1 + mine.max(1))) <= most * (1 + 1e-9))
                        if goes.any():
                            some = part.filter(pa.array(goes))
                            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([leaf] * some.num_rows, pa.int32()), *some.columns[2:]], ["dim", "leaf", "vec_id", "embedding", "most"])

    return run


def _search(k: int, factor: float):
    """Rows come ordered by shard, vectors before queries: (query_id, vec_id, score) of the k nearest in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("vp_search")
        shard, ids, vectors, tree = None, [], [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)], 1).astype(np.int64)
            vec, most = (batch.column(c).to_numpy(zero_copy_only=False) for c in (5, 7))
            starts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1)] if len(marks) else []
            for first, end in zip(starts, [*starts[1:], len(marks)], strict=True):
                values = _vectors(batch.column(6).slice(first, end - first))
                if tuple(marks[first, :4]) != shard:
                    shard, ids, vectors, tree = tuple(marks[first, :4]), [], [], None
                if marks[first, 4] == 0:
                    ids.append(vec[first:end])
                    vectors.append(values)
                    continue
                if not ids:
                    continue
                tree = tree or Tree(np.concatenate(ids), np.concatenate(vectors))
                for at in range(0, end - first, BLOCK):
                    of = vec[first + at : min(end, first + at + BLOCK)]
                    near, found = tree.search(of, values[at : at + BLOCK], k, factor, most[first + at : first + at + len(of)])
                    real = np.isfinite(near)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(of, k)[real.ravel()], pa.int64()), pa.array(found[real], pa.int64()), pa.array(near[real], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row of ``queries`` (the same columns) among the rows of ``embeddings`` with other ids."""
    spark = embeddings.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def valid(df: DataFrame) -> DataFrame:
        good = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0) AND vec_id IS NOT NULL"
        return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where(good)

    vectors = valid(embeddings)
    lengths = cut(vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids")))
    if not lengths.where("n <> ids").isEmpty():
        vectors = vectors.dropDuplicates(["vec_id", "embedding"])
    copy = F.row_number().over(Window.partitionBy("print", "embedding").orderBy("vec_id"))
    vectors = vectors.withColumn("print", F.xxhash64("embedding")).withColumn("copy", copy).where(F.col("copy") <= k + 1)
    vectors = vectors.select(F.size("embedding").alias("dim"), "vec_id", "embedding")
    asked = valid(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select(F.size("embedding").alias("dim"), "vec_id", "embedding")

    sizes = {r.dim: r.n for r in lengths.where(F.col("n") > SHARD).collect()}  # one in SHARD of the vectors at most, if each length has just that many
    directories = {}
    if sizes:
        share = F.when(F.lit(False), 0.0)
        for dim, n in sizes.items():
            share = share.when(F.size("embedding") == dim, SAMPLE / len(sizes) / n)
        drawn = defaultdict(list)
        for r in valid(embeddings).where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) < share * (1 << 30)).collect():
            drawn[len(r.embedding)].append((r.vec_id, r.embedding))
        directories = {dim: Directory(np.array([v for _, v in sorted(drawn[dim])], np.float64), min(LEAVES, -(-n // SHARD))) for dim, n in sizes.items() if drawn[dim]}
    sent = spark.sparkContext.broadcast(directories)
    kind = dict(vectors.dtypes)["embedding"]
    dealt = cut(vectors.mapInArrow(_deal(sent), f"dim int, leaf int, vec_id long, embedding {kind}, path array<double>"))
    home = cut(asked.mapInArrow(_deal(sent), f"dim int, leaf int, vec_id long, embedding {kind}, path array<double>").drop("path"))

    depth = max([0, *(d.depth for d in directories.values())])
    ends = [f(F.get("path", F.lit(i))).alias(f"{name}{i}") for i in range(depth) for name, f in (("low", F.min), ("high", F.max))]
    bounds: dict = defaultdict(dict)
    for r in dealt.where(F.size("path") > 0).groupBy("dim", "leaf").agg(F.count("*").alias("n"), *ends).collect():  # LEAVES rows at most for each length
        of = directories[r.dim].depth
        bounds[r.dim][r.leaf] = np.array([r[f"low{i}"] for i in range(of)]), np.array([r[f"high{i}"] for i in range(of)])
    parts = dealt.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))

    def searched(visits: DataFrame) -> DataFrame:
        """visits: dim, leaf, vec_id, embedding, most."""
        plan = cut(visits.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")).join(parts, ["dim", "leaf"]))
        tasks = plan.agg(F.sum(F.col("blocks") * F.col("parts"))).first()[0] or 1
        here = dealt.join(plan, ["dim", "leaf"]).select("dim", "leaf", F.expr("cast(pmod(xxhash64(vec_id), parts) AS int) AS part"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(0).alias("kind"), "vec_id", "embedding", F.lit(0.0).alias("most"))
        there = visits.join(plan, ["dim", "leaf"]).select("dim", "leaf", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.expr("cast(pmod(xxhash64(vec_id, 1), blocks) AS int) AS block"), F.lit(1).alias("kind"), "vec_id", "embedding", "most")
        key = ["dim", "leaf", "part", "block"]
        return here.union(there).repartition(max(least, min(tasks, 100_000)), *key).sortWithinPartitions(*key, "kind").mapInArrow(_search(k, factor), "query_id long, vec_id long, score double")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    found = cut(best(searched(home.withColumn("most", F.lit(float("inf"))))))
    if bounds:
        reached = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reached"))
        limited = home.join(reached, "vec_id", "left").select("dim", "leaf", "vec_id", "embedding", F.coalesce("reached", F.lit(float("inf"))).alias("most"))
        visits = cut(limited.mapInArrow(_route(sent, dict(bounds), factor), f"dim int, leaf int, vec_id long, embedding {kind}, most double"))
        found = best(found.drop("rank").unionByName(searched(visits)))
    return found.select("query_id", "rank", "vec_id", "score")
