"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Document statistics are standardised and mapped to SIZE cosines whose inner products
approximate a Gaussian kernel. Each task sums its share of the normal equations, one for each
fold of the training rows, and the shares are added by key, so the driver receives a few
matrices of SIZE squared numbers whatever the corpus. Each fold is scored by the weights of the
others; these scores, counted into fixed bins, are calibrated by isotonic regression (pool adjacent
violators). No statistic is sampled: all labelled rows outside the held-out fold train.

Folds are crc32(doc_id as text) mod 5; fold 0 is held out. Labels, language, source and id are no
inputs of a score.

Defined results: null text counts as empty and is scored from the same statistics; a document with
several labels takes their mean, rounded up; labels that are null or without a document are not used; without labels of
both kinds every score is the share of label 1 (0.5 without any); very long texts are read whole; each row gives a
row (null ids are not held out); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, extended, pieces
from .quality_rules import CLASSES, class_counts, duplicate_lines, repeated_words

SIZE, RIDGE, WIDTH, SEED = 256, 0.3, 6.0, 11
#: Bins of the scores from -1 to 2, and the weight of the prior in each block of the calibration.
BINS, LOW, HIGH = 3_000, -1.0, 2.0
#: Tasks whose partial sums are added at a time (2 KB for each line of the equations).
PARTS = 64
THRESHOLD = 0.3


def statistics(text: str | None) -> list[float]:
    """What a score is made from; finite for every text."""
    raw = (text or "").encode()
    words, classes = raw.split(), class_counts(raw)
    n, chars = len(words), max(1, int(classes.sum()))
    lines = raw.split(b"\n")
    counts = Counter(words)
    top = counts.most_common(3)
    sizes = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    w = max(1, n)
    shares = np.fromiter(counts.values(), np.float64, len(counts)) / w
    # words that are signs or end in one, and how lines begin
    tails = Counter(x[-1:] for x in counts.elements()) if n else Counter()
    return [
        *(classes / chars).tolist(),
        np.log1p(chars),
        np.log1p(n),
        float(sizes.mean()),
        float(sizes.std()),
        float(np.log1p(sizes.max())),
        len(counts) / w,
        (top[0][1] if top else 0) / w,
        sum(k for _, k in top) / w,
        float(-(shares * np.log(shares)).sum()) / (1 + np.log(w)),
        float((sizes <= 3).sum()) / w,
        repeated_words(words) / w,
        duplicate_lines(raw) / len(lines),
        np.log1p(n / len(lines)),
        sum(tails[c] for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")) / w,
        sum(tails[c] for c in (b".", b",", b"!", b"?", b";", b":")) / w,
        counts[b"|"] / w,
        sum(k for x, k in counts.items() if x[:1].isupper()) / w,
    ]


COUNT = len(CLASSES) + 17


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, operator="quality_model"):
        found = [statistics(t) for t in batch.column(1).to_pylist()]
        flat = pa.array(np.array(found, np.float32).ravel() if found else np.empty(0, np.float32), pa.float32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * COUNT, pa.int32()), flat)], ["doc_id", "f"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), COUNT)


class Features:
    """Standardised statistics -> cosines of random projections (and a constant)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.frequencies, self.phases = rng.normal(0.0, 1.0 / WIDTH, (COUNT, SIZE)), rng.uniform(0, 2 * np.pi, SIZE)

    def __call__(self, f: np.ndarray) -> np.ndarray:
        x = np.clip((f - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / SIZE) * np.cos(x @ self.frequencies + self.phases), np.ones((len(f), 1))])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((3, COUNT))
    for batch in batches:
        f = _matrix(batch.column(batch.schema.get_field_index("f")))
        total += [np.full(COUNT, len(f)), f.sum(0), (f * f).sum(0)]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(COUNT), pa.int32()), *(pa.array(t, pa.float64()) for t in total)], ["at", "n", "s", "ss"])


def _equations(features: Features):
    """(part, fold, line, packed): lines of Z'Z and Z'y, side by side, over this task's rows of each fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            z = features(_matrix(batch.column(2)))
            for k in np.unique(fold):
                mine = z[fold == k]
                part = mine.T @ np.hstack([mine, y[fold == k, None]])
                sums[int(k)] = sums[int(k)] + part if int(k) in sums else part
        rows = [(k, i, line.tobytes()) for k, a in sums.items() for i, line in enumerate(a)]
        part = TaskContext.get().partitionId() // PARTS
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), *(pa.array([r[k] for r in rows], pa.int32()) for k in (0, 1)), pa.array([r[2] for r in rows], pa.binary())], ["part", "fold", "line", "packed"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, np.float64) for x in table.column("packed").to_pylist()], axis=0)
    return pa.table({**{c: table.column(c)[:1] for c in ("part", "fold", "line")}, "packed": pa.array([total.tobytes()], pa.binary())})


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` in weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def calibration(bins: np.ndarray, counts: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores and, for each, the calibrated one (to be interpolated); strictly rising a little, so that ranks survive within a block."""
    at = LOW + (bins + 0.5) * (HIGH - LOW) / BINS
    fitted = isotonic(ones / counts, counts)
    share = ones.sum() / counts.sum()
    knots, levels = [], []
    for level in np.unique(fitted):
        block = fitted == level
        n = counts[block].sum()
        knots.append(float((at[block] * counts[block]).sum() / n))
        levels.append((level * n + share) / (n + 1))
    levels = np.maximum.accumulate(levels)
    return np.array([LOW, *knots, HIGH]), np.array([levels[0] * 0.98, *levels, 1 - (1 - levels[-1]) * 0.98])


def _apply(features: Features, of, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = of(batch, features(_matrix(batch.column(batch.schema.get_field_index("f")))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], [*batch.schema.names[:-1], out])

    return run


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)).cast("int")


def training_labels(labels: DataFrame, label_col: str) -> DataFrame:
    """(label_id, y, fold) of the labels that may be learnt from."""
    rows = labels.select(F.col("doc_id").alias("label_id"), F.col(label_col).cast("double").alias("y")).where("y IS NOT NULL AND label_id IS NOT NULL")
    return rows.groupBy("label_id").agg(F.when(F.avg("y") >= 0.5, 1.0).otherwise(0.0).alias("y")).withColumn("fold", fold("label_id")).where("fold <> 0")


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    stats = cut(rows.mapInArrow(_statistics, extended(rows.select("doc_id"), ("f", "array<float>"))))
    train = cut(stats.join(training_labels(labels, label_col), F.col("doc_id") == F.col("label_id")).select("fold", "y", "f"))
    moments = {r["at"]: r for r in train.mapInArrow(_moments, "at int, n double, s double, ss double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect()}
    n = moments[0]["n"] if moments else 0
    kinds = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        share = 0.5 if not kinds else float(next(iter(kinds)))
        scored = stats.select("doc_id", F.lit(share).alias("score"))
    else:
        mean = np.array([moments[k]["s"] / n for k in range(COUNT)])
        spread = np.sqrt(np.maximum(0, [moments[k]["ss"] / n - mean[k] ** 2 for k in range(COUNT)]))
        features = Features(mean, np.where(spread > 1e-9, spread, 1.0))
        schema = "part int, fold int, line int, packed binary"
        parts = train.mapInArrow(_equations(features), schema).groupBy("part", "fold", "line").applyInArrow(_added, schema)
        sums = parts.groupBy("fold", "line").applyInArrow(_added, schema).collect()
        equations = {k: np.zeros((SIZE + 1, SIZE + 2)) for k in range(1, 5)}
        for r in sums:
            equations[r.fold][r.line] = np.frombuffer(r.packed, np.float64)
        total = sum(equations.values())

        def solve(a: np.ndarray) -> np.ndarray:
            return np.linalg.solve(a[:, :-1] + RIDGE * np.eye(SIZE + 1), a[:, -1])

        weights = {0: solve(total)} | {k: solve(total - a) for k, a in equations.items()}

        def raw_bin(batch: pa.RecordBatch, z: np.ndarray) -> np.ndarray:
            folds = batch.column(0).to_numpy(zero_copy_only=False)
            raw = np.array([z[i] @ weights[f] for i, f in enumerate(folds)])
            return np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)

        binned = train.mapInArrow(_apply(features, raw_bin, "bin"), "fold int, y double, bin int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("bin").collect()
        knots, levels = calibration(*(np.array([r[k] for r in binned], np.float64) for k in ("bin", "n", "ones")))
        final = weights[0]

        def calibrated(batch: pa.RecordBatch, z: np.ndarray) -> np.ndarray:
            return np.clip(np.interp(z @ final, knots, levels), 0.0, 1.0)

        scored = stats.mapInArrow(_apply(features, calibrated, "score"), extended(stats.select("doc_id"), ("score", "double")))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
