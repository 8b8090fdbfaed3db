"""Toxicity by compression distance: zstandard dictionaries trained on toxic and, apart from them, on ordinary text.

A window of running text (WINDOW words, each STRIDE words after the last) is compressed with
a dictionary of each kind; it is the more toxic the fewer bytes the toxic one needs by
comparison. zstandard counts whole bytes and hardly compresses so few letters, so a window is first spelled out:
each beginning of a word of four bytes or more (its ends marked by blanks) becomes eight fixed bytes, which cost
eight bytes where a dictionary lacks them, and little where it has a whole run of them. (Without
that, dictionaries of the plain text tell next to nothing on such windows; README has figures.) A beginning stands for
all that comes before in its word, so ordinary syllables in a rare order don't match the same syllables elsewhere.
Words of one letter have no such unit and aren't looked at.

Dictionaries come from zstandard's own training (``train_dictionary``) on the distinct words
of toxic and of ordinary labelled documents, in pairs of several sizes, whose differences are added:
large ones know more words, small ones only what is typical. A document's raw score adds up its TOP most toxic
windows, found over the whole text. Isotonic regression on labelled rows that the dictionaries haven't seen turns it
into a probability.

Fitting uses a sample of about SAMPLE labelled documents (chosen by a hash) and of them at most about
SAMPLES words of each kind; every document is scored. Folds are crc32(doc_id as text) mod 5; fold 0 is held
out, fold 4 calibrates. Labels, language, source and id are no inputs of a score.

Defined results: null and empty texts have the lowest raw score; words of more than LONGEST units
count as several; very long texts are read to their end, in blocks; a document with several labels takes their mean,
rounded up; labels that are null or without a document are not used; without labels of both kinds, or with too
few of one for a dictionary, every score is the share of label 1 (0.5 without any); rows with null
ids are scored and not held out, repeated rows each give a row; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import nlargest
from itertools import batched

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, Kept, cut, extended, pieces
from .ngram_join import _mix
from .quality_model import fold, isotonic, training_labels

SAMPLE, SAMPLES = 20_000, 400_000
#: Words of a window, words from one to the next, and windows that count.
WINDOW, STRIDE, TOP = 3, 3, 2
#: Bytes of what stands for a unit, and units of the longest word.
CODE, LONGEST = 8, 40
#: What the last byte of each further unit of a word is multiplied by.
_WEIGHTS = _mix(np.arange(1, LONGEST + 1, dtype=np.uint64)) | np.uint64(1)
#: Bytes of the ordinary and the toxic dictionary of each pair, and of the segments that training picks.
PAIRS, SEGMENT = ((110_000, 65_536), (32_768, 16_384)), 32
#: Raw score of a text without words, and the one that means 0.5 where no fold calibrates.
NOTHING, EVEN = -10_000, 60
#: Bytes of a text that are read at a time.
BLOCK = 2 << 20
_U, _BLANKS = np.uint64, bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))


def plain(text: str | None) -> bytes:
    """Lower-case, with blanks for white space and at both ends."""
    return b" " + (text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANKS) + b" "


def spelled(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of the units, where in them words begin, and where in the text): a unit is a word's beginning, a byte longer than the one before, the first of four bytes with blanks at their ends at most; long words are several."""
    b = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero((b[1:-2] != 32) & (b[2:-1] != 32)) if len(b) > 3 else np.empty(0, np.int64)
    starts = np.flatnonzero(b[at] == 32)
    if len(at) and (not len(starts) or starts[0]):
        starts = np.concatenate([[0], starts])
    sizes = np.diff(np.append(starts, len(at)))
    if len(sizes) and sizes.max() > LONGEST:
        starts = np.concatenate([np.arange(first, first + size, LONGEST) for first, size in zip(starts, sizes, strict=True)])
        sizes = np.diff(np.append(starts, len(at)))
    places = at[starts]
    codes = (b[at + 3].astype(_U) + _U(1)) * _WEIGHTS[np.arange(len(at)) - np.repeat(starts, sizes)]
    codes[starts] = b[places] | b[places + 1].astype(_U) << _U(8) | b[places + 2].astype(_U) << _U(16) | b[places + 3].astype(_U) << _U(24)
    before = np.cumsum(codes, dtype=_U)
    return _mix(before - np.repeat(before[starts] - codes[starts], sizes)), starts, places


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(compression_level=1, window_log=17, hash_log=15, chain_log=14, strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=5, write_content_size=0, write_checksum=0, write_dict_id=0)
    dictionary = zstandard.ZstdCompressionDict(content)
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)


class Distance:
    """pairs: (ordinary, toxic) dictionaries, as they were trained."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]) -> None:
        self.pairs = [(_compressor(a), _compressor(b)) for a, b in pairs]

    def differences(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each window (codes from start to end), bytes that the ordinary dictionaries need more than the toxic ones."""
        segments = np.stack([starts * CODE, (ends - starts) * CODE], 1).astype(_U)
        buffer = zstandard.BufferWithSegments(codes.tobytes(), segments.tobytes())
        total = np.zeros(len(starts), np.int64)
        for ordinary, toxic in self.pairs:
            for compressor, sign in ((ordinary, 1), (toxic, -1)):
                total += sign * np.fromiter(map(len, compressor.multi_compress_to_buffer(buffer, threads=0)), np.int64, len(starts))
        return total

    def raw(self, text: str | None) -> int:
        whole, best, at = plain(text), [], 0
        while at < len(whole):
            codes, starts, places = spelled(whole[at : at + BLOCK])
            last = at + BLOCK >= len(whole)
            ends = np.append(starts, len(codes))
            first = np.arange(0, max(1, len(starts) - WINDOW + (STRIDE if last else 0)), STRIDE) if len(starts) else np.empty(0, np.int64)
            if not last and len(starts) <= WINDOW:  # hardly anything but blanks
                first, last_word = first[:1], at + BLOCK - 8
            else:
                last_word = at + int(places[first[-1] + STRIDE]) if not last else 0
            if len(first):
                found = self.differences(codes, starts[first], ends[np.minimum(first + WINDOW, len(starts))])
                best = nlargest(TOP, best + nlargest(TOP, found.tolist()))
            at = len(whole) if last else last_word
        return sum(best) if best else NOTHING


def words(text: str | None) -> dict[bytes, None]:
    """The distinct words, with blanks around them."""
    return dict.fromkeys(b" " + w + b" " for w in plain(text).split())


def _samples(rates: dict[float, float]):
    """(y, words): of each document's distinct words, the share that its kind's rate says, chosen by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, operator="toxicity"):
            kinds, lists = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                below = int(rates[y] * (1 << 32))
                found = words(text)
                for some in batched((w for w in found if rates[y] >= 1 or int.from_bytes(hashlib.blake2b(w, digest_size=4, key=str(len(found)).encode()).digest()) < below), 5_000):
                    kinds.append(y)
                    lists.append(list(some))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.float64()), pa.array(lists, pa.list_(pa.binary()))], ["y", "words"])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = {0.0: 0, 1.0: 0}
    for batch in pieces(batches, operator="toxicity"):
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[y] += len(words(text))
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.float64()), pa.array(list(total.values()), pa.int64())], ["y", "n"])


def _train(table: pa.Table) -> pa.Table:
    """(y, size, content): the dictionaries of one kind, none if zstandard finds the samples too few. A group is SAMPLES words or so."""
    y = table.column("y")[0].as_py()
    code = Kept(lambda w: spelled(w)[0].tobytes(), 64 << 20, lambda w, codes: 150 + len(w) + len(codes))
    samples = [code[w] for found in sorted(table.column("words").to_pylist()) for w in found if len(w) > 3]
    sizes, contents = [pair[int(y)] for pair in PAIRS], []
    for size in sizes:
        try:
            contents.append(zstandard.train_dictionary(size, samples, k=SEGMENT, d=CODE).as_bytes())
        except zstandard.ZstdError:
            return pa.table({"y": pa.array([], pa.float64()), "size": pa.array([], pa.int32()), "content": pa.array([], pa.binary())})
    return pa.table({"y": pa.array([y] * len(sizes), pa.float64()), "size": pa.array(sizes, pa.int32()), "content": pa.array(contents, pa.binary())})


def dictionaries(train: DataFrame) -> list[tuple[bytes, bytes]]:
    """The (ordinary, toxic) dictionaries of each pair, or none. train: text, y. They come to the driver, of PAIRS bytes in all."""
    counts = {r.y: r.n for r in train.select("text", "y").mapInArrow(_counts, "y double, n long").groupBy("y").agg(F.sum("n").alias("n")).collect()}
    if not counts.get(0.0) or not counts.get(1.0):
        return []
    samples = train.select("text", "y").mapInArrow(_samples({y: min(1.0, SAMPLES / n) for y, n in counts.items()}), "y double, words array<binary>")
    found = {(r.y, r.size): bytes(r.content) for r in samples.groupBy("y").applyInArrow(_train, "y double, size int, content binary").collect()}
    return [(found[0.0, a], found[1.0, b]) for a, b in PAIRS] if len(found) == 2 * len(PAIRS) else []


def _raw(pairs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(pairs.value)
        for batch in pieces(batches, operator="toxicity"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([distance.raw(t) for t in batch.column(1).to_pylist()], pa.int32())], ["key", "raw"])

    return run


def levels(counts: dict[int, int], ones: dict[int, float], share: float) -> tuple[list[int], list[float]]:
    """The raw scores that were seen, rising, and the probability of each (isotonic); it holds up to the next one."""
    seen = sorted(counts)
    fitted = isotonic(np.array([(ones[k] + share) / (counts[k] + 1) for k in seen]), np.array([counts[k] + 1.0 for k in seen]))
    return seen, [float(x) for x in fitted]


def probability(raw: Column, seen: list[int], fitted: list[float]) -> Column:
    """That of the highest level which the raw score reaches, of the lowest if it reaches none; without levels, 0.5 at EVEN and rising."""
    if not seen:
        return 1 / (1 + F.exp((EVEN - raw) / F.lit(10.0)))
    reached = F.size(F.filter(F.array(*(F.lit(k) for k in seen)), lambda k: k <= raw))
    return F.element_at(F.array(*(F.lit(x) for x in fitted)), F.greatest(reached, F.lit(1)))


def score(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.5, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = cut(training_labels(labels, label_col))
    total = known.count()
    if total > sample:
        known = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * sample / total)))
    train = cut(rows.join(F.broadcast(known.limit(2 * sample)), F.col("doc_id") == F.col("label_id")).select("text", "y", "fold"))
    pairs = dictionaries(train.where("fold <> 4"))
    if not pairs:
        share = train.agg(F.avg("y")).first()[0]
        scored = rows.select("doc_id", F.lit(0.5 if share is None else share).alias("score"))
    else:
        sent = spark.sparkContext.broadcast(pairs)
        binned = train.where("fold = 4").select("y", "text").mapInArrow(_raw(sent), "key double, raw int").groupBy("raw").agg(F.count("*").alias("n"), F.sum("key").alias("ones")).collect()
        share = sum(r.ones for r in binned) / max(1, sum(r.n for r in binned))
        seen, fitted = levels({r.raw: r.n for r in binned}, {r.raw: r.ones for r in binned}, share) if binned else ([], [])
        raw = rows.mapInArrow(_raw(sent), extended(rows.select(F.col("doc_id").alias("key")), ("raw", "int")))
        scored = raw.select(F.col("key").alias("doc_id"), probability(F.col("raw"), seen, fitted).alias("score"))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
