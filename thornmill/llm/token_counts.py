"""Token counts by way of a digest cache.

A count depends on a text and a tokenizer alone, so it is stored under the digests of both
and never made twice: texts are looked up by their digest, only distinct misses are encoded,
and their counts are appended to the cache, a Parquet table (digest, tokenizer, n_tokens).
Only digests are shuffled for the lookup. What is missing is told to the tasks by a bitmap of
fixed size, and those texts travel once, compressed, after each task has dropped the copies it has seen, so
that a text with millions of copies is a few rows for the task that gets its digest.

Normalised content is the text with null as the empty text; anything more could change counts.

Defined results: null text counts as empty (0 tokens, 0 bytes); each row gives a row, with
repeated or null ids kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Chunker, resolve
from .common import HELD, cut, enter, membership, pieces, present, shared_dir

#: Digests that a task remembers while it drops copies; older ones are forgotten, which costs a row and never a result.
SEEN = 100_000
#: Pieces of texts whose counts a worker remembers (twice that many at most, some 150 bytes each), and letters of the longest.
MOST, LONGEST = 200_000, 256
SCHEMA = "digest binary, tokenizer string, n_tokens long"


class ChunkCounts:
    """Token counts by the library, asked once for each distinct piece that texts have in common: two generations of MOST pieces are remembered."""

    def __init__(self, library, chunker: Chunker) -> None:
        self.library, self.chunker, self.young, self.old = library, chunker, {}, {}

    def __call__(self, texts: list[str]) -> list[int]:
        lists = [self.chunker(t) for t in texts]
        young, old, new = self.young, self.old, []
        for c in set().union(*lists) - young.keys():
            if c in old:
                young[c] = old[c]
            else:
                new.append(c)
        young.update(zip(new, map(len, self.library.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        totals = [sum(map(young.__getitem__, found)) for found in lists]
        for c in new:
            if len(c) > LONGEST:
                del young[c]
        if len(young) > MOST:
            self.young, self.old = {}, young
        return totals


def _byte_level(spec: dict) -> bool:
    """Does the file split texts as byte-level tokenizers do, so that pieces can be counted one by one?"""
    split = spec.get("pre_tokenizer") or {}
    plain = not any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
    return plain and spec["model"]["type"] == "BPE" and not spec.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """texts -> tokens of each, as the library for the file counts them: tokenizers for .json, sentencepiece for .model."""
    HELD["token_counts"] = counter.cache_clear
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(model.encode(t, num_threads=1)) for t in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if _byte_level(spec):
        return ChunkCounts(library, Chunker([t["content"] for t in spec["added_tokens"]]))
    return lambda texts: [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def version(tokenizer: str) -> str:
    """Digest of the tokenizer's file."""
    with open(resolve(tokenizer), "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _first_copies(bitmap):
    """digest and compressed text of what the bitmap holds (everything, if there is none), without the copies that this task has lately met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[bytes, None] = OrderedDict()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in pieces(batches, operator="token_counts"):
            digests, texts = [], []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bitmap is not None and not present(bitmap.value, int.from_bytes(digest[:8], "big", signed=True)):
                    continue
                if digest in seen:
                    seen.move_to_end(digest)
                    continue
                seen[digest] = None
                if len(seen) > SEEN:
                    seen.popitem(last=False)
                digests.append(digest)
                texts.append(squeeze(text.encode()))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(texts, pa.binary())], ["digest", "packed"])

    return run


def _encode_misses(tokenizer: str, tag: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("token_counts")
        count, unpack, last = counter(resolve(tokenizer)), zstandard.ZstdDecompressor().decompress, None
        for batch in pieces(batches, "packed", 2 << 20, "token_counts"):
            digests, texts = [], []
            for digest, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest != last:  # copies from other tasks are neighbours here
                    last = digest
                    digests.append(digest)
                    texts.append(unpack(packed).decode())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([tag] * len(digests), pa.string()), pa.array(count(texts), pa.int64())], ["digest", "tokenizer", "n_tokens"])

    return run


def read_cache(spark: SparkSession, path: str, tag: str) -> DataFrame | None:
    """(digest, n_tokens) of one tokenizer, or None while the cache has not been written."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("tokenizer") == tag).select("digest", "n_tokens")


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", cache: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row.

    ``cache``: path of the cache, which is made or appended to; without one, a new cache in
    the shared folder serves this call alone. One writer at a time: two that run together
    may append a digest twice, which the next reader removes.
    """
    spark = docs.sparkSession
    tag, path = version(tokenizer), cache or shared_dir(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    known, bitmap = read_cache(spark, path, tag), None
    if known is not None:
        known = known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        missing = cut(rows.select("digest").distinct().join(known, "digest", "left_anti").select(F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long").alias("start")))
        bitmap = spark.sparkContext.broadcast(membership(missing, "start"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.select("digest", "text").mapInArrow(_first_copies(bitmap), "digest binary, packed binary").repartition(n, "digest")
    if known is not None:  # what the bitmap let through by chance
        packed = packed.join(known.select("digest"), "digest", "left_anti")
    packed.sortWithinPartitions("digest").mapInArrow(_encode_misses(tokenizer, tag), SCHEMA).write.mode("append").parquet(path)
    counts = read_cache(spark, path, tag)
    if known is not None:
        counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    light = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    return light.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
