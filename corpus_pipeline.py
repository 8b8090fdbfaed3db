"""From raw documents to token ids: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thornmill.llm import bpe, mixing, ngram_join, quality_rules, secrets
from thornmill.llm.common import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mask; all documents stay."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, shard by shard and shuffled within."""
    return mixing.mixed(docs, ordered=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each drawn document; workers of the stages before are still there, so each keeps little and lets go of it."""
    return bpe.encode(docs, "byte_bpe_50k.json", ids=True, chunks=24 << 20, stay=False)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", deduplicate), ("secret scans", redact), ("mixing sources", mix), ("BPE encoding", encode)]

#: SQL has no BPE; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
