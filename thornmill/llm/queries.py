"""Registered queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, mixing, ngram_join, quality_model, quality_rules, secrets, sharding, token_counts, toxicity, vp_search
from .common import shared_dir, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def _op1_sql() -> str:
    """Spans from gaps and matches, as re2 finds them; letters in either case are spelled out, since re2 would fold more than ASCII."""

    def either(pattern: str) -> str:
        head, sep, tail = pattern.partition("(?i:")
        if not sep:
            return pattern
        words, _, rest = tail.partition("))")
        return head + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words) + ")" + rest

    parts, counts = [], []
    for n, r in enumerate(secrets.RULES):
        expression = "'" + either(r.pattern).replace("'", "''") + "'"
        parts.append(f"""
    list_filter(list_transform(range(1, len(h{n}) + 1), lambda i: {{'s': coalesce(list_sum(list_transform(g{n}[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(h{n}[1:i - 1], lambda h: length(h))), 0), 'r': {n}, 'k': '{r.kind}', 'n': length(h{n}[i]), 'p': length(p{n}[i])}}), lambda x: x.p >= {r.least})""")
        counts.append(f"regexp_extract_all(t, {expression}) AS h{n}, string_split_regex(t, {expression}) AS g{n}, regexp_extract_all(t, {expression}, {r.group}) AS p{n}")

    def listed(of: str) -> str:
        return f"coalesce(array_to_string(list_transform({of}, lambda x: x.k || ':' || CAST(CAST(x.s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(x.s + x.n AS BIGINT) AS VARCHAR)), ','), '')"

    kinds = ", ".join(f"CAST(len(list_filter(f, lambda x: x.r = {n})) AS BIGINT) AS n_{r.kind}" for n, r in enumerate(secrets.BASE))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), m AS (SELECT doc_id, {", ".join(counts)} FROM t
), f AS (SELECT doc_id, list_sort(flatten([{", ".join(parts)}])) AS f FROM m)
SELECT doc_id, {kinds}, sha256({listed(f"list_filter(f, lambda x: x.r < {len(secrets.BASE)})")}) AS base_sha256, {listed("f")} AS spans FROM f
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"), threshold=0.3)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"), threshold=0.5)


def op4_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor one: the search is exact."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return vp_search.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10, factor=1.0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - v.e[i]) * (q.e[i] - v.e[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first call counts the texts of one half of all digests; the second, over all rows, finds these in the cache and encodes the rest."""
    docs, cache = table(spark, sf_dir, "documents", "doc_id", "text"), shared_dir(spark)
    token_counts.count_tokens(docs.where("substring(sha2(coalesce(text, ''), 256), 1, 1) < '8'"), "byte_bpe_50k.json", cache=cache)
    return token_counts.count_tokens(docs, "byte_bpe_50k.json", cache=cache, limit=512)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), width=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


OP8_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets
), grams AS (SELECT doc_id, unnest(s) AS g FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * k >= 90 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY ALL
"""


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), "byte_bpe_50k.json", ids=False)


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_model": op3_quality_model,
    "op4_vp_search": op4_vp_search,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_join": op8_ngram_join,
    "op9_sharding": op9_sharding,
    "op10_bpe": op10_bpe,
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": _op1_sql(),
    "op4_vp_search": OP4_SQL,
    "op8_ngram_join": OP8_SQL,
}
