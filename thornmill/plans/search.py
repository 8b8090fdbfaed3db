"""Full-text search over documents; the SQL beside it splits texts by the same expression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fulltext
from .base import Family, load

F4 = Family()
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _match(name: str, query: str, oracle: str, columns=("text",), tokenizer: str = "unicode61") -> None:
    @F4.code(name, f"SELECT doc_id FROM (SELECT doc_id, source, lang, text, {_WORDS} AS w FROM documents) WHERE {oracle}")
    def run(spark, sf_dir):
        return load(spark, sf_dir, "documents").where(fulltext.matches(query, list(columns), tokenizer)).select("doc_id")


_match("fts_term", "license", "list_contains(w, 'license')")
_match("fts_and", "the rights", "list_contains(w, 'the') AND list_contains(w, 'rights')")
_match("fts_or", "rights OR licensed", "list_contains(w, 'rights') OR list_contains(w, 'licensed')")
_match("fts_not", "(the AND of) NOT rights", "list_contains(w, 'the') AND list_contains(w, 'of') AND NOT list_contains(w, 'rights')")
_match("fts_prefix", "lic*", "len(list_filter(w, lambda x: starts_with(x, 'lic'))) > 0")
_match("fts_phrase", '"all rights reserved"', "contains(' ' || array_to_string(w, ' ') || ' ', ' all rights reserved ')")
_match("fts_column", "source : src1 AND text : the", "source = 'src1' AND list_contains(w, 'the')", ("source", "text"))
_match("fts_first", "^all", "w[1] = 'all'")
_match("fts_near", "NEAR(all reserved, 2)", "len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'all' AND len(list_filter(range(greatest(1, i - 3), least(len(w), i + 3) + 1), lambda j: w[j] = 'reserved')) > 0)) > 0")

@F4.code("fts_trigram", "SELECT doc_id FROM documents WHERE contains(lower(text), 'ghts')")
def _trigram(spark, sf_dir):
    """A substring through its trigrams, in order and next to each other."""
    docs = load(spark, sf_dir, "documents")
    grams = fulltext.tokens("text", "trigram")
    return docs.where(fulltext.condition(fulltext.Term(("ght", "hts")), {"text": grams})).select("doc_id")


@F4.code(
    "fts_bm25",
    f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
    t AS (SELECT doc_id, len(w) AS size, len(list_filter(w, lambda x: x = 'rights')) AS a, len(list_filter(w, lambda x: x = 'licensed')) AS b FROM d),
    f AS (SELECT count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM t)
    SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * size / mean)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * size / mean)), 6) AS score
    FROM t, c, f WHERE a > 0 OR b > 0""",
)
def _bm25(spark, sf_dir):
    found = fulltext.search(load(spark, sf_dir, "documents"), "rights OR licensed", ["text"])
    return found.select("doc_id", F.round("score", 6).alias("score"))


@F4.code("fts_highlight", "SELECT doc_id, regexp_replace(text, '(^|[^\\p{L}\\p{N}_])(rights|RIGHTS|Rights)([^\\p{L}\\p{N}_]|$)', '\\1[\\2]\\3', 'g') AS marked FROM documents")
def _highlight(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", fulltext.highlight("text", "rights").alias("marked"))
