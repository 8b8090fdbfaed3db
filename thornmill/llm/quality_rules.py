"""Quality rules: repetition and symbol counts, and how far a document is from its language.

Two histograms of a document, over character classes and over its language's common words,
are compared with the same histograms of the whole language by Jensen-Shannon distance.
References are counted over every document: each task sums its classes and words, and
the sums are added per language, so no group is ever gathered. The common words of a language
are the COMMON most frequent of all its words, long or short; signs without a letter are no words
here. A task hands on its sums whenever they are many or stand for much text, and goes on. Guards: a histogram of fewer than GUARD_CHARS
characters or GUARD_WORDS words says nothing and passes.

Defined results: null text counts as empty, which fails the base rule (fewer than 20 words);
null and empty lang form languages of their own; a language without common words passes the
word test, and one that a given reference lacks passes both; very long texts are judged whole; each row gives a
row, with repeated or null ids kept; an empty table gives no rows; ``judge`` doesn't read other columns, ``keep``
returns them untouched, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SEPARATORS, extended, numbered, pieces

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30  # words, percent of words in repeated windows
COMMON = 64
HELD_WORDS, HELD_BYTES = 200_000, 64 << 20  # distinct words and bytes of text that a task sums up before it hands its sums on
GUARD_CHARS, GUARD_WORDS = 200, 60
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.35, 0.48

CLASSES = ("lower", "upper", "digit", "blank", "line", "point", "symbol", "other", "beyond")


def _class_table() -> np.ndarray:
    """Class of each byte that begins a character; len(CLASSES) for bytes that continue one."""
    table = np.full(256, CLASSES.index("other"), np.uint8)
    for name, members in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("blank", b" \t\r\x0b\x0c"), ("line", b"\n"), ("point", b".,;:!?'\"()-"), ("symbol", SYMBOLS), ("beyond", range(0xC0, 256))):
        table[list(members)] = CLASSES.index(name)
    table[0x80:0xC0] = len(CLASSES)
    return table


_TABLE = _class_table()


def class_counts(raw: bytes) -> np.ndarray:
    return np.bincount(_TABLE[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of 8 words which the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k : n + k] for k in range(WINDOW)), strict=True))
    if len(set(windows)) == n:
        return 0
    seen = Counter(windows)
    starts = np.fromiter((seen[w] > 1 for w in windows), bool, n)
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    seen: set[bytes] = set()
    count = 0
    for line in raw.split(b"\n"):
        if line in seen:
            count += 1
        elif line.strip(SEPARATORS):
            seen.add(line)
    return count


def _reference_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n): class counts, words and how many there are of this task's documents."""
    classes: dict = defaultdict(lambda: np.zeros(len(CLASSES), np.int64))
    words: dict = defaultdict(Counter)
    total: Counter = Counter()
    held = 0

    def flush():
        rows = [(lang, "class", name.encode(), int(n)) for lang, c in classes.items() for name, n in zip(CLASSES, c, strict=True) if n]
        rows += [(lang, "total", b"", n) for lang, n in total.items()]
        rows += [(lang, "word", w, n) for lang, c in words.items() for w, n in c.items()]
        for d in (classes, words, total):
            d.clear()
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ([],) * 4, kinds, strict=True)], ["lang", "kind", "key", "n"])

    for batch in pieces(batches, operator="quality_rules"):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode()
            classes[lang] += class_counts(raw)
            found = raw.lower().split()
            total[lang] += len(found)
            words[lang].update(found)
            held += len(raw)
        if sum(map(len, words.values())) > HELD_WORDS or held > HELD_BYTES:
            yield flush()
            held = 0
    yield flush()


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """lang -> (class shares, common words, shares of these words and of all others); a few KB for each language."""
    counts = (
        docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .mapInArrow(_reference_counts, "lang string, kind string, key binary, n long")
        .groupBy("lang", "kind", "key")
        .agg(F.sum("n").alias("n"))
    )
    counts = counts.where((F.col("kind") != "word") | F.expr("decode(key, 'UTF-8') rlike '\\\\p{L}'"))
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    found: dict = defaultdict(lambda: {"class": {}, "word": {}, "total": {}})
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= COMMON).collect():
        found[r.lang][r.kind][bytes(r.key)] = r.n
    out = {}
    for lang, of in found.items():
        classes = np.array([of["class"].get(c.encode(), 0) for c in CLASSES], float)
        words, total = dict(sorted(of["word"].items(), key=lambda x: (-x[1], x[0]))), sum(of["total"].values())
        shares = np.array([*words.values(), total - sum(words.values())], float)
        out[lang] = (classes / max(1.0, classes.sum()), {w: k for k, w in enumerate(words)}, shares / max(1, total))
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits, 0 to 1) of each row of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)
    return np.sqrt(np.clip(parts.sum(axis=-1) / 2, 0.0, 1.0))


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean"


def _verdicts(reference: dict, texts: list[str | None], langs: list[str | None]) -> list[list]:
    """The columns of RESULT."""
    rows: list[list] = [[] for _ in range(9)]
    for lang, text in zip(langs, texts, strict=True):
        raw = (text or "").encode()
        words, classes = raw.split(), class_counts(raw)
        n, chars = len(words), int(classes.sum())
        gaps = len(raw) - len(raw.translate(None, SEPARATORS))
        repeats = repeated_words(words)
        base = n < MIN_WORDS or 100 * repeats > MAX_REPEATED * n
        share, common, word_share = reference.get(lang, (None, {}, None))
        by_class = by_word = None
        if chars >= GUARD_CHARS and share is not None:
            by_class = float(distance(classes / chars, share))
        if n >= GUARD_WORDS and common:
            seen = np.zeros(len(common) + 1)
            for w, k in Counter(raw.lower().split()).items():
                seen[common.get(w, -1)] += k
            by_word = float(distance(seen / n, word_share))
        kept = not base and (by_class is None or by_class <= MAX_CLASS_DISTANCE) and (by_word is None or by_word <= MAX_WORD_DISTANCE)
        for out, value in zip(rows, (n, chars - gaps, int(classes[CLASSES.index("symbol")]), duplicate_lines(raw), repeats, by_class, by_word, base, kept), strict=True):
            out.append(value)
    return rows


def judge(docs: DataFrame, reference: dict | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the counts, both distances (null below the guards), base_failed and kept of each row."""
    reference = references(docs, text_col, lang_col) if reference is None else reference
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    result = [tuple(x.split()) for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        for batch in pieces(batches, operator="quality_rules"):
            found = _verdicts(reference, batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, kinds[k]) for r, (_, k) in zip(found, result, strict=True))], ["doc_id", *(n for n, _ in result)])

    return rows.mapInArrow(run, extended(rows.select("doc_id"), *result))


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that are kept, with all their columns."""
    reference, rows = references(docs, text_col, lang_col), numbered(docs)
    text, lang = (f"c{docs.columns.index(c)}" for c in (text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, operator="quality_rules"):
            texts, langs = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (text, lang))
            yield batch.filter(pa.array(_verdicts(reference, texts, langs)[-1], pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
