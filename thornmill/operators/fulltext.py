"""Full-text search: tokenizers, match expressions, BM25, highlights.

Texts become token arrays (one per indexed column) by native expressions; a match expression
becomes a condition on these arrays, so a search is one filter over the scan, without a
shuffle. A text that lacks a word's letters anywhere needn't be split, so a cheap test goes first. BM25 needs
two figures of the whole corpus (documents and mean length) and a document
frequency for each term of the query: one small aggregation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stemming import stem


def tokens(column: Column | str, tokenizer: str = "unicode61") -> Column:
    """The array of a text's tokens, in order; null text has none."""
    text = F.lower(F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit("")))
    if tokenizer == "unicode61":
        return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    if tokenizer == "ascii":
        return F.regexp_extract_all(text, F.lit("[a-z0-9_]+"), F.lit(0))
    if tokenizer == "trigram":
        return F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1))  # overlapping, in one pass
    if tokenizer == "porter":
        return _stems(tokens(column, "unicode61"))
    raise ValueError(f"no such tokenizer: {tokenizer}")


def _stemmed(lists: pa.Array) -> pa.Array:
    return pa.array([None if x is None else [stem(w) for w in x] for x in lists.to_pylist()], pa.list_(pa.string()))


def _stems(words: Column) -> Column:
    """Stems of token arrays, by Arrow batches: the algorithm isn't one that expressions can state."""
    return F.arrow_udf(_stemmed, "array<string>")(words)


def _length(column: str, tokenizer: str) -> Column:
    """How many tokens a text has, without making them."""
    text = F.lower(F.coalesce(F.col(column), F.lit("")))
    if tokenizer == "trigram":
        return F.greatest(F.length(text) - 2, F.lit(0))
    return F.regexp_count(text, F.lit("[a-z0-9_]+" if tokenizer == "ascii" else r"[\p{L}\p{N}_]+"))


@dataclass(frozen=True)
class Term:
    """Words that follow each other; the last may be a prefix; within a column, at the column's start."""

    words: tuple[str, ...]
    prefix: bool = False
    column: str | None = None
    first: bool = False


@dataclass(frozen=True)
class Near:
    terms: tuple[Term, ...]
    distance: int = 10


@dataclass(frozen=True)
class Both:
    left: object
    right: object
    how: str  # and, or, not


_LEX = re.compile(r'\s*(?:(")((?:[^"]|"")*)"|(NEAR)\s*\(|([()^:*,+])|([^\s()"^:*,+]+))')


class _Parser:
    """expression := or-list of and-lists of NOT-chains of phrases; blanks between phrases mean AND."""

    def __init__(self, text: str) -> None:
        self.items, at = [], 0
        while at < len(text.rstrip()):
            m = _LEX.match(text, at)
            self.items.append(("phrase", m[2].replace('""', '"')) if m[1] else ("near", "") if m[3] else (m[4], m[4]) if m[4] else ("word", m[5]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self) -> tuple[str, str]:
        found = self.peek()
        self.at += 1
        return found

    def key(self, word: str) -> bool:
        return self.peek() == ("word", word)

    def either(self):
        left = self.all()
        while self.key("OR"):
            self.take()
            left = Both(left, self.all(), "or")
        return left

    def all(self):
        left = self.without()
        while True:
            if self.key("AND"):
                self.take()
            elif self.peek()[0] in ("end", ")") or self.key("OR"):
                return left
            left = Both(left, self.without(), "and")

    def without(self):
        left = self.one()
        while self.key("NOT"):
            self.take()
            left = Both(left, self.one(), "not")
        return left

    def one(self):
        kind, _ = self.peek()
        if kind == "(":
            self.take()
            found = self.either()
            self.take()
            return found
        if kind == "near":
            self.take()
            terms, distance = [], 10
            while self.peek()[0] not in (")", "end"):
                if self.peek()[0] == ",":
                    self.take()
                    distance = int(self.take()[1])
                else:
                    terms.append(self.term())
            self.take()
            return Near(tuple(terms), distance)
        return self.term()

    def term(self) -> Term:
        column, first = None, False
        if self.peek()[0] == "word" and self.items[self.at + 1 : self.at + 2] == [(":", ":")]:
            column = self.take()[1]
            self.take()
        if self.peek()[0] == "^":
            self.take()
            first = True
        words: list[str] = []
        while True:
            kind, text = self.take()
            if kind not in ("word", "phrase"):
                raise ValueError(f"a search term is missing before {text!r}")
            words += re.findall(r"\w+", text.lower())
            if self.peek()[0] != "+":
                break
            self.take()
        prefix = self.peek()[0] == "*"
        if prefix:
            self.take()
        return Term(tuple(words), prefix, column, first)


def parse(query: str):
    parser = _Parser(query)
    found = parser.either()
    if parser.peek()[0] != "end":
        raise ValueError(f"the search expression goes on after its end: {query!r}")
    return found


def _at(array: Column, term: Term) -> Column:
    """Positions (from 1) at which the term's words stand. The array is an argument of each function and not used within a lambda, where it would be made anew for each element."""
    n = len(term.words)
    if n == 0:
        return F.array().cast("array<int>")
    shifted = [array, *(F.slice(array, k + 1, F.greatest(F.size(array) - k, F.lit(0))) for k in range(1, n))]
    zipped = F.arrays_zip(*(x.alias(f"w{k}") for k, x in enumerate(shifted)))

    def holds(x: Column, i: Column) -> Column:
        test = F.lit(True)
        for k, w in enumerate(term.words):
            token = x[f"w{k}"]
            test = test & (token.startswith(w) if term.prefix and k == n - 1 else token == w)
        return F.when(test, i + 1)

    return F.filter(F.transform(zipped, holds), lambda p: p.isNotNull())


def _close(left: Column, right: Column, distance: int) -> Column:
    """Is some position of one at most ``distance`` from one of the other?"""
    return F.exists(left, lambda a: F.exists(right, lambda b: F.abs(a - b) <= distance))


def condition(expression, arrays: dict[str, Column]) -> Column:
    """Whether the token arrays (by column name) satisfy a parsed expression."""
    if isinstance(expression, Both):
        left, right = condition(expression.left, arrays), condition(expression.right, arrays)
        return left & right if expression.how == "and" else left | right if expression.how == "or" else left & ~right
    if isinstance(expression, Near):
        test = F.lit(False)
        for array in arrays.values():
            first, *rest = expression.terms
            near = F.lit(True)
            for other in rest:
                near = near & _close(_at(array, first), _at(array, other), expression.distance + 1)
            test = test | (near & (F.size(_at(array, first)) > 0))
        return test
    chosen = {c: a for c, a in arrays.items() if expression.column in (None, c)}
    test = F.lit(False)
    for array in chosen.values():
        if not expression.words:
            continue
        if len(expression.words) == 1 and not expression.prefix and not expression.first:
            test = test | F.array_contains(array, expression.words[0])
        elif len(expression.words) == 1 and not expression.first:
            test = test | F.exists(array, lambda t: t.startswith(expression.words[0]))
        else:
            found = _at(array, expression)
            test = test | (F.array_contains(found, 1) if expression.first else F.size(found) > 0)
    return test


def fitted(expression, tokenizer: str):
    """The expression in the tokenizer's own words: stems, or trigrams that follow each other."""
    if isinstance(expression, Both):
        return replace(expression, left=fitted(expression.left, tokenizer), right=fitted(expression.right, tokenizer))
    if isinstance(expression, Near):
        return replace(expression, terms=tuple(fitted(t, tokenizer) for t in expression.terms))
    if tokenizer == "porter":
        return replace(expression, words=tuple(w if expression.prefix and k == len(expression.words) - 1 else stem(w) for k, w in enumerate(expression.words)))
    if tokenizer == "trigram":
        text = " ".join(expression.words)
        return replace(expression, words=tuple(text[k : k + 3] for k in range(len(text) - 2)), prefix=False)
    return expression


def possible(expression, columns: list[str], tokenizer: str = "unicode61") -> Column:
    """What every match passes: the letters of its words are somewhere in the text. (Of stems, all but the last two letters, which may have been changed.)"""
    if isinstance(expression, Both):
        left = possible(expression.left, columns, tokenizer)
        if expression.how == "not":
            return left
        right = possible(expression.right, columns, tokenizer)
        return left & right if expression.how == "and" else left | right
    test = F.lit(True)
    if isinstance(expression, Near):
        for t in expression.terms:
            test = test & possible(t, columns, tokenizer)
        return test
    chosen = [c for c in columns if expression.column in (None, c)]
    for w in expression.words:
        letters = w if tokenizer != "porter" else w[:-2] if len(w) > 4 else ""
        if letters:
            some = F.lit(False)
            for c in chosen:
                some = some | F.contains(F.lower(F.col(c)), F.lit(letters))
            test = test & F.coalesce(some, F.lit(False))
    return test


def matches(query: str, columns: list[str], tokenizer: str = "unicode61") -> Column:
    expression = fitted(parse(query), tokenizer)
    return possible(expression, columns, tokenizer) & condition(expression, {c: tokens(c, tokenizer) for c in columns})


def _terms(expression) -> list[Term]:
    if isinstance(expression, Both):
        return _terms(expression.left) + ([] if expression.how == "not" else _terms(expression.right))
    return list(expression.terms) if isinstance(expression, Near) else [expression]


def search(docs: DataFrame, query: str, columns: list[str], tokenizer: str = "unicode61", k1: float = 1.2, b: float = 0.75, weights: list[float] | None = None, indexed: list[str] | None = None) -> DataFrame:
    """The rows that match, with ``score``: BM25, larger for better matches. weights: how much a term counts in each of the indexed columns."""
    expression = fitted(parse(query), tokenizer)
    terms = list(dict.fromkeys(_terms(expression)))
    indexed = indexed or columns
    weight = dict(zip(indexed, [*(weights or []), *[1.0] * len(indexed)], strict=False))

    def counted(term: Term, arrays: dict[str, Column], by: dict[str, float]) -> Column:
        total = F.lit(0.0)
        for c, a in arrays.items():
            if term.column in (None, c):
                total = total + F.size(_at(a, term)) * by[c]
        return total

    any_term = F.lit(False)
    for t in terms:
        any_term = any_term | possible(t, columns, tokenizer)
    size = sum((_length(c, tokenizer) for c in indexed[1:]), _length(indexed[0], tokenizer))
    ones = dict.fromkeys(columns, 1.0)
    rows = docs.where(any_term).select(*(tokens(c, tokenizer).alias(f"__t{k}") for k, c in enumerate(columns)))
    arrays = {c: F.col(f"__t{k}") for k, c in enumerate(columns)}
    corpus = docs.agg(F.count("*").alias("n"), F.avg(size).alias("mean")).first()
    found = rows.agg(*(F.count(F.when(counted(t, arrays, ones) > 0, 1)).alias(f"df{n}") for n, t in enumerate(terms))).first()
    rows = docs.where(possible(expression, columns, tokenizer)).select("*", *(tokens(c, tokenizer).alias(f"__t{k}") for k, c in enumerate(columns)), size.alias("__size"))
    score = F.lit(0.0)
    for n, t in enumerate(terms):
        df, tf = found[f"df{n}"], counted(t, arrays, weight)
        idf = F.log(F.lit(1.0) + F.lit((corpus["n"] - df + 0.5) / (df + 0.5)))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("__size") / F.lit(corpus["mean"] or 1.0)))
    return rows.where(condition(expression, arrays)).select(*docs.columns, score.alias("score"))


def _marked(words: tuple[str, ...], before: str, after: str):
    def run(texts: pa.Array) -> pa.Array:
        shown = lambda m: before + m[0] + after if stem(m[0].lower()) in words else m[0]
        return pa.array([None if t is None else re.sub(r"[^\W]+", shown, t) for t in texts.to_pylist()], pa.string())

    return run


def highlight(column: str, query: str, before: str = "[", after: str = "]", tokenizer: str = "unicode61") -> Column:
    """The text with every term of the query between marks; words of the same stem count as the term, if the tokenizer says so."""
    found = F.col(column)
    if tokenizer == "porter":
        stems = tuple({w for t in _terms(fitted(parse(query), tokenizer)) for w in t.words})
        return F.arrow_udf(_marked(stems, before, after), "string")(found)
    words = sorted({(w, t.prefix and k == len(t.words) - 1) for t in _terms(parse(query)) for k, w in enumerate(t.words)})
    if not words:
        return found
    spelled = "|".join(re.escape(w) + (r"[\p{L}\p{N}_]*" if p else "") for w, p in words)
    return F.regexp_replace(found, F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_])({spelled})(?![\p{{L}}\p{{N}}_])"), F.lit(f"{before}$1{after}"))


def snippet(column: str, query: str, size: int = 10, before: str = "[", after: str = "]", dots: str = "...") -> Column:
    """``size`` words around the first match, marked."""
    words = F.split(column, r"\s+")
    terms = [t for t in _terms(parse(query)) if t.words]
    hit = F.array_min(F.filter(F.transform(words, lambda w, k: F.when(_any(w, terms), k)), lambda x: x.isNotNull()))
    start = F.greatest(F.lit(0), F.coalesce(hit, F.lit(0)) - size // 2)
    part = F.transform(F.slice(words, start + 1, size), lambda w: F.when(_any(w, terms), F.concat(F.lit(before), w, F.lit(after))).otherwise(w))
    return F.concat(F.when(start > 0, F.lit(dots)).otherwise(F.lit("")), F.array_join(part, " "), F.when(F.size(words) > start + size, F.lit(dots)).otherwise(F.lit("")))


def _any(word: Column, terms: list[Term]) -> Column:
    bare = F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}_]+", ""))
    test = F.lit(False)
    for t in terms:
        for k, w in enumerate(t.words):
            test = test | (bare.startswith(w) if t.prefix and k == len(t.words) - 1 else bare == w)
    return test
