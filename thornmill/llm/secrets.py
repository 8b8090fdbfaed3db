"""Secret scan over a trigram inverted index, in DataFrame operations alone.

Each rule is a regular expression. Its Boolean trigram query (which trigrams any match must
hold) is derived from the expression: literal runs give the trigrams of each of their
spellings, alternatives give alternatives. The index holds a posting (trigram, document) for
each trigram that some rule asks for; postings are intersected by adding up, for each
document, the trigrams it has, and asking every rule's query. Only documents that a query
lets through are read by that rule's expression; rules without a mandatory trigram read every
document. The index folds ASCII case, so it lets more through and never less.

Postings travel as one small row for each document (tasks add up before the shuffle), texts
do not travel: the candidates are joined to the documents by broadcast while they are at
most BROADCAST_ROWS, and by a shuffle beyond that.

Defined results: null text counts as empty (no span); repeated rows and null ids are kept,
a result for each row; an empty table gives no rows; matches are leftmost and non-overlapping for each kind, and
those that are too short are dropped after matching; very long texts are read whole; other columns
are not read by ``scan`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BROADCAST_ROWS = 500_000
MASK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # runs are maximal, so this drops the same matches as [0-9a-f]+ and a test of the length
)
MORE = (
    Rule("private", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
)
RULES = BASE + MORE
#: Spellings of a literal run that are followed; a run with more says nothing.
SPELLINGS = 64
#: Trigrams whose bits share a long.
LOT = 60
#: Spans whose lengths are added up at a time.
BLOCK = 256

# a query is a set of alternatives, each a set of trigrams that a match must all hold; None: no trigram is mandatory
Query = frozenset | None


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    found = frozenset(x | y for x in a for y in b)
    return found if len(found) <= SPELLINGS else min(a, b, key=len)


def _run(spellings: set[str]) -> Query:
    found = [frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in spellings]
    return frozenset(found) if all(found) else None


def _walk(tokens) -> tuple[set[str] | None, Query]:
    """(all spellings if they are few, else None; the query) of a parsed expression."""
    run, whole, query = {""}, True, None
    for op, arg in tokens:
        name, spelled, inner = str(op), None, None
        if name == "LITERAL":
            spelled = {chr(arg).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            spelled = {chr(c).lower() for _, c in arg}
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
            spelled = {chr(c).lower() for o, a in arg for c in (range(a[0], a[1] + 1) if str(o) == "RANGE" else [a])}
            spelled = spelled if len(spelled) <= 8 else None
        elif name == "SUBPATTERN":
            spelled, inner = _walk(arg[-1])
        elif name == "BRANCH":
            parts = [_walk(p) for p in arg[1]]
            if all(p[0] is not None for p in parts):
                spelled = set().union(*(p[0] for p in parts))
            elif all(p[1] is not None for p in parts):
                inner = frozenset().union(*(p[1] for p in parts))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, body = arg
            once, needed = _walk(body)
            if once is not None and most <= 3:
                spelled = {""} if least == 0 else set()
                grown = {""}
                for k in range(1, most + 1):
                    grown = {a + b for a in grown for b in once}
                    spelled |= grown if k >= least else set()
            elif least:
                inner = needed if once is None else _run(once)
        elif name == "AT":
            spelled = {""}
        if spelled is not None and len(spelled) * len(run) <= SPELLINGS:
            run = {a + b for a in run for b in spelled}
        else:
            query, run, whole = _both(query, _run(run)), {""}, False
            query = _both(query, inner)
            if spelled is not None and len(spelled) <= SPELLINGS:
                run = spelled
    return (run if whole else None), _both(query, _run(run))


def trigram_query(pattern: str) -> Query:
    """What trigrams (of lower-case ASCII text) a match of the expression must hold."""
    found = _walk(re._parser.parse(pattern))[1]
    return found and frozenset(x for x in found if not any(y < x for y in found))


def _trigrams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for part in trigram_query(r.pattern) or () for t in part})


def _key() -> Column:
    """Rows that collide share their postings: they are read once more than needed, and nothing is missed."""
    return F.xxhash64("doc_id", "text")


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, key) of the trigrams that the rules ask for. docs: doc_id, text."""
    folded = docs.select(_key().alias("key"), F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("folded"))
    return folded.select("key", F.explode(F.array_compact(F.array(*(F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in _trigrams(rules))))).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, wanted): for each document that some rule's query lets through, the bits of these rules."""
    words = _trigrams(rules)
    number = F.array_position(F.array(*(F.lit(w) for w in words)), F.col("trigram")) - 1
    lots = range(0, len(words), LOT)  # of bits that a long holds

    def bit(first: int) -> Column:
        return F.when((number >= first) & (number < first + LOT), F.call_function("shiftleft", F.lit(1).cast("long"), (number - first).cast("int"))).otherwise(F.lit(0).cast("long"))

    held = index.groupBy("key").agg(*(F.bit_or(bit(k)).alias(f"held{k}") for k in lots))

    def has(part: frozenset) -> Column:
        test = F.lit(True)
        for k in lots:
            if need := sum(1 << words.index(t) - k for t in part if k <= words.index(t) < k + LOT):
                test = test & (F.col(f"held{k}").bitwiseAND(F.lit(need).cast("long")) == need)
        return test

    wanted = F.lit(0)
    for n, rule in enumerate(rules):
        if (query := trigram_query(rule.pattern)) is not None:
            test = F.lit(False)
            for part in sorted(query, key=sorted):
                test = test | has(part)
            wanted = wanted.bitwiseOR(F.when(test, F.lit(1 << n)).otherwise(F.lit(0)))
    return held.select("key", wanted.alias("wanted")).where("wanted <> 0")


def _hits(rule: Rule, n: int) -> tuple[Column, Column]:
    """Matches and the groups whose length counts, as arrays; both empty where the rule needn't look."""
    expression = F.lit(rule.pattern)
    look = F.lit(True) if trigram_query(rule.pattern) is None else F.col("wanted").bitwiseAND(1 << n) != 0
    none = F.array().cast("array<string>")
    whole = F.when(look, F.regexp_extract_all("text", expression, F.lit(0))).otherwise(none)
    return whole, F.when(look, F.regexp_extract_all("text", expression, F.lit(rule.group))).otherwise(none) if rule.group else whole


def _before(values: Column, join) -> Column:
    """For each of an array's numbers, ``join`` of all that stand before it (0 before the first); summed up block by block, so that long arrays don't cost the square of their length."""

    def folded(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), join)

    def bound(whole: Column, then) -> Column:  # an array is made once if it's the variable of a lambda
        return F.transform(F.array(whole), then)[0]

    def placed(x: Column) -> Column:
        def at(_, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            return join(F.get(x["starts"], block), folded(F.slice(x["values"], block * BLOCK + 1, i % BLOCK)))

        return F.transform(x["values"], at)

    def spread(x: Column) -> Column:
        starts = F.transform(x["blocks"], lambda _, b: folded(F.slice(x["blocks"], F.lit(1), b)))
        return bound(F.struct(x["values"].alias("values"), starts.alias("starts")), placed)

    def blocked(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: folded(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
        return bound(F.struct(v.alias("values"), blocks.alias("blocks")), spread)

    return F.when(F.size(values) > 0, bound(values, blocked)).otherwise(F.array().cast("array<int>"))


def _spans(rule: Rule, n: int) -> Column:
    """(start, rank, end) of the matches: gaps between them come from splitting the text by the same expression."""
    zipped = F.arrays_zip(F.split("text", rule.pattern, -1).alias("gap"), F.col(f"hit{n}").alias("hit"), F.col(f"part{n}").alias("part"))
    sizes = F.transform(zipped, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["hit"]), F.lit(0)).alias("hit"), F.coalesce(F.length(x["part"]), F.lit(-1)).alias("part")))
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int>>")

    def placed(s: Column) -> Column:
        before = _before(F.transform(s, lambda x: x["gap"] + x["hit"]), lambda a, b: a + b)
        long = F.filter(F.arrays_zip(s.alias("x"), before.alias("before")), lambda z: z["x"]["part"] >= rule.least)
        start = lambda z: z["before"] + z["x"]["gap"]
        return F.transform(long, lambda z: F.struct(start(z).alias("start"), F.lit(n).alias("rank"), (start(z) + z["x"]["hit"]).alias("end")))

    return F.when(F.size(f"hit{n}") > 0, F.transform(F.array(sizes), placed)[0]).otherwise(nothing)


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (doc_id, text and others) with ``found``: (start, rank, end) of every span, in order."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    wanted = cut(candidates(build_index(docs.select("doc_id", "text"), rules), rules))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    names = docs.columns
    rows = docs.withColumn("key", _key()).join(wanted, "key", "left").withColumn("wanted", F.coalesce("wanted", F.lit(0)))
    hits = [_hits(rule, n) for n, rule in enumerate(rules)]
    rows = rows.select(*names, *(h.alias(f"hit{n}") for n, (h, _) in enumerate(hits)), *(p.alias(f"part{n}") for n, (_, p) in enumerate(hits)))
    return rows.select(*names, F.array_sort(F.concat(*(_spans(rule, n) for n, rule in enumerate(rules)))).alias("found"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count for each of the first ``base`` kinds, base_sha256 and spans of each row."""
    found = spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rules)
    kinds = F.array(*(F.lit(r.kind) for r in rules))

    def listed(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(rank: int) -> Column:
        return F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long")

    return found.select(
        "doc_id",
        *(counted(n).alias(f"n_{r.kind}") for n, r in enumerate(rules[:base])),
        F.sha2(listed(F.filter("found", lambda s: s["rank"] < base)), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = MASK) -> DataFrame:
    """docs with every span of the text replaced by the mask (spans that overlap by one), n_chars made to fit; all columns stay."""
    names = docs.columns
    rest = [f"__{k}" for k, c in enumerate(names) if c not in ("doc_id", "text")]
    found = spans(docs.toDF(*(c if c in ("doc_id", "text") else f"__{k}" for k, c in enumerate(names))).withColumn("__was_null", F.col("text").isNull()), rules)

    def masked(spans: Column) -> Column:
        """What stands before each span and the mask, but for spans within others, then the rest of the text."""
        covered = _before(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))

        def piece(z: Column) -> Column:
            free = z["s"]["start"] >= z["covered"]
            return F.when(free, F.concat(F.col("text").substr(z["covered"] + 1, z["s"]["start"] - z["covered"]), F.lit(mask))).otherwise(F.lit(""))

        pieces = F.transform(F.arrays_zip(spans.alias("s"), covered.alias("covered")), piece)
        return F.concat(F.array_join(pieces, ""), F.col("text").substr(F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length("text")))

    clean = F.transform(F.array("found"), masked)[0]
    text = F.when(F.col("__was_null"), F.lit(None)).when(F.size("found") > 0, clean).otherwise(F.col("text"))
    redacted = found.select("doc_id", text.alias("text"), (F.size("found") > 0).alias("__changed"), *rest)
    out = []
    for k, c in enumerate(names):
        column = F.col(c if c in ("doc_id", "text") else f"__{k}")
        if c == "n_chars":
            column = F.when(F.col("__changed"), F.length("text").cast(docs.schema[c].dataType)).otherwise(column)
        out.append(column.alias(c))
    return redacted.select(*out)
