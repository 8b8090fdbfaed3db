"""Window calls that Spark's SQL lacks, written in those it has: FILTER before OVER, GROUPS frames, EXCLUDE, and aggregates of the dialect over windows.

A GROUPS frame is a RANGE frame over the peers' dense rank, which a derived table computes below the
query. A frame that excludes rows is the union of smaller frames: its sides' counts, sums, least and
greatest values are put together.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import inf

from .dialect import Token, name_of, tokenize
from .errors import SyntaxProblem

_CLAUSES = ("FROM", "WHERE", "GROUP", "HAVING", "WINDOW", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT")


def _close(tokens: list[Token], at: int) -> int:
    """Where the parenthesis that opens at ``at`` is closed."""
    depth = 0
    for k in range(at, len(tokens)):
        if tokens[k].kind == "sign":
            depth += (tokens[k].text == "(") - (tokens[k].text == ")")
            if depth == 0:
                return k
    raise SyntaxProblem("a parenthesis isn't closed")


def _parts(tokens: list[Token]) -> list[list[Token]]:
    parts, depth = [[]], 0
    for t in tokens:
        depth += (t.text == "(") - (t.text == ")") if t.kind == "sign" else 0
        if t.text == "," and depth == 0 and t.kind == "sign":
            parts.append([])
        else:
            parts[-1].append(t)
    return parts


def _text(tokens: list[Token]) -> str:
    return " ".join(t.text for t in tokens)


@dataclass
class Spec:
    """What stands in the parentheses after OVER."""

    partition: str = ""
    order: str = ""
    unit: str = ""
    low: float = -inf
    high: float = 0
    exclude: str = ""
    text: str = ""

    def over(self, partition: str, order: str, unit: str, low: float, high: float) -> str:
        return "OVER (" + (f"PARTITION BY {partition} " if partition else "") + (f"ORDER BY {order} " if order else "") + f"{unit} BETWEEN {_bound(low)} AND {_bound(high)})"


def _bound(n: float) -> str:
    if n in (-inf, inf):
        return "UNBOUNDED " + ("PRECEDING" if n < 0 else "FOLLOWING")
    return "CURRENT ROW" if n == 0 else f"{abs(n):g} {'PRECEDING' if n < 0 else 'FOLLOWING'}"


def _read_bound(words: list[str]) -> float:
    if words[:2] == ["CURRENT", "ROW"]:
        return 0
    far = inf if words[0] == "UNBOUNDED" else float(words[0])
    return -far if words[1] == "PRECEDING" else far


def spec(tokens: list[Token]) -> Spec:
    found, depth, marks = Spec(text=_text(tokens)), 0, {}
    for k, t in enumerate(tokens):
        depth += (t.text == "(") - (t.text == ")") if t.kind == "sign" else 0
        if depth == 0 and t.kind == "word" and t.upper in ("PARTITION", "ORDER", "ROWS", "RANGE", "GROUPS", "EXCLUDE"):
            marks.setdefault(t.upper, k)
    starts = sorted(marks.values()) + [len(tokens)]
    part = {w: tokens[k + 1 : starts[starts.index(k) + 1]] for w, k in marks.items()}
    found.partition, found.order = _text(part.get("PARTITION", [])[1:]), _text(part.get("ORDER", [])[1:])
    found.unit = next((u for u in ("ROWS", "RANGE", "GROUPS") if u in marks), "")
    if found.unit:
        words = [t.upper for t in part[found.unit]]
        if words[0] == "BETWEEN":
            middle = words.index("AND")
            found.low, found.high = _read_bound(words[1:middle]), _read_bound(words[middle + 1 :])
        else:
            found.low, found.high = _read_bound(words), 0
    elif not found.order:
        found.high = inf
    found.exclude = " ".join(t.upper for t in part.get("EXCLUDE", []))
    if found.exclude == "NO OTHERS":
        found.exclude, found.text = "", _text(tokens[: marks["EXCLUDE"]])
    return found


class Rewriting:
    """One SELECT's window calls."""

    def __init__(self) -> None:
        self.peers: dict[tuple[str, str], str] = {}

    def peer(self, s: Spec) -> str:
        return self.peers.setdefault((s.partition, s.order), f"__peer{len(self.peers)}")

    def sides(self, s: Spec) -> list[str]:
        """OVER clauses whose frames make up the frame."""
        unit = s.unit or "RANGE"
        if unit == "RANGE" and {abs(s.low), abs(s.high)} <= {0, inf}:
            unit = "GROUPS"
        elif unit == "RANGE":
            raise SyntaxProblem("EXCLUDE needs ROWS, GROUPS or a RANGE without numbers")
        if unit == "ROWS" and s.exclude != "CURRENT ROW":
            raise SyntaxProblem(f"EXCLUDE {s.exclude} needs GROUPS or RANGE")
        order = s.order if unit == "ROWS" else self.peer(s)
        grid = "ROWS" if unit == "ROWS" else "RANGE"
        around = [(s.low, min(s.high, -1)), (max(s.low, 1), s.high)]
        found = [s.over(s.partition, order, grid, low, high) for low, high in around if low <= high]
        if unit == "GROUPS" and s.low <= 0 <= s.high:
            if s.exclude == "TIES":
                found.append(s.over(s.partition, s.order or "1", "ROWS", 0, 0))
            elif s.exclude == "CURRENT ROW":
                within = ", ".join(x for x in (s.partition, order) if x)
                found += [s.over(within, s.order or "1", "ROWS", *b) for b in ((-inf, -1), (1, inf))]
        return found

    def call(self, name: str, args: str, s: Spec) -> str:
        up = name.upper()
        if s.exclude:
            return self.combined(up, args, self.sides(s))
        over = f"OVER ({s.text})"
        if s.unit == "GROUPS":
            over = s.over(s.partition, self.peer(s), "RANGE", s.low, s.high)
        return self.plain(up, name, args, over)

    def plain(self, up: str, name: str, args: str, over: str) -> str:
        if up == "TOTAL":
            return f"coalesce(sum(CAST({args} AS double)) {over}, 0.0)"
        if up in ("GROUP_CONCAT", "STRING_AGG"):
            value, *mark = [_text(p) for p in _parts(tokenize(args))]
            return f"nullif(array_join(collect_list(CAST({value} AS string)) {over}, {mark[0] if mark else chr(39) + ',' + chr(39)}), '')"
        if up == "JSON_GROUP_ARRAY":
            return f"to_json(collect_list({args}) {over})"
        return f"{name}({args}) {over}"

    def combined(self, up: str, args: str, overs: list[str]) -> str:
        if not overs:  # nothing is left of the frame
            return {"COUNT": "CAST(0 AS bigint)", "TOTAL": "CAST(0 AS double)"}.get(up, "NULL")
        sums = [f"sum({args}) {o}" for o in overs]
        count = " + ".join(f"count({args}) {o}" for o in overs)
        total = " + ".join(f"coalesce({x}, 0)" for x in sums)
        if up == "COUNT":
            return f"({count})"
        if up == "TOTAL":
            return f"CAST({total} AS double)"
        if up == "SUM":
            return f"CASE WHEN coalesce({', '.join(sums)}) IS NOT NULL THEN {total} END"
        if up == "AVG":
            return f"(({total}) / nullif({count}, 0))"
        if up in ("MIN", "MAX"):
            each = [f"{up}({args}) {o}" for o in overs]
            return each[0] if len(each) == 1 else f"{'least' if up == 'MIN' else 'greatest'}({', '.join(each)})"
        raise SyntaxProblem(f"{up} over a frame with EXCLUDE")


#: Aggregates of the dialect that need another spelling over a window.
_OWN = ("TOTAL", "GROUP_CONCAT", "STRING_AGG", "JSON_GROUP_ARRAY")


def rewrite_windows(tokens: list[Token]) -> list[Token]:
    """The statement with such calls replaced; untouched if there are none."""
    ups = [t.upper for t in tokens]
    if "OVER" not in ups or not ({"GROUPS", "EXCLUDE", "FILTER", *_OWN} & set(ups)):
        return tokens
    named, tokens = _windows(tokens)
    work, out, k = Rewriting(), [], 0
    while k < len(tokens):
        t = tokens[k]
        if t.kind == "word" and k + 1 < len(tokens) and tokens[k + 1].text == "(" and tokens[k + 1].kind == "sign":
            end = _close(tokens, k + 1)
            args, at, test = tokens[k + 2 : end], end + 1, None
            if at + 1 < len(tokens) and tokens[at].upper == "FILTER" and tokens[at + 1].text == "(":
                shut = _close(tokens, at + 1)
                test, at = tokens[at + 3 : shut], shut + 1
            if at < len(tokens) and tokens[at].upper == "OVER":
                if tokens[at + 1].text == "(":
                    last = _close(tokens, at + 1)
                    inside = tokens[at + 2 : last]
                    if inside and name_of(inside[0]).lower() in named:
                        inside = named[name_of(inside[0]).lower()] + inside[1:]
                else:
                    last, inside = at + 1, named.get(name_of(tokens[at + 1]).lower())
                if inside is not None:
                    first, *more = _parts(args)
                    if test is not None:
                        value = "1" if _text(first) == "*" else _text(first)
                        first = tokenize(f"CASE WHEN {_text(test)} THEN {value} END")
                    text = ", ".join(_text(p) for p in (first, *more))
                    out += tokenize(work.call(t.text, text, spec(inside)))
                    k = last + 1
                    continue
        out.append(t)
        k += 1
    return _below(out, work.peers) if work.peers else out


def _places(tokens: list[Token]) -> list[tuple[str, int]]:
    """The clauses of the outermost SELECT, in order."""
    found, depth = [], 0
    for k, t in enumerate(tokens):
        depth += (t.text == "(") - (t.text == ")") if t.kind == "sign" else 0
        if depth == 0 and t.kind == "word" and (t.upper in _CLAUSES or t.upper == "SELECT"):
            found.append((t.upper, k))
    return [*found, ("", len(tokens))]


def _windows(tokens: list[Token]) -> tuple[dict[str, list[Token]], list[Token]]:
    """The specifications by name, and the statement without its WINDOW clause."""
    places = _places(tokens)
    for (word, k), (_, end) in zip(places, places[1:], strict=False):
        if word == "WINDOW":
            end = next((j for w, j in places if j > k and (w in ("ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", ""))), end)
            named = {name_of(p[0]).lower(): p[3:-1] for p in _parts(tokens[k + 1 : end])}
            return named, tokens[:k] + tokens[end:]
    return {}, tokens


def _below(tokens: list[Token], peers: dict[tuple[str, str], str]) -> list[Token]:
    """FROM becomes a derived table that has the peers' ranks too."""
    places = _places(tokens)
    clause = {}
    for (word, k), (_, end) in zip(places, places[1:], strict=False):
        clause.setdefault(word, (k, end))
    if "FROM" not in clause or "GROUP" in clause:
        raise SyntaxProblem("GROUPS and EXCLUDE need a plain FROM")
    start, end = clause["FROM"]
    source = tokens[start + 1 : end]
    stop = clause["WHERE"][1] if "WHERE" in clause else end
    ranks = ", ".join("dense_rank() OVER (" + (f"PARTITION BY {p} " if p else "") + f"ORDER BY {o or '1'}) AS {alias}" for (p, o), alias in peers.items())
    plain = len(source) <= 3 and all(t.kind in ("word", "quoted") for t in source)
    alias = f" AS {source[-1].text}" if plain else ""
    hidden = f"* EXCEPT ({', '.join(peers.values())})"
    items = [x for p in _parts(tokens[clause["SELECT"][0] + 1 : start]) for x in ([Token("sign", ",")] + (tokenize(hidden) if _text(p) == "*" else p))][1:]
    made = tokenize(f"(SELECT *, {ranks} FROM {_text(source)} {_text(tokens[end:stop])}){alias}")
    return [*tokens[: clause["SELECT"][0] + 1], *items, tokens[start], *made, *tokens[stop:]]
