"""Rewriting of the dialect's own spellings into Spark's SQL, token by token.

SELECT is never parsed into a tree here: only spellings that Spark lacks are replaced, and
Catalyst does the rest. Division by zero, failed casts and the like give NULL, which the
engine gets by turning ANSI mode off for its own session.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .errors import SyntaxProblem
from .functions import jsontext, temporal
from .functions.text import glob_regex, integer_sql, quote_sql, real_sql, typeof_sql

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<blob>[xX]'[0-9a-fA-F]*')
    |(?P<text>'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")*"|\[[^\]]*\]|`(?:[^`]|``)*`)
    |(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<param>\?\d*|[:@$][A-Za-z_]\w*)
    |(?P<word>[^\W\d]\w*)
    |(?P<sign>->>|->|\|\||<<|>>|<=|>=|<>|!=|==|[-+*/%&|~<>=(),.;])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


def tokenize(sql: str) -> list[Token]:
    found, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SyntaxProblem(f"unrecognised text near {sql[at : at + 20]!r}")
        if m.lastgroup != "space":
            found.append(Token(m.lastgroup, m[0]))
        at = m.end()
    return found


def statements(sql: str) -> list[list[Token]]:
    """The statements of a script; semicolons within the body of a trigger and within CASE don't end one."""
    out, now, body = [], [], 0
    for t in tokenize(sql):
        if t.text == ";" and not body:
            if now:
                out.append(now)
            now = []
            continue
        now.append(t)
        if t.upper == "BEGIN" and len(now) > 2 and "TRIGGER" in {x.upper for x in now[:4]}:
            body += 1
        elif body and t.upper == "CASE":
            body += 1
        elif body and t.upper == "END":
            body -= 1
    return out + ([now] if now else [])


def name_of(token: Token) -> str:
    """An identifier without its quotes."""
    if token.kind == "quoted":
        body = token.text[1:-1]
        return body.replace('""', '"') if token.text[0] == '"' else body.replace("``", "`")
    return token.text


def plain(token: Token) -> str:
    if token.kind == "quoted":
        return "`" + name_of(token).replace("`", "``") + "`"
    if token.kind == "text":
        return "'" + token.text[1:-1].replace("''", "'").replace("\\", "\\\\").replace("'", "\\'") + "'"
    return token.text


def literal(sql: str) -> str:
    """The value of a text literal in Spark's spelling."""
    if len(sql) < 2 or sql[0] != "'" or sql[-1] != "'":
        raise SyntaxProblem(f"a text literal is needed in place of {sql}")
    return sql[1:-1].replace("\\'", "'").replace("\\\\", "\\")


_TYPES = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "REAL": "double", "FLOAT": "double", "DOUBLE": "double", "TEXT": "string", "VARCHAR": "string", "CHAR": "string", "BLOB": "binary", "NUMERIC": "double", "BOOLEAN": "boolean"}


def _distinct(argument: str) -> tuple[str, str]:
    """DISTINCT, if the argument begins with it, and the rest."""
    word, _, rest = argument.partition(" ")
    return ("DISTINCT ", rest) if word.upper() == "DISTINCT" else ("", argument)


def _named(a: list[str]) -> str:
    return "to_json(named_struct(" + ", ".join(a) + "), map('ignoreNullFields', 'false'))"


def _dates(function):
    return lambda a: function(a[0] if a else "'now'", [literal(x) for x in a[1:]])


#: Functions that are written otherwise in Spark: arguments in, SQL text out.
FUNCTIONS = {
    "DATE": _dates(temporal.date),
    "TIME": _dates(temporal.time),
    "DATETIME": _dates(temporal.datetime),
    "JULIANDAY": _dates(temporal.julianday),
    "UNIXEPOCH": _dates(temporal.unixepoch),
    "STRFTIME": lambda a: temporal.strftime(literal(a[0]), a[1] if len(a) > 1 else "'now'", [literal(x) for x in a[2:]]),
    "TYPEOF": lambda a: typeof_sql(a[0]),
    "QUOTE": lambda a: quote_sql(a[0]),
    "LENGTH": lambda a: f"if(typeof({a[0]}) = 'binary', octet_length({a[0]}), length(cast({a[0]} AS string)))",
    "INSTR": lambda a: f"instr(cast({a[0]} AS string), {a[1]})",
    "UNICODE": lambda a: f"if({a[0]} = '', NULL, ascii({a[0]}))",
    "CHAR": lambda a: "concat(" + ", ".join(f"chr({x})" for x in a) + ")",
    "HEX": lambda a: f"hex(cast({a[0]} AS string))" if not a[0].upper().startswith(("X'", "UNHEX")) else f"hex({a[0]})",
    "ZEROBLOB": lambda a: f"unhex(repeat('00', {a[0]}))",
    "RANDOMBLOB": lambda a: f"substring(unhex(repeat(replace(uuid(), '-', ''), cast({a[0]} / 16 + 1 AS int))), 1, {a[0]})",
    "RANDOM": lambda a: "xxhash64(uuid())",
    "RAND": lambda a: "(rand() * 2 - 1)",
    "IIF": lambda a: f"if({', '.join(a)})",
    "LOG": lambda a: f"ln({a[0]})" if len(a) == 1 else f"(ln({a[1]}) / ln({a[0]}))",
    "MOD": lambda a: f"try_mod({a[0]}, {a[1]})",
    "TRUNC": lambda a: f"(sign({a[0]}) * floor(abs({a[0]})))",
    "GLOB": lambda a: f"({a[1]} RLIKE '{glob_regex(literal(a[0])).replace(chr(92), chr(92) * 2)}')",
    "LIKE": lambda a: f"({a[1]} ILIKE {a[0]}" + (f" ESCAPE {a[2]})" if len(a) > 2 else ")"),
    "TOTAL": lambda a: "coalesce(sum({}cast({} AS double)), 0.0D)".format(*_distinct(a[0])),
    "GROUP_CONCAT": lambda a: "listagg({}cast({} AS string), {})".format(*_distinct(a[0]), a[1] if len(a) > 1 else "','"),
    "JSON_GROUP_ARRAY": lambda a: "coalesce(to_json(transform(collect_list({}named_struct('v', {})), s -> s.v)), '[]')".format(*_distinct(a[0])),
    "JSON_GROUP_OBJECT": lambda a: f"to_json(map_from_entries(collect_list(struct(cast({a[0]} AS string), {a[1]}))))",
    "JSON": lambda a: f"tm_json({a[0]})",
    "JSON_PRETTY": lambda a: f"tm_json_pretty({a[0]})",
    "JSON_VALID": lambda a: jsontext.valid_sql(a[0]),
    "JSON_TYPE": lambda a: jsontext.type_sql(*a),
    "JSON_EXTRACT": lambda a: jsontext.extract_sql(*a),
    "JSON_ARRAY_LENGTH": lambda a: jsontext.length_sql(*a),
    "JSON_ARRAY": lambda a: "tm_json_list(array(" + ", ".join(f"to_json(array({x}))" for x in a) + "))" if a else "'[]'",
    "JSON_OBJECT": lambda a: _named(a) if a else "'{}'",
    "JSON_QUOTE": lambda a: f"tm_json_list1(to_json(array({a[0]})))",
    "JSON_SET": lambda a: _mutate("tm_json_set", a),
    "JSON_INSERT": lambda a: _mutate("tm_json_insert", a),
    "JSON_REPLACE": lambda a: _mutate("tm_json_replace", a),
    "JSON_REMOVE": lambda a: f"tm_json_remove({a[0]}, array({', '.join(a[1:])}))",
}


def _mutate(name: str, a: list[str]) -> str:
    return f"{name}({a[0]}, array({', '.join(a[1::2])}), tm_json_list(array({', '.join(f'to_json(array({v}))' for v in a[2::2])})))"


def _series(a: list[str]) -> str:
    """start, stop (included) and step; one distributed range where they are numbers."""
    start, stop, step = a[0], a[1] if len(a) > 1 else "9223372036854775806", a[2] if len(a) > 2 else "1"
    if all(re.fullmatch(r"-? ?\d+", x) for x in (start, stop, step)):
        first, last, by = (int(x.replace(" ", "")) for x in (start, stop, step))
        return f"(SELECT id AS value FROM range({first}, {last + (1 if by > 0 else -1)}, {by}))"
    whole = f"if(({stop} - {start}) * sign({step}) >= 0, sequence(CAST({start} AS bigint), CAST({stop} AS bigint), CAST({step} AS bigint)), array())"
    return f"inline(transform({whole}, x -> named_struct('value', x)))"


def _elements(name: str):
    return lambda a: f"inline({name}({a[0] if len(a) == 1 else f'get_json_object({a[0]}, {a[1]})'}))"


#: Functions that give rows, in FROM.
TABLE_FUNCTIONS = {"GENERATE_SERIES": _series, "JSON_EACH": _elements("tm_json_each"), "JSON_TREE": _elements("tm_json_tree")}
COLLATIONS = {"NOCASE": "UTF8_LCASE", "BINARY": "UTF8_BINARY", "RTRIM": "UTF8_BINARY_RTRIM"}

_BEFORE_OPERAND = {"SELECT", "WHERE", "AND", "OR", "NOT", "ON", "THEN", "ELSE", "WHEN", "CASE", "BY", "HAVING", "SET", "VALUES", "IN", "LIKE", "BETWEEN", "DISTINCT", "AS", "FROM", "JOIN", "UNION", "ALL", "EXCEPT", "INTERSECT", "LIMIT", "OFFSET", "IS"}


class Rewriter:
    """One pass over the tokens of a statement or a part of it."""

    def __init__(self, tokens: list[Token], literals: dict[str, str] | None = None, collations: dict[str, str] | None = None) -> None:
        self.tokens, self.at, self.literals = tokens, 0, {k.upper(): v for k, v in (literals or {}).items()}
        self.collations = collations or {}

    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else Token("end", "")

    def arguments(self) -> list[str]:
        """The arguments up to the closing parenthesis, rewritten; the opening one has been read."""
        parts, now, depth = [], [], 0
        while True:
            if self.at >= len(self.tokens):
                raise SyntaxProblem("a parenthesis isn't closed")
            t = self.tokens[self.at]
            self.at += 1
            if t.text == ")" and depth == 0 and t.kind == "sign":
                break
            if t.text == "," and depth == 0 and t.kind == "sign":
                parts.append(now)
                now = []
                continue
            depth += (t.text == "(") - (t.text == ")") if t.kind == "sign" else 0
            now.append(t)
        if now or parts:
            parts.append(now)
        return [Rewriter(p, self.literals, self.collations).run() for p in parts]

    def operand(self) -> str:
        """The next literal, name, parameter, call or parenthesis."""
        t = self.peek()
        self.at += 1
        if t.text == "(":
            return "(" + ", ".join(self.arguments()) + ")"
        out = plain(t)
        while self.peek().text == ".":
            out += "." + plain(self.peek(1))
            self.at += 2
        if t.kind == "word" and self.peek().text == "(":
            self.at += 1
            return self.call(t, self.arguments())
        return out

    def call(self, t: Token, a: list[str]) -> str:
        if t.upper in self.literals:
            return self.literals[t.upper]
        rule = FUNCTIONS.get(t.upper)
        return rule(a) if rule else f"{t.text}({', '.join(a)})"

    def run(self) -> str:
        out: list[str] = []
        start = 0  # where in ``out`` the last operand begins
        while self.at < len(self.tokens):
            t, nxt = self.peek(), self.peek(1)
            self.at += 1
            up = t.upper
            if t.kind == "word" and up == "CAST" and nxt.text == "(":
                self.at += 1
                start = len(out)
                out.append(self.cast())
            elif t.kind == "word" and nxt.text == "(" and nxt.kind == "sign" and (up in FUNCTIONS or up in self.literals) and up not in ("LIKE", "GLOB") or up in ("LIKE", "GLOB") and nxt.text == "(" and (not out or out[-1].upper() in _BEFORE_OPERAND or out[-1] in ("(", ",")):
                self.at += 1
                start = len(out)
                out.append(self.call(t, self.arguments()))
            elif t.kind == "word" and up in TABLE_FUNCTIONS and nxt.text == "(" and out and (out[-1].upper() in ("FROM", "JOIN", ",")):
                self.at += 1
                made = TABLE_FUNCTIONS[up](self.arguments())
                start = len(out)
                out.append(made if out[-1].upper() == "FROM" or made.startswith("(") else f"LATERAL {made}")
                if self.peek().upper != "AS" and self.peek().kind != "word" and made.startswith("("):
                    out.append(f"AS {t.text}")
            elif up == "COLLATE":
                self.at += 1
                name = name_of(nxt).upper()
                if name in self.collations:
                    out[start:] = [f"{self.collations[name]}({_joined(out[start:])})"]
                else:
                    out += ["COLLATE", COLLATIONS.get(name, name)]
            elif up == "==":
                out.append("=")
            elif up == "LIKE":
                out.append("ILIKE")
            elif up == "REGEXP":
                out.append("RLIKE")
            elif up == "GLOB":
                found = self.operand()
                out += ["RLIKE", "'" + glob_regex(literal(found)).replace("\\", "\\\\").replace("'", "\\'") + "'"]
            elif up == "ISNULL":
                out.append("IS NULL")
            elif up == "NOTNULL":
                out.append("IS NOT NULL")
            elif up == "NOT" and nxt.upper == "NULL" and out and out[-1].upper() not in _BEFORE_OPERAND and out[-1] not in ("(", ","):
                self.at += 1
                out.append("IS NOT NULL")
            elif up == "IS":
                out.append(self.equal())
            elif up == "IN" and nxt.text == "(" and self.peek(1).text == ")":
                self.at += 2
                out.append("IN (SELECT CAST(NULL AS string) WHERE false)")
            elif t.text in ("->", "->>"):
                left, path = " ".join(out[start:]), self.operand()
                path = f"'$[{path}]'" if path.isdigit() else path if path.startswith("'$") else f"'$.{literal(path)}'"
                out[start:] = [f"get_json_object({left}, {path})"]
            elif up == "LIMIT" and self.limit():
                first, second = self.limit()
                self.at += 3
                out += ["LIMIT", second, "OFFSET", first]
            elif up == "FOR" and nxt.upper == "UPDATE":
                self.at += 1
            elif t.kind == "param":
                start = len(out)
                out.append(":" + (f"p{t.text[1:] or self.count()}" if t.text[0] == "?" else t.text[1:]))
            else:
                if t.kind in ("number", "text", "blob", "quoted") or t.kind == "word" and up not in _BEFORE_OPERAND:
                    if not (out and out[-1] == "."):
                        start = len(out)
                elif t.text == "(":
                    start = len(out)
                out.append(plain(t))
        return _joined(out)

    def count(self) -> int:
        """The number of a parameter that has none: its place among those like it."""
        return sum(t.text == "?" for t in self.tokens[: self.at])

    def limit(self) -> tuple[str, str] | None:
        if self.peek(1).text == "," and self.peek().kind in ("number", "param") and self.peek(2).kind in ("number", "param"):
            return self.peek().text, self.peek(2).text
        return None

    def equal(self) -> str:
        words = [self.peek(k).upper for k in (0, 1)]
        negated = words[0] == "NOT"
        after = words[1] if negated else words[0]
        if after in ("NULL", "TRUE", "FALSE", "DISTINCT"):
            return "IS"
        self.at += negated
        return "IS DISTINCT FROM" if negated else "IS NOT DISTINCT FROM"

    def cast(self) -> str:
        depth, inner = 0, []
        while True:
            t = self.peek()
            self.at += 1
            if t.kind == "end":
                raise SyntaxProblem("CAST isn't closed")
            depth += (t.text == "(") - (t.text == ")") if t.kind == "sign" else 0
            if depth < 0:
                break
            inner.append(t)
        at = max(k for k, t in enumerate(inner) if t.upper == "AS")
        x = Rewriter(inner[:at], self.literals, self.collations).run()
        kind = _TYPES.get(inner[at + 1].upper, "")
        if kind == "bigint":
            return integer_sql(x)
        if kind == "double":
            return real_sql(x)
        return f"CAST({x} AS {kind or ' '.join(t.text for t in inner[at + 1 :])})"


def _joined(parts: list[str]) -> str:
    out = ""
    for p in parts:
        out += p if not out or p in (".", ",", ")") or out.endswith((".", "(")) else " " + p
    return out


def rewrite(sql: str | list[Token], literals: dict[str, str] | None = None, collations: dict[str, str] | None = None) -> str:
    """Spark's spelling of a query or an expression. literals: calls that stand for a value of the engine, such as CHANGES(); collations: functions that make a text's sort key, by the collation's name."""
    return Rewriter(tokenize(sql) if isinstance(sql, str) else sql, literals, collations).run()
