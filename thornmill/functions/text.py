"""Patterns, quoting and type names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """The anchored regular expression of a GLOB pattern: * any run, ? any one, [..] and [^..] classes; case counts."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        close = pattern.find("]", k + 2 + (pattern[k + 1 : k + 2] == "^")) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = pattern[k + 1 : close]
            sign, body = ("^", body[1:]) if body[:1] in ("^", "!") else ("", body)
            out.append(f"[{sign}{body.replace(chr(92), chr(92) * 2).replace('[', chr(92) + '[')}]")
            k = close
        else:
            out.append("\\" + c if not c.isalnum() and c not in " _" and ord(c) < 128 else c)
        k += 1
    return f"(?s)^{''.join(out)}$"


def glob(column: Column | str, pattern: str) -> Column:
    return F.rlike(column if isinstance(column, Column) else F.col(column), F.lit(glob_regex(pattern)))


def typeof_sql(x: str) -> str:
    """null, integer, real, text or blob; the type is known when the query is analysed, so this folds to a null test."""
    return f"CASE WHEN ({x}) IS NULL THEN 'null' WHEN typeof({x}) IN ('tinyint', 'smallint', 'int', 'bigint', 'boolean') THEN 'integer' WHEN typeof({x}) IN ('float', 'double') OR typeof({x}) LIKE 'decimal%' THEN 'real' WHEN typeof({x}) = 'binary' THEN 'blob' ELSE 'text' END"


def quote_sql(x: str) -> str:
    """The value as an SQL literal."""
    return f"CASE WHEN ({x}) IS NULL THEN 'NULL' WHEN typeof({x}) = 'binary' THEN concat('X''', hex({x}), '''') WHEN typeof({x}) IN ('string') THEN concat('''', replace(cast({x} AS string), '''', ''''''), '''') ELSE cast({x} AS string) END"


def integer_sql(x: str) -> str:
    """CAST(x AS INTEGER): of a text, the number that it begins with, else 0."""
    return f"if(typeof({x}) = 'string', if(({x}) IS NULL, NULL, coalesce(try_cast(regexp_extract(cast({x} AS string), '^\\\\s*([+-]?[0-9]+)', 1) AS bigint), 0L)), try_cast({x} AS bigint))"


def real_sql(x: str) -> str:
    """CAST(x AS REAL): of a text, the number that it begins with, else 0."""
    return f"if(typeof({x}) = 'string', if(({x}) IS NULL, NULL, coalesce(try_cast(regexp_extract(cast({x} AS string), '^\\\\s*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)', 1) AS double), 0.0D)), try_cast({x} AS double))"
