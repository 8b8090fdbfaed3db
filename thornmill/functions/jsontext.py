"""JSON texts: queries of them are native expressions; edits keep key order, which takes a Python function (Arrow batches)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEP = re.compile(r"""\.(?:"((?:[^"\\]|\\.)*)"|([^.\["]+))|\[(#-)?(-?\d+)\]""")


def valid_sql(x: str) -> str:
    return f"if({x} IS NULL, NULL, if(try_parse_json({x}) IS NOT NULL, 1, 0))"


def type_sql(x: str, path: str | None = None) -> str:
    v = f"try_parse_json({x})" if path is None else f"try_variant_get(try_parse_json({x}), {path}, 'variant')"
    kind = f"schema_of_variant({v})"
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN {kind} = 'VOID' THEN 'null' WHEN {kind} LIKE 'OBJECT%' THEN 'object' WHEN {kind} LIKE 'ARRAY%' THEN 'array' WHEN {kind} = 'STRING' THEN 'text' WHEN {kind} = 'BOOLEAN' THEN to_json({v}) WHEN {kind} = 'BIGINT' THEN 'integer' ELSE 'real' END"


def at_sql(x: str, path: str) -> str:
    """What is at a path: quoted keys and indexes from an array's end ([-1], [#-1]) in Spark's spelling."""
    if not path.startswith("'"):
        return f"get_json_object({x}, {path})"
    found, now = x, "$"
    for m in re.finditer(r"""\."((?:[^"\\]|\\.)*)"|\[#?-(\d+)\]|\.[^.\["]+|\[\d+\]""", path[1:-1].removeprefix("$")):
        if m[2]:
            found = found if now == "$" else f"get_json_object({found}, '{now}')"
            found, now = f"get_json_object({found}, concat('$[', json_array_length({found}) - {m[2]}, ']'))", "$"
        else:
            now += f"[\\'{m[1]}\\']" if m[1] is not None and re.search(r"\W", m[1]) else f".{m[1]}" if m[1] is not None else m[0]
    return found if now == "$" and found != x else f"get_json_object({found}, '{now}')"


def extract_sql(x: str, *paths: str) -> str:
    found = [at_sql(x, p) for p in paths]
    return found[0] if len(found) == 1 else f"coalesce({', '.join(found)})"


def length_sql(x: str, path: str | None = None) -> str:
    at = x if path is None else f"get_json_object({x}, {path})"
    return f"if({at} LIKE '[%', json_array_length({at}), if(try_parse_json({at}) IS NULL, NULL, 0))"


def steps(path: str) -> list[str | int] | None:
    """Keys and indexes of a path such as $.a."b c"[0][#-1]; None if it is no path."""
    if not path.startswith("$"):
        return None
    found, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            return None
        key = m[1] if m[1] is not None else m[2]
        found.append(key if key is not None else (-int(m[4]) if m[3] else int(m[4])))
        at = m.end()
    return found


def _edit(value, path: list[str | int], new, insert: bool, replace: bool):
    if not path:
        return new if replace else value
    step, rest = path[0], path[1:]
    if isinstance(step, str) and isinstance(value, dict):
        if step in value:
            value[step] = _edit(value[step], rest, new, insert, replace)
        elif insert:
            value[step] = new if not rest else _edit({} if isinstance(rest[0], str) else [], rest, new, insert, replace)
    elif isinstance(step, int) and isinstance(value, list):
        at = step if step >= 0 else len(value) + step
        if 0 <= at < len(value):
            value[at] = _edit(value[at], rest, new, insert, replace)
        elif insert and at == len(value):
            value.append(new if not rest else _edit({} if isinstance(rest[0], str) else [], rest, new, insert, replace))
    return value


def _drop(value, path: list[str | int]):
    if not path:
        return None
    step, rest = path[0], path[1:]
    if isinstance(step, str) and isinstance(value, dict) and step in value:
        if rest:
            _drop(value[step], rest)
        else:
            del value[step]
    elif isinstance(step, int) and isinstance(value, list) and -len(value) <= step < len(value):
        if rest:
            _drop(value[step], rest)
        else:
            del value[step]
    return value


def dumps(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def edit(text: str | None, pairs: list, insert: bool, replace: bool) -> str | None:
    """The text with each (path, value) put in; None for malformed JSON."""
    try:
        value = json.loads(text) if text is not None else None
    except ValueError:
        return None
    if text is None:
        return None
    for path, new in pairs:
        if (found := steps(path)) is not None:
            value = _edit(value, found, new, insert, replace)
    return dumps(value)


def remove(text: str | None, paths: list[str]) -> str | None:
    try:
        value = json.loads(text) if text is not None else None
    except ValueError:
        return None
    if text is None:
        return None
    for path in paths:
        if (found := steps(path)) is not None:
            value = _drop(value, found)
    return dumps(value)


def _plain(x):
    return x.item() if hasattr(x, "item") else x


def register(spark) -> None:
    """json_set, json_insert, json_replace, json_remove, json_pretty and json_minify as SQL functions (a text, an array of paths, a JSON array of values)."""

    def editor(insert: bool, replace: bool):
        @F.pandas_udf(T.StringType())
        def run(text: pd.Series, paths: pd.Series, values: pd.Series) -> pd.Series:
            return pd.Series([edit(t, list(zip(p, json.loads(v), strict=True)), insert, replace) for t, p, v in zip(text, paths, values, strict=True)], dtype=object)

        return run

    @F.pandas_udf(T.StringType())
    def remover(text: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([remove(t, list(p)) for t, p in zip(text, paths, strict=True)], dtype=object)

    def rewriter(**how):
        @F.pandas_udf(T.StringType())
        def run(text: pd.Series) -> pd.Series:
            def one(t):
                try:
                    return None if t is None else json.dumps(json.loads(t), ensure_ascii=False, **how)
                except ValueError:
                    return None

            return pd.Series([one(t) for t in text], dtype=object)

        return run

    for name, function in (("tm_json_set", editor(True, True)), ("tm_json_insert", editor(True, False)), ("tm_json_replace", editor(False, True)), ("tm_json_remove", remover), ("tm_json", rewriter(separators=(",", ":"))), ("tm_json_pretty", rewriter(indent=4))):
        spark.udf.register(name, function)
