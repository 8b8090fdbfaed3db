"""Scalar functions, JSON, table functions and user-defined functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import jsontext, temporal
from ..functions.text import glob, quote_sql, typeof_sql
from ..sources.tables import generate_series, json_rows
from .base import Family, load, sql

F3 = Family()

# --- text, conditions, types
F3.same("fn_text", "SELECT n_nationkey, CAST(length(n_name) AS BIGINT) AS len, upper(n_name) AS up, lower(n_name) AS low, n_name || '!' AS ex FROM {nation}")
F3.same("fn_substr_instr", "SELECT p_partkey, substr(p_name, 2, 4) AS s, substr(p_name, 3) AS t, CAST(instr(p_name, 'a') AS BIGINT) AS i FROM {part}")
F3.same("fn_trim_replace", "SELECT c_custkey, replace(c_name, '0', 'o') AS r, trim('  ' || c_mktsegment || '  ') AS t, ltrim('  ' || c_mktsegment) AS l, rtrim(c_mktsegment || '  ') AS e FROM {customer}")
F3.same("fn_conditional", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 0), -1) AS c, nullif(n_name, 'CHINA') AS n, ifnull(nullif(n_regionkey, 2), 9) AS i FROM {nation}")
F3.both("fn_hex_unicode", "SELECT n_nationkey, hex(n_name) AS h, ascii(n_name) AS u, chr(65 + n_nationkey) AS c FROM {nation}", "SELECT n_nationkey, hex(n_name) AS h, CAST(unicode(n_name) AS INTEGER) AS u, chr(65 + n_nationkey) AS c FROM nation")
F3.both("fn_quote", f"SELECT n_nationkey, {quote_sql('n_name')} AS q, {quote_sql('n_regionkey')} AS r FROM {{nation}}", "SELECT n_nationkey, '''' || replace(n_name, '''', '''''') || '''' AS q, CAST(n_regionkey AS VARCHAR) AS r FROM nation")
F3.both("fn_typeof", f"SELECT p_partkey, {typeof_sql('p_partkey')} AS a, {typeof_sql('p_retailprice')} AS b, {typeof_sql('p_name')} AS c, {typeof_sql('nullif(p_size, 1)')} AS d FROM {{part}}", "SELECT p_partkey, 'integer' AS a, 'real' AS b, 'text' AS c, CASE WHEN nullif(p_size, 1) IS NULL THEN 'null' ELSE 'integer' END AS d FROM part")
F3.both("fn_zeroblob", "SELECT n_nationkey, hex(unhex(repeat('00', n_nationkey % 4))) AS z FROM {nation}", "SELECT n_nationkey, repeat('00', n_nationkey % 4) AS z FROM nation")


@F3.code("filter_glob", "SELECT p_partkey, p_brand FROM part WHERE p_brand GLOB 'Brand#[12]?'")
def _glob(spark, sf_dir):
    return load(spark, sf_dir, "part").where(glob("p_brand", "Brand#[12]?")).select("p_partkey", "p_brand")


# --- numbers
F3.both(
    "fn_math",
    "SELECT l_orderkey, l_linenumber, abs(l_tax - 0.05) AS a, CAST(ceil(l_quantity / 3) AS BIGINT) AS c, CAST(floor(l_quantity / 3) AS BIGINT) AS f, round(sqrt(l_quantity), 9) AS s, round(ln(l_quantity), 9) AS n, round(log10(l_quantity), 9) AS t, round(exp(l_discount), 9) AS e, round(power(l_quantity, 1.5), 6) AS p, CAST(sign(l_discount - 0.05) AS BIGINT) AS g FROM {lineitem}",
    "SELECT l_orderkey, l_linenumber, abs(l_tax - 0.05) AS a, CAST(ceil(l_quantity / 3) AS BIGINT) AS c, CAST(floor(l_quantity / 3) AS BIGINT) AS f, round(sqrt(l_quantity), 9) AS s, round(ln(l_quantity), 9) AS n, round(log10(l_quantity), 9) AS t, round(exp(l_discount), 9) AS e, round(power(l_quantity, 1.5), 6) AS p, CAST(sign(l_discount - 0.05) AS BIGINT) AS g FROM lineitem",
)
F3.same("fn_trig", "SELECT l_linenumber AS k, round(sin(l_linenumber), 9) AS s, round(cos(l_linenumber), 9) AS c, round(tan(l_linenumber), 9) AS t, round(asin(1 / CAST(l_linenumber AS DOUBLE)), 9) AS xs, round(acos(1 / CAST(l_linenumber AS DOUBLE)), 9) AS xc, round(atan(l_linenumber), 9) AS xt, round(atan2(l_linenumber, 2), 9) AS x2, round(degrees(l_linenumber), 6) AS d, round(radians(l_linenumber), 9) AS r, round(pi(), 9) AS p FROM {lineitem} WHERE l_orderkey < 200")
F3.same("fn_hyperbolic", "SELECT n_nationkey, round(sinh(CAST(n_nationkey AS DOUBLE) / 10), 9) AS s, round(cosh(CAST(n_nationkey AS DOUBLE) / 10), 9) AS c, round(tanh(CAST(n_nationkey AS DOUBLE) / 10), 9) AS t, round(asinh(n_nationkey), 9) AS xs, round(acosh(n_nationkey + 1), 9) AS xc, round(atanh(CAST(n_nationkey AS DOUBLE) / 30), 9) AS xt, round(log2(n_nationkey + 1), 9) AS l FROM {nation}")
#: Ties go away from zero: Spark rounds the decimal that is printed; DuckDB scales the double, which is exact for ties of prices in cents up to 2,000,000 at least.
F3.same("fn_round", "SELECT o_orderkey, round(o_totalprice, 1) AS a, round(o_totalprice, 0) AS b FROM {orders}")

# --- dates
_T = "o_orderdate"
_day = temporal.date(_T)
F3.both("fn_date", f"SELECT o_orderkey, {temporal.date(_T)} AS d, {temporal.time(_T)} AS t, {temporal.datetime(_T)} AS dt FROM {{orders}}", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS dt FROM orders")
F3.both("fn_datetime_mods", f"SELECT o_orderkey, {temporal.date(_T, ['start of month'])} AS m, {temporal.date(_T, ['+10 days'])} AS p, {temporal.date(_T, ['start of year', '+1 month'])} AS y, {temporal.datetime(_T, ['-90 minutes'])} AS b, {temporal.date(_T, ['weekday 0'])} AS w FROM {{orders}}", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS p, strftime(date_trunc('year', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS y, strftime(o_orderdate - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS b, strftime(o_orderdate + CAST((7 - dayofweek(o_orderdate)) % 7 AS INTEGER) * INTERVAL 1 DAY, '%Y-%m-%d') AS w FROM orders")
F3.both("fn_strftime", f"SELECT o_orderkey, {temporal.strftime('%d/%m/%Y %H:%M:%S', _T)} AS a, {temporal.strftime('%j %w', _T)} AS b FROM {{orders}}", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') AS a, strftime(o_orderdate, '%j %w') AS b FROM orders")
F3.both("fn_julianday", f"SELECT o_orderkey, round({temporal.julianday(_T)}, 6) AS j FROM {{orders}}", "SELECT o_orderkey, round(epoch(o_orderdate) / 86400 + 2440587.5, 6) AS j FROM orders")
F3.both("fn_unixepoch", f"SELECT o_orderkey, {temporal.unixepoch(_T)} AS u FROM {{orders}}", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS u FROM orders")
F3.both("fn_from_unixepoch", f"SELECT event_id, {temporal.datetime('event_id * 86400', ['unixepoch'])} AS d FROM {{events}}", "SELECT event_id, strftime(make_timestamp(event_id * 86400000000), '%Y-%m-%d %H:%M:%S') AS d FROM events")

# --- JSON
F3.both("json_extract", f"SELECT event_id, CAST({jsontext.extract_sql('props', chr(39) + '$.k' + chr(39))} AS BIGINT) AS k FROM {{events}}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
F3.both(
    "json_type_valid",
    f"SELECT event_id, {jsontext.valid_sql('props')} AS v, {jsontext.valid_sql('event_type')} AS bad, {jsontext.type_sql('props')} AS t, {jsontext.type_sql('props', chr(39) + '$.k' + chr(39))} AS k FROM {{events}}",
    "SELECT event_id, CAST(json_valid(props) AS INTEGER) AS v, 0 AS bad, 'object' AS t, 'integer' AS k FROM events",
)
F3.both("json_array_len", f"SELECT n_nationkey, {jsontext.length_sql('j')} AS n FROM (SELECT n_nationkey, to_json(sequence(0, n_regionkey)) AS j FROM {{nation}}) t", "SELECT n_nationkey, CAST(n_regionkey + 1 AS INTEGER) AS n FROM nation")
F3.both("json_build", "SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'name', n_name)) AS o, to_json(array(n_nationkey, n_regionkey)) AS a FROM {nation}", "SELECT n_nationkey, CAST(json_object('k', n_nationkey, 'name', n_name) AS VARCHAR) AS o, CAST(json_array(n_nationkey, n_regionkey) AS VARCHAR) AS a FROM nation")


@F3.code("json_set_replace", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"new\":' || event_id || '}' AS s, '{\"k\":0}' AS r, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS i FROM events")
def _json_set(spark, sf_dir):
    jsontext.register(spark)
    return load(spark, sf_dir, "events").select(
        "event_id",
        F.expr("tm_json_set(props, array('$.new'), concat('[', event_id, ']'))").alias("s"),
        F.expr("tm_json_replace(props, array('$.k', '$.none'), '[0, 1]')").alias("r"),
        F.expr("tm_json_insert(props, array('$.k'), '[5]')").alias("i"),
    )


@F3.code("json_remove", "SELECT event_id, '{}' AS r FROM events")
def _json_remove(spark, sf_dir):
    jsontext.register(spark)
    return load(spark, sf_dir, "events").select("event_id", F.expr("tm_json_remove(props, array('$.k'))").alias("r"))


# --- table functions
@F3.code("tvf_generate_series", "SELECT generate_series AS value FROM generate_series(5, 100, 5)")
def _series(spark, sf_dir):
    return generate_series(spark, 5, 100, 5)


@F3.code("tvf_json_each", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value, 'integer' AS type, '$.k' AS fullkey FROM events")
def _each(spark, sf_dir):
    return json_rows(load(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "key", "value", "type", "fullkey")


@F3.code("tvf_json_tree", "SELECT event_id, CAST(NULL AS VARCHAR) AS key, 'object' AS type, '$' AS fullkey FROM events UNION ALL SELECT event_id, 'k', 'integer', '$.k' FROM events")
def _tree(spark, sf_dir):
    return json_rows(load(spark, sf_dir, "events").select("event_id", "props"), "props", deep=True).select("event_id", "key", "type", "fullkey")


F3.queries["tvf_variant_explode"] = sql("SELECT e.event_id, t.key, CAST(t.value AS BIGINT) AS value FROM {events} e, LATERAL variant_explode(parse_json(e.props)) t")
F3.oracles["tvf_variant_explode"] = "SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events"


# --- functions in Python
@F3.code("udf_scalar", "SELECT n_nationkey, reverse(n_name) AS r FROM nation")
def _udf(spark, sf_dir):
    from ..session import Engine

    engine = Engine(spark)
    engine.attach("nation", load(spark, sf_dir, "nation"))
    engine.create_function("backwards", 1, lambda s: None if s is None else s[::-1], deterministic=True)
    return engine.execute("SELECT n_nationkey, backwards(n_name) AS r FROM nation")


class SumOfSquares:
    def __init__(self) -> None:
        self.total = 0.0

    def step(self, x) -> None:
        if x is not None and not pd.isna(x):
            self.total += float(x) * float(x)

    def final(self) -> float:
        return self.total


@F3.code("udaf_sumsq", "SELECT l_returnflag, round(sum(l_quantity * l_quantity), 2) AS s FROM lineitem GROUP BY l_returnflag")
def _udaf(spark, sf_dir):
    from ..session import Engine

    engine = Engine(spark)
    engine.attach("lineitem", load(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"))
    engine.create_aggregate("sumsq", 1, SumOfSquares)
    return engine.execute("SELECT l_returnflag, round(sumsq(l_quantity), 2) AS s FROM lineitem GROUP BY l_returnflag")


@F3.code("udtf_split", "SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation")
def _udtf(spark, sf_dir):
    from ..session import Engine

    engine = Engine(spark)
    engine.attach("nation", load(spark, sf_dir, "nation"))
    engine.create_table_function("words", lambda text: ((w,) for w in text.split(" ")), "word string")
    return engine.spark.sql("SELECT n.n_nationkey, w.word FROM nation n, LATERAL words(n.n_name) w")
