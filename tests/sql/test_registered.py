"""Every registered query of the engine has its SQL; the quick ones are held against DuckDB here."""

import duckdb
import pytest

from thornmill import plans
from thornmill.plans.base import TABLES
from thornmill.sources.sinks import render

SF = "/root/testdata/sf0.001"
QUICK = ["agg_pricing_summary", "filter_glob", "join_range", "win_groups_frame", "win_exclude_current", "fn_strftime", "json_type_valid", "fts_near", "fts_phrase", "fts_bm25", "dml_upsert_update", "fk_cascade"]


def test_each_has_its_oracle():
    assert set(plans.queries()) == set(plans.oracle_sql())


@pytest.mark.parametrize("name", QUICK)
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = plans.queries()[name](spark, SF)
    want = con.sql(plans.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    plain = lambda rows, names: sorted(str([float(x) if isinstance(x, (int, float)) else str(x) for x in (r[names.index(c)] for c in order)]) for r in rows)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)


def test_sinks():
    names, data = ["a", "b"], [(1, None), (2, "x'y")]
    assert render(names, data) == "1|\n2|x'y"
    assert render(names, data, "csv", True) == "a,b\n1,\n2,x'y"
    assert render(names, data, "insert", table="q").splitlines()[1] == "INSERT INTO q VALUES(2,'x''y');"
    assert render(names, data, "json") == '[{"a": 1, "b": null}, {"a": 2, "b": "x\'y"}]'
    assert render(names, data, "box").splitlines()[0].startswith("┌")
