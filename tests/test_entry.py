import importlib.util
import math
import os
import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def names():
    return sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


@pytest.mark.parametrize("name", names())
def test_query_against_sql(spark, name):
    import duckdb

    df = entry.queries()[name](spark, SF)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, got) == rows_of(rel.columns, rel.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_library_does_not_import_llm():
    import paceline

    base = os.path.dirname(paceline.__file__)
    for folder, _, files in os.walk(base):
        if "llm" not in folder:
            for f in (f for f in files if f.endswith(".py")):
                with open(os.path.join(folder, f), encoding="utf-8") as text:
                    assert not re.search(r"\bllm\b", text.read()), f
    assert importlib.util.find_spec("paceline.plans.catalog")
