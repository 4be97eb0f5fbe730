"""Every query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import datetime as dt
import math
import re
from collections import Counter
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from millrace.functions import values
from millrace.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int | float | Decimal):
        return f"{float(v):.8g}" if math.isfinite(v) else str(v)
    if isinstance(v, dt.datetime | dt.date):
        return v.isoformat()[:10]
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.SQL:
        assert name in ("issues_documents", "html_tables")
        return
    want = con.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in sorted(df.columns)]
    mine = Counter(tuple(shown(r[c]) for c in sorted(df.columns)) for r in rows)
    assert mine == Counter(tuple(shown(r[k]) for k in place) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_pushdown(spark):
    """Filters and column selection reach the scan, and no Python runs in the core queries' plans."""
    plan = catalog.QUERIES["filter_cmp_in"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,100000.0)" in plan and "o_orderdate" not in plan.split("ReadSchema")[1]
    for name in ("fill_down", "diff", "aggregate_all", "convert_numbers", "split_to_rows"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_whole_tables(spark):
    """The steps that leave rows out in one query run over all rows in another."""
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    texts = {r["doc_id"]: r["text"] for r in read("documents").collect()}
    assert any("\n" in t for t in texts.values())
    space = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    want = {i: re.sub("[ \t\u00a0]+", " ", t).strip(space) for i, t in texts.items()}
    assert {r["doc_id"]: r["text_trimmed"] for r in catalog.QUERIES["trim_collapse_whole"](spark, SF).collect()} == want
    diffs = Counter(r["_diff"] for r in catalog.QUERIES["diff_whole"](spark, SF).collect())
    assert sum(diffs.values()) == read("part").count() and min(diffs[k] for k in ("added", "removed", "changed", "unchanged")) > 0
    orders = {r["o_orderkey"]: r["o_orderdate"].date() for r in read("orders").collect()}
    got = {r["o_orderkey"]: (r["days"], r["months"]) for r in catalog.QUERIES["formula_datedif_whole"](spark, SF).collect()}
    ends = {i: sorted([d, dt.date(1999, 2, 28)]) for i, d in orders.items()}
    assert got == {i: (abs((orders[i] - dt.date(1999, 1, 1)).days), (b.year - a.year) * 12 + b.month - a.month - (b.day < a.day)) for i, (a, b) in ends.items()}
    assert {d.day for d in orders.values()} >= {29, 30, 31} and max(orders.values()).year > 1998


def test_strip_ends_of_the_whole_text(spark):
    cells = ["\u00a0 a\u00a0\u00a0b \u3000", " a\n b\r\n", "a \x85", "\u2003é\ufeff", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(values.collapse(F.col("c"))).collect()] == ["a b", "a\n b", "a \x85", "é", None]
