"""Pages and searches of a table kept in order, against plain lists; they open only the ranges they need."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import Frame
from millrace.operators.order_index import OrderIndex


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(2)
    rows = [(k, r.choice([None, "a", "b", "c`d"]), r.choice([None, *range(9)])) for k in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    f = Frame.of(spark.createDataFrame(rows, "k int, `x.y` string, n int"), ("n", False), "k")
    index = OrderIndex.of(f)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return index, sorted(rows, key=lambda t: (t[2] is None, -(t[2] or 0), t[0]))


def opened(df):
    return len({p.split("__range=")[1].split("/")[0] for p in df.inputFiles()})


def test_pages(table):
    index, rows = table
    assert len(index) == 4000 and len(index.ranges) == 4
    for start, count in ((0, 20), (2000, 50), (3990, 50), (-5, 10), (4000, 5), (7, 0)):
        assert [tuple(r) for r in index.page(start, count).collect()] == rows[max(start, 0) : max(start + count, 0)]
    assert [tuple(r) for r in index.page(0, 4000).collect()] == rows
    assert opened(index.page(0, 20)) == 1 and opened(index.page(index.ends[1] + 5, 20)) == 1 and opened(index.page(index.ends[1] - 3, 6)) == 2


@pytest.mark.parametrize("back", [False, True])
def test_find(table, back):
    index, rows = table
    for hit, test in ((F.col("`x.y`") == "c`d", lambda t: t[1] == "c`d"), (F.col("k") == 1234, lambda t: t[0] == 1234), (F.col("k") < 0, lambda t: False)):
        where = [i for i, t in enumerate(rows) if test(t)]
        for after in (-1, 0, 1999, 3999):
            for wrap in (True, False):
                beyond = [i for i in reversed(where) if i < after] if back else [i for i in where if i > after]
                round_ = (where[::-1] if back else where) if wrap else []
                assert index.find(hit, after, back, wrap) == next(iter(beyond + round_), None)


def test_empty(spark):
    index = OrderIndex.of(Frame.of(spark.createDataFrame([], "k int, v string"), "k"))
    assert len(index) == 0 and index.page(0, 5).collect() == [] and index.find(F.lit(True)) is None and index.find(F.lit(True), back=True) is None
