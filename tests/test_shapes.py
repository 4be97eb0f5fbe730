"""Headers, titles and totals, facets, and counters of steps."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import Frame
from millrace.plans import insights, pipeline, recipe_text
from millrace.sources import headers, readers


def frame(spark, rows):
    width = max(map(len, rows), default=1)
    return Frame.of(spark.createDataFrame([(k, *r, *[""] * (width - len(r))) for k, r in enumerate(rows)], "__n long, " + ", ".join(f"column_{i + 1} string" for i in range(width))), "__n")


def cells(f):
    return f.columns, [["" if v is None else v for v in r] for r in f.sorted().collect()]


@pytest.mark.parametrize(
    ("rows", "names", "want"),
    [
        ([["id", "amount"], ["a", "1"], ["b", "2"]], ["id", "amount"], [["a", "1"], ["b", "2"]]),
        ([["Report", ""], ["id", "amount"], ["a", "1"], ["Total", "1"]], ["id", "amount"], [["a", "1"]]),
        ([["1", "2"], ["3", "4"]], None, [["1", "2"], ["3", "4"]]),
        ([["a", "a"], ["1", "2"]], None, [["a", "a"], ["1", "2"]]),
        ([["Ann", "Oslo"], ["Bo", "Ann"], ["Ann", "Rome"]], None, [["Ann", "Oslo"], ["Bo", "Ann"], ["Ann", "Rome"]]),
        ([["name", "town"], ["Ann", "Oslo"]], ["name", "town"], [["Ann", "Oslo"]]),
        ([["2024-01-02", "x"], ["2024-01-03", "y"]], None, [["2024-01-02", "x"], ["2024-01-03", "y"]]),
        ([["name", ""], ["Ann", "1"], ["", ""], ["Sum", "1"]], None, [["Ann", "1"]]),
        ([["total", "n"], ["a", "1"]], ["total", "n"], [["a", "1"]]),
        ([["x"]], ["x"], []),
    ],
)
def test_headers(spark, rows, names, want):
    f = frame(spark, rows)
    assert cells(headers.tidied(f)) == (names or f.columns, want)


def test_header_edges(spark, tmp_path):
    assert cells(headers.tidied(frame(spark, [["a"]]).with_df(frame(spark, [["a"]]).df.where("false")))) == (["column_1"], [])
    (tmp_path / "a.csv").write_text('Sales of 2024\n\nid,"the, name",price\n1,"x\ny",2.5\n2,z,3\nTotal,,5.5\n')
    assert cells(readers.delimited(spark, str(tmp_path / "a.csv"), header=None)) == (["id", "the, name", "price"], [["1", "x\ny", "2.5"], ["2", "z", "3"]])
    lines = lambda *t: Frame.of(spark.createDataFrame(list(enumerate(t)), "__n long, line string"), "__n")
    assert cells(readers.markdown_table(lines("text", "| a | a |", "|--|--|", "| 1\\|2 | 3 |"))) == (["a", "a_2"], [["1|2", "3"]])
    assert cells(readers.box_table(lines(" id | st ", "----+----", " 1  | F ", "(1 row)"))) == (["id", "st"], [["1", "F"]])
    assert cells(readers.markdown_table(lines("| 1 | 2 |", "| 3 | 4 |"))) == (["column_1", "column_2"], [["1", "2"], ["3", "4"]])
    assert cells(readers.markdown_table(lines("no table"))) == ([], [[]]) or readers.markdown_table(lines("no table")).columns == []


def test_facets(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), (" b ", None, 4), ("", "x", 5), (None, "z", None)], "p string, q string, n int")
    f = Frame.of(df, "n")
    filters = {"p": F.col("p") == "a", "q": F.col("q") == "x", "n": F.col("n") > 1}
    got = sorted(tuple(r) for r in insights.facets(f, filters, ["p", "q", "n"]).collect())
    assert got == [("n", "1", 1), ("p", "b", 1), ("q", "y", 1)]
    assert sorted(tuple(r) for r in insights.facets(f, {}, ["p"]).collect()) == [("p", "a", 2), ("p", "b", 2)]
    plan = insights.facets(f, filters)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 1


def test_counters(spark):
    f = frame(spark, [["a", " x"], ["b", "y "], ["", "z"], ["a", " x"]])
    text = 'trim "column_2"\nremove rows where "column_1" is empty\njoin "gone" left on "column_1" = "q"\nfill down *\nremove duplicates\ngroup by "column_1" calculate "count"\n#! trim *'
    out, found = pipeline.counted(f, recipe_text.steps_of(text))
    assert cells(out.frame) == (["column_1", "count"], [["a", 1], ["b", 1]])
    counts = [tuple(c.values())[1:] for c in found]
    assert counts == [(4, 4, 3), (4, 3, 0), (3, 3, 0), (3, 2, 0), (2, 2, None)] and list(out.errors) == ['3: join "gone" left on "column_1" = "q"']
