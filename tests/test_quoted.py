"""Quoted text read by ranges gives what reading it whole gives."""

from __future__ import annotations

import csv
import random

import pytest

from millrace.sources import quoted, readers


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def shown(f):
    return [tuple(r) for r in f.sorted().collect()]


def test_ranges_equal_the_whole(spark, tmp_path, small_ranges):
    r = random.Random(4)
    bits = ["a", "", "x,y", 'say ""hi""', "two\nlines", "\n\n", ' "in" ', "é" * 30, "long " * 60, "a\n,b\n\"\n,", '5" pipe', '"']
    rows = [[str(k), *(r.choice(bits) for _ in range(3))] for k in range(300)]
    for part in range(2):
        with (tmp_path / f"{part}.csv").open("w", newline="") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow(["id", "b c", "b c", ""])
            w.writerows(rows[part * 150 : part * 150 + 150])
    f, unclosed = quoted.delimited_ranges(spark, str(tmp_path))
    assert f.df.select("__file", "__block").distinct().count() > 40 and unclosed == []
    assert f.columns == ["id", "b c", "b c_2", "column_4"] and shown(f) == [tuple(r) for r in rows]
    assert sorted(shown(f)) == sorted(map(tuple, readers.delimited(spark, str(tmp_path)).result().collect()))


def test_unclosed_quote_keeps_all_rows(spark, tmp_path, small_ranges):
    lines = ["k,v", *(f'{k},"v{k}"' for k in range(60)), '60,"never', *(f"{k},w" for k in range(61, 90))]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text('k,v\r\n1,"fi\r\nne"\r\n')
    f, unclosed = quoted.delimited_ranges(spark, str(tmp_path))
    assert [u.rsplit("/", 1)[1] for u in unclosed] == ["a.csv"]
    assert shown(f) == [tuple(x.split(",")) for x in lines[1:]] + [("1", "fi\nne")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []),
        ("a;b", [("a", "b")]),
        ("﻿\"a\";b\n\n;\n1", [("a", "b"), ("", ""), ("1", "")]),
        ('x"y";b"\n"q"r;"s"\n', [('x"y"', 'b"'), ('"q"r', "s")]),
        ('"";""\n"\n\n";"z"""\n', [("", ""), ("\n\n", 'z"')]),
    ],
)
def test_small_texts(spark, tmp_path, text, want):
    (tmp_path / "t.csv").write_text(text)
    assert shown(quoted.delimited_ranges(spark, str(tmp_path / "t.csv"), ";", header=False)[0]) == want or want == []
    assert quoted.records(spark, str(tmp_path / "t.csv"), ";").count() == len(want)


def test_delimiters(spark, tmp_path):
    for bad in ('"', "", "||", "\n"):
        with pytest.raises(ValueError, match="delimiter"):
            quoted.delimited_ranges(spark, str(tmp_path), bad)


def test_files_keep_their_order(spark, tmp_path):
    """Spark reads large files first; rows come back by file and place nonetheless."""
    names = {"a": 3, "b": 400, "c": 60}
    want = [f"{f}{k}" for f, n in names.items() for k in range(n)]
    for kind in ("txt", "csv", "json"):
        (tmp_path / kind).mkdir()
    for f, n in names.items():
        said = [f"{f}{k}" for k in range(n)]
        (tmp_path / "txt" / f"{f}.txt").write_text("".join(f"{x}\n" for x in said))
        (tmp_path / "csv" / f"{f}.csv").write_text("v\n" + "".join(f"{x}\n" for x in said))
        (tmp_path / "json" / f"{f}.json").write_text('{"pad": "%s", "v": "%s"}' % ("x" * n, f))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("600", old["spark.sql.files.maxPartitionBytes"]):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            placed = readers.lines(spark, str(tmp_path / "txt")).positioned("pos").orderBy("pos").collect()
            assert [r["line"] for r in placed] == want and [r["pos"] for r in placed] == list(range(1, len(want) + 1))
            for breaks in (True, False):
                assert [x for x, in shown(readers.delimited(spark, str(tmp_path / "csv"), breaks=breaks))] == want
            assert [r["v"] for r in readers.json_document(spark, str(tmp_path / "json")).sorted().collect()] == ["a", "b", "c"]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_lines_stay_where_they_are_read(spark, tmp_path):
    """Lines are not shuffled; only those of records over the end of a range are grouped. Blank lines before a header don't hide it."""
    (tmp_path / "t.csv").write_text('\n\nk,v\n1,"a\nb"\n')
    rows = quoted.records(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
    f, _ = quoted.delimited_ranges(spark, str(tmp_path))
    assert f.columns == ["k", "v"] and shown(f) == [("1", "a\nb")]


def test_unclosed_files_keep_their_size(spark, tmp_path, monkeypatch):
    """The query's files hold some 5,000 orders each, so their number stays far below the hundreds'."""
    from millrace.plans import catalog, roundtrips

    monkeypatch.setattr(roundtrips, "new_path", lambda _, tag: str(tmp_path / tag))
    rows = catalog.QUERIES["read_unclosed_quotes"](spark, "/root/testdata/sf0.01").count()
    assert rows == 15_075 and len(list(tmp_path.glob("**/*.txt"))) == 4
