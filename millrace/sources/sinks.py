"""Sinks: a Frame's visible columns as text files, written by the executors in the frame's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.values import as_text, named, parse_number, quoted
from millrace.operators.frame import Frame


def texts(f: Frame) -> DataFrame:
    """All visible columns in canonical text, in order."""
    return f.sorted().select(*[as_text(named(c), f.kind(c)).alias(c) for c in f.columns])


def guarded(c: Column) -> Column:
    """Cells that a spreadsheet would take for a formula get a ' in front, unless they are numbers."""
    risky = c.rlike(r"^[=+\-@\t\r]") & parse_number(c, "us").isNull() & parse_number(c, "eu").isNull()
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def quoted(c: Column, delimiter: str) -> Column:
    needs = c.rlike(r'["\r\n]') | c.contains(delimiter)
    return F.when(needs, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def _headed(f: Frame, rows: DataFrame, *head: str) -> DataFrame:
    """rows under lines of their own, which come first."""
    return f.df.sparkSession.createDataFrame([(h,) for h in head], "value string").coalesce(1).unionByName(rows)


def csv_lines(f: Frame, delimiter: str = ",", guard: bool = False, header: bool = True) -> DataFrame:
    """The names and a line of text for each row, fields quoted only where they must be."""
    cells = [quoted(guarded(named(c)) if guard else named(c), delimiter) for c in f.columns]
    rows = texts(f).select(F.concat_ws(delimiter, *cells).alias("value"))
    say = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in ('"', "\r", "\n", delimiter)) else c
    return _headed(f, rows, delimiter.join(map(say, f.columns))) if header else rows


def write_csv(f: Frame, path: str, delimiter: str = ",", header: bool = True, guard: bool = False) -> None:
    """Part files in order. `header` writes the names as the first line of each."""
    out = texts(f)
    out = out.select(*[guarded(named(c)).alias(c) for c in out.columns]) if guard else out
    out.write.csv(path, sep=delimiter, header=header, quote='"', escape='"', emptyValue="")


def write_ndjson(f: Frame, path: str) -> None:
    texts(f).write.json(path, ignoreNullFields=False)


def json_rows(f: Frame) -> DataFrame:
    return texts(f).select(F.to_json(F.struct("*")).alias("value"))


def markdown_lines(f: Frame) -> DataFrame:
    """A Markdown table: the names, the rule, and a line for each row."""
    cells = [F.regexp_replace(F.replace(named(c), F.lit("|"), F.lit("\\|")), r"\r?\n", " ") for c in f.columns]
    rows = texts(f).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    return _headed(f, rows, "| " + " | ".join(c.replace("|", "\\|") for c in f.columns) + " |", "|" + " --- |" * len(f.columns))


def plain_lines(f: Frame) -> DataFrame:
    return texts(f).select(F.concat_ws(" ", *[named(c) for c in f.columns]).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def columns_json(f: Frame) -> DataFrame:
    """(column, values as a JSON array), a row for each column: the column-wise export. Each array holds a whole column, so it is for small results."""
    t = texts(f).withColumn("__at", F.monotonically_increasing_id())
    cells = t.select("__at", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), named(c).alias("v")) for c in f.columns])).alias("x"))
    return cells.groupBy("x.column").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("__at", "x.v"))), lambda y: y["v"])).alias("values"))


def size_bytes(lines: DataFrame) -> Column:
    """Aggregate: the UTF-8 size of lines with their line ends."""
    return F.sum(F.octet_length(lines["value"]) + 1)
