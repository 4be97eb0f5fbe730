"""Readers for messy text. Each line format takes a Frame of lines (column `line`) and gives a Frame of text columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.ordering import rank, running_sum, terms
from millrace.functions.values import named, strip
from millrace.operators.columns import json_paths
from millrace.operators.frame import Frame, unique_names

#: The columns of the common and combined access-log formats.
ACCESS = ("ip", "ident", "user", "time", "method", "path", "protocol", "status", "bytes", "referrer", "user_agent")
_ACCESS = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "(?:(\S+) (\S+)(?: (\S+))?|[^"]*)" (\d{3}) (\d+|-)(?: "([^"]*)" "([^"]*)")?\s*$'
#: Months, stamps and levels as logs write them.
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_STAMP = (
    r"^\[?(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?\s?(?:Z|UTC|[+-]\d{2}:?\d{2})?|\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?"
    rf"|{_MONTH} [ \d]\d \d{{2}}:\d{{2}}:\d{{2}}|\d{{2}}/{_MONTH}/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}} [+-]\d{{4}})\]?(?=\s|$)"
)
_LEVEL = r"\[?((?i:DEBUG|INFO|WARNING|WARN|ERROR|ERR|FATAL|TRACE|NOTICE|CRITICAL|CRIT))\]?:?(?=\s|$)"
_PAIR = r'([\w.\-]+)=("(?:[^"\\]|\\.)*"|\S*)'


def _as_read(df: DataFrame, *shown: Column) -> Frame:
    """Rows of files in the order of the files' names and of the places in them: tasks take pieces of files by size, so their own order is another one."""
    at = df.metadataColumn("_metadata")
    placed = df.select(*shown, at["file_path"].alias("__file"), at["file_block_start"].alias("__block"), F.monotonically_increasing_id().alias("__rid"))
    return Frame(placed, ("__file", "__block", "__rid"))


def lines(spark: SparkSession, path: str, keep_blank: bool = True) -> Frame:
    f = _as_read(spark.read.text(path), F.regexp_replace("value", "^﻿|\r$", "").alias("line"))
    return f if keep_blank else f.with_df(f.df.where(strip(F.col("line")) != ""))


def delimited(spark: SparkSession, path: str, delimiter: str = ",", header: bool | None = True, breaks: bool = True) -> Frame:
    """A header of None is looked for (headers.tidied). Quoted fields with doubled quotes, and line breaks in them if breaks is set; all columns text, blank for missing. Without breaks a large file is read by many tasks."""
    if header is None:
        from .headers import tidied

        # Rows may be of any width: as wide as the most delimiters of a line allow, less the columns that no row has.
        width = (spark.read.text(path).agg(F.max(F.size(F.split("value", "\\Q" + delimiter + "\\E")))).first()[0] or 0) + 1
        wide = spark.read.schema(", ".join(f"c{i} string" for i in range(width))).csv(path, sep=delimiter, multiLine=breaks, quote='"', escape='"', ignoreLeadingWhiteSpace=False)
        seen = wide.agg(*[F.count(c).alias(c) for c in wide.columns]).first()
        last = max((i for i in range(width) if seen[i]), default=0)
        names = unique_names([""] * (last + 1))
        return tidied(_as_read(wide, *[F.coalesce(f"c{i}", F.lit("")).alias(n) for i, n in enumerate(names)]))
    df = spark.read.csv(path, sep=delimiter, header=header, multiLine=breaks, quote='"', escape='"', ignoreLeadingWhiteSpace=False)
    names = unique_names([c if header and not c.startswith("_c") else "" for c in df.columns])
    return _as_read(df, *[F.coalesce(named(c), F.lit("")).alias(n) for c, n in zip(df.columns, names, strict=True)])


def json_lines(f: Frame, keys: Sequence[str] | None = None) -> Frame:
    """Fields of a JSON value a line; `a.b` and `a[0]` reach inside; bad lines are kept in _unparsed. Without keys, all paths that the lines have."""
    v = F.try_parse_json("line")
    bad = F.when(v.isNull() & (strip(F.col("line")) != ""), F.col("line")).otherwise("")
    return f.select(*_fields(v, json_paths(f, "line") if keys is None else keys), bad.alias("_unparsed"))


def _fields(v: Column, keys: Sequence[str | tuple[str, str]]) -> list[Column]:
    return [F.coalesce(F.variant_get(v, path, "string"), F.lit("")).alias(k) for k, path in ((k, f"$.{k}") if isinstance(k, str) else k for k in keys)]


def json_document(spark: SparkSession, path: str) -> Frame:
    """The records of one JSON document as text columns: its array, or the largest array of objects (two at least) under a top-level key, else the document itself.

    Objects inside are flattened to `a.b`, arrays inside stay JSON text. A file is read by one task, so give large data as a line a record.
    """
    df = spark.read.json(path, multiLine=True, primitivesAsString=True)
    lists = [x.name for x in df.schema if isinstance(x.dataType, T.ArrayType) and isinstance(x.dataType.elementType, T.StructType)]
    one = False
    if lists:
        longest = df.agg(F.count(F.lit(1)).alias("rows"), *[F.max(F.size(named(c))).alias(f"n{i}") for i, c in enumerate(lists)]).first()
        sizes = {c: longest[f"n{i}"] or 0 for i, c in enumerate(lists)}
        best = max(lists, key=sizes.get)
        if longest["rows"] == 1 and sizes[best] >= 2:
            df, one = df.select(F.explode(named(best)).alias("r")).select("r.*"), True

    def leaves(c: Column, kind: T.DataType, name: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for k in kind for x in leaves(c.getField(k.name), k.dataType, f"{name}.{k.name}" if name else k.name)]
        return [F.coalesce(F.to_json(c) if isinstance(kind, T.ArrayType) else c.cast("string"), F.lit("")).alias(name)]

    shown = [x for k in df.schema for x in leaves(named(k.name), k.dataType, k.name)]
    return Frame.of(df.select(*shown)) if one else _as_read(df, *shown)


def prefixed_json(f: Frame, keys: Sequence[str] | None = None, unparsed: bool = False) -> Frame:
    """A log prefix, in column prefix, before the JSON object that ends the line: the longest one that reads, whatever braces the prefix has. A line without one is blank, and is kept in _unparsed if that is asked for. Without keys, all paths that the objects have."""
    pieces = F.split("line", r"\{")
    from_brace = lambda i: F.substring("line", F.length(F.array_join(F.slice(pieces, F.lit(1), i), "{")) + 1, F.length("line"))
    first = from_brace(F.lit(1))
    later = F.get(F.filter(F.transform(F.sequence(F.lit(2), F.greatest(F.size(pieces), F.lit(2))), from_brace), lambda t: F.try_parse_json(t).isNotNull()), F.lit(0))
    body = F.when(F.size(pieces) > 1, F.when(F.try_parse_json(first).isNotNull(), first).when(F.size(pieces) > 2, later))
    body = F.when(strip(body) != "", body)
    out = f.with_df(f.df.withColumn("__body", body))
    v = F.try_parse_json("__body")
    prefix = strip(F.substring("line", F.lit(1), F.length("line") - F.length("__body")))
    bad = [F.when(F.col("__body").isNull(), F.coalesce("line", F.lit(""))).otherwise("").alias("_unparsed")] if unparsed else []
    shown = out.select(F.coalesce(prefix, F.lit("")).alias("prefix"), *_fields(v, json_paths(out, "__body") if keys is None else keys), *bad)
    return Frame(shown.df.drop("__body"), shown.order)


def access_log(f: Frame) -> Frame:
    """Web server log in 11 columns; other lines in unparsed."""
    hit = F.col("line").rlike(_ACCESS)
    return f.select(*[F.regexp_extract("line", _ACCESS, i).alias(n) for i, n in enumerate(ACCESS, 1)], F.when(hit, "").otherwise(F.col("line")).alias("unparsed"))


def logfmt(f: Frame, keys: Sequence[str] | None = None) -> Frame:
    """key=value pairs as columns; what is left over is the message. Without keys, all that the lines have, in the order in which they come first."""
    keys = pair_keys(f) if keys is None else keys

    def value(k: str) -> Column:
        raw = F.regexp_extract("line", rf'(?:^|\s)\Q{k}\E=("(?:[^"\\]|\\.)*"|\S*)', 1)
        return F.regexp_replace(F.regexp_replace(raw, r'^"|"$', ""), r"\\(.)", "$1").alias(k)

    rest = strip(F.regexp_replace(F.regexp_replace("line", _PAIR, ""), r"\s+", " "))
    return f.select(*[value(k) for k in keys], rest.alias("message"))


def pair_keys(f: Frame, most: int = 300) -> list[str]:
    """The keys of a logfmt text in the order of the first line that has them."""
    keys = f.df.select(rank(f.df, f.order).alias("o"), F.posexplode(F.regexp_extract_all("line", F.lit(_PAIR), F.lit(1))).alias("p", "k"))
    return [r["k"] for r in keys.groupBy("k").agg(F.min(F.struct("o", "p")).alias("o")).orderBy("o").limit(most).collect()]


def _joined(f: Frame, starts: Column, joiner: str) -> Frame:
    """Records: lines from one that starts a record up to the next, joined; lines before the first are one record."""
    marked = running_sum(f.df.withColumn("__start", starts), F.col("__start").cast("int"), f.order, "__block")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(rank(marked, f.order).alias("o"), F.col("line").alias("v")))), lambda x: x["v"])
    return Frame(marked.groupBy("__block").agg(F.array_join(parts, joiner).alias("line"), parts.alias("__lines")), ("__block",))


def log_lines(f: Frame) -> Frame:
    """timestamp, level, source, message; lines without a timestamp go on in the record before them."""
    records = _joined(f, F.col("line").rlike(_STAMP), "\n")
    stamp = F.regexp_extract("line", _STAMP, 1)
    rest = strip(F.regexp_replace("line", _STAMP, ""))
    head = F.substring_index(rest, "\n", 1)
    level = F.upper(F.regexp_extract(head, rf"^\s*{_LEVEL}", 1))
    after = strip(F.regexp_replace(rest, rf"^\s*{_LEVEL}", ""))
    source = F.regexp_extract(after, r"^\[?([\w.$/\-]+)\]?(?: -|:) ", 1)
    message = F.when(source != "", strip(F.regexp_replace(after, r"^\[?[\w.$/\-]+\]?(?: -|:) ", ""))).otherwise(after)
    out = records.df.select(stamp.alias("timestamp"), level.alias("level"), source.alias("source"), message.alias("message"), "__block")
    return Frame(out, records.order)


def key_value_blocks(f: Frame, keys: Sequence[str], separator: str = ":") -> Frame:
    """Records set apart by blank lines, or by the return of a block's first key. Continuation lines are appended with a blank.

    A key that comes again inside a record is key_2, key_3. Lines before a block's first key go with no field.
    """
    blank = strip(F.col("line")) == ""
    numbered = running_sum(f.df, blank.cast("int"), f.order, "__block")
    pair = rf"^\s*([^{separator}]+?)\s*{separator}\s*(.*?)\s*$"
    key = F.when(F.col("line").rlike(pair), F.regexp_extract("line", pair, 1))
    value = F.when(key.isNotNull(), F.regexp_extract("line", pair, 2)).otherwise(strip(F.col("line")))
    rows = running_sum(numbered.where(~blank).withColumns({"__key": key, "__value": value}), key.isNotNull().cast("int"), f.order, "__field")
    texts = F.transform(F.array_sort(F.collect_list(F.struct(rank(rows, f.order).alias("o"), F.col("__value").alias("v")))), lambda x: x["v"])
    fields = rows.groupBy("__block", "__field").agg(F.max("__key").alias("k"), F.array_join(texts, " ").alias("v")).where("k IS NOT NULL")
    # Fields are counted in order, so the records of one long block are numbered without a window over the block.
    first = fields.groupBy("__block").agg(F.min_by("k", "__field").alias("lead"))
    fields = running_sum(fields.join(first, "__block"), (F.col("k") == F.col("lead")).cast("int"), ("__field",), "__record")
    again = Window.partitionBy("__record", "k").orderBy("__field")  # the fields of one name in one record
    named = fields.withColumn("n", F.row_number().over(again)).withColumn("k", F.when(F.col("n") > 1, F.concat("k", F.lit("_"), "n")).otherwise(F.col("k")))
    return Frame(named.groupBy("__record").pivot("k", list(keys)).agg(F.first("v")).fillna(""), ("__record",))


def line_blocks(f: Frame, width: int) -> Frame:
    """A row for each blank-separated block, its lines in field_1 and so on; the last holds the rest."""
    blank = strip(F.col("line")) == ""
    numbered = running_sum(f.df, blank.cast("int"), f.order, "__block").where(~blank)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(rank(numbered, f.order).alias("o"), strip(F.col("line")).alias("v")))), lambda x: x["v"])
    out = numbered.groupBy("__block").agg(parts.alias("p"))
    cells = [F.coalesce(F.get("p", F.lit(i)), F.lit("")) for i in range(width - 1)] + [F.array_join(F.expr(f"slice(p, {width}, greatest(size(p) - {width - 1}, 0))"), " ")]
    return Frame(out.select(*[c.alias(f"field_{i}") for i, c in enumerate(cells, 1)], "__block"), ("__block",))


def fixed_width(f: Frame, cuts: Sequence[int], names: Sequence[str] = ()) -> Frame:
    ends = [*cuts[1:], None]
    names = unique_names([names[i] if i < len(names) else "" for i in range(len(cuts))])
    return f.select(*[strip(F.substring("line", a + 1, 1 << 30 if b is None else b - a)).alias(n) for a, b, n in zip(cuts, ends, names, strict=True)])


def find_cuts(f: Frame) -> list[int]:
    """Starts of fixed-width columns: positions after ones that are blank in 95 % of the lines that reach them, by one aggregation."""
    chars = f.df.select(F.posexplode(F.split("line", "")).alias("p", "c")).where(F.col("c") != "")
    seen = chars.groupBy("p").agg((F.avg((F.col("c") == " ").cast("int")) >= 0.95).alias("gap")).orderBy("p").collect()
    gaps = {r["p"] for r in seen if r["gap"]}
    return [r["p"] for r in seen if r["p"] not in gaps and (r["p"] == 0 or r["p"] - 1 in gaps)]


def _table(f: Frame, cells: Column, names: Sequence[str]) -> Frame:
    return f.select(*[F.coalesce(F.get(cells, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(unique_names(list(names)))])


def whitespace_runs(f: Frame, names: Sequence[str]) -> Frame:
    """Columns set apart by tabs or two blanks and more."""
    return _table(f, F.split(strip(F.col("line")), r"\t+| {2,}"), names)


def _header_above(f: Frame, rule: str) -> tuple[str | None, Column]:
    """The line that stands right above the first rule, if it is the first line of the table, and the test of that row. Reads the table's first lines only."""
    some = f.df.where(F.col("line").contains("|") | F.col("line").rlike(rule)).orderBy(*terms(f.order)).limit(3).collect()
    head = [r for r in some if not re.match(rule, r["line"])][:1]
    if not head or some.index(head[0]) + 1 >= len(some) or not re.match(rule, some[some.index(head[0]) + 1]["line"]):
        return None, F.lit(False)
    keys = [t if isinstance(t, str) else t[0] for t in f.order]
    return head[0]["line"], reduce(Column.__and__, [named(k).eqNullSafe(F.lit(head[0][k])) for k in keys])


def _ruled(f: Frame, names: Sequence[str] | None, rule: str, cells: Callable[[Column], Column]) -> Frame:
    """Rows of a table with rules. Without names, they come from the line above the first rule, which then is no row."""
    body = f.with_df(f.df.where(F.col("line").contains("|") & ~F.col("line").rlike(rule)))
    if names is not None:
        return _table(body, cells(F.col("line")), names)
    said, header = _header_above(f, rule)
    one = f.df.sparkSession.sql("SELECT * FROM VALUES (1) AS t(x)")
    if said is not None:
        return _table(body.with_df(body.df.where(~header)), cells(F.col("line")), one.select(cells(F.lit(said))).first()[0])
    width = body.df.agg(F.max(F.size(cells(F.col("line"))))).first()[0] or 0
    return _table(body, cells(F.col("line")), [""] * width)


def markdown_table(f: Frame, names: Sequence[str] | None = None) -> Frame:
    """Pipe-framed rows; the separator row goes and \\| is a pipe. Without names, the line above the separator has them."""
    inner = lambda line: F.regexp_replace(strip(line), r"^\||(?<!\\)\|$", "")
    return _ruled(f, names, r"^\s*\|?[\s:|-]+\|?\s*$", lambda line: F.transform(F.split(inner(line), r"(?<!\\)\|"), lambda x: strip(F.replace(x, F.lit("\\|"), F.lit("|")))))


def box_table(f: Frame, names: Sequence[str] | None = None) -> Frame:
    """Tables as database shells print them, with or without a frame; rules and row counts go. Without names, the line above a rule has them."""
    return _ruled(f, names, r"^[\s+|-]*$", lambda line: F.transform(F.split(F.regexp_replace(strip(line), r"^\||\|$", ""), r"\|"), strip))


def list_items(f: Frame, split: bool = False) -> Frame:
    """Bulleted or numbered items, optionally cut into item and detail at a dash or colon."""
    item = F.regexp_extract("line", r"^\s*(?:[-*•–]|\d+[.)])\s+(.*?)\s*$", 1)
    body = f.with_df(f.df.where(F.col("line").rlike(r"^\s*(?:[-*•–]|\d+[.)])\s+")))
    if not split:
        return body.select(item.alias("item"))
    pattern = r"^(.*?)(?: [–—-] |: )(.*)$"
    cut = item.rlike(pattern)
    return body.select(F.when(cut, F.regexp_extract(item, pattern, 1)).otherwise(item).alias("item"), F.regexp_extract(item, pattern, 2).alias("detail"))


class _Tables(HTMLParser):
    """Cells of the tables of a page as (table, row, column, header, text), spans laid out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple[int, int, int, bool, str]] = []
        self.open: list[dict] = []
        self.n = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append({"id": self.n, "row": -1, "down": {}, "cell": None})
            self.n += 1
        elif self.open and tag == "tr":
            self._close()
            t = self.open[-1]
            t["row"], t["col"] = t["row"] + 1, 0
        elif self.open and tag in ("td", "th") and self.open[-1]["row"] >= 0:
            self._close()
            a = dict(attrs)
            span = lambda k, most: min(most, max(1, int(a[k]) if (a.get(k) or "").isdigit() else 1))
            self.open[-1]["cell"] = [tag == "th", span("colspan", 50), span("rowspan", 500), []]

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag in ("td", "th", "tr"):
            self._close()
        elif self.open and tag == "table":
            self._close()
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"][3].append(data)

    def _close(self) -> None:
        t = self.open[-1]
        if not t["cell"]:
            return
        (head, across, down, parts), t["cell"] = t["cell"], None
        text = " ".join("".join(parts).split())
        while (t["row"], t["col"]) in t["down"]:
            self.cells.append((t["id"], t["row"], t["col"], *t["down"].pop((t["row"], t["col"]))))
            t["col"] += 1
        for k in range(across):
            value = text if k == 0 or head else ""
            self.cells.append((t["id"], t["row"], t["col"] + k, head, value))
            for r in range(1, down):
                t["down"][t["row"] + r, t["col"] + k] = (head, value)
        t["col"] += across


def html_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, table, row, col, header, value): the cells of all tables of all pages; a page without tables gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, html in zip(b["page"], b["html"], strict=True):
                p = _Tables()
                p.feed(html or "")
                p.close()
                rows += [(page, *c) for c in p.cells]
            yield pd.DataFrame(rows, columns=["page", "table", "row", "col", "header", "value"])

    return pages.select(F.col(id_col).alias("page"), F.col(html_col).alias("html")).mapInPandas(run, f"page {pages.schema[id_col].dataType.simpleString()}, table int, row int, col int, header boolean, value string")
