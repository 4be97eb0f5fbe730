"""Titles above a table, its header, and totals below it.

What a header is, is a matter of a table's first rows: at most HEAD of them are looked at, as people do, and at most FOOT last ones. Both are top-n
reads by the table's order, so neither lays the table out. The rows that go are then left out by their keys.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, Row
from pyspark.sql import functions as F

from millrace.functions.ordering import terms
from millrace.functions.values import as_text, is_blank, named, parse_date, parse_number
from millrace.operators.frame import Frame, unique_names

#: Rows looked at from the top and from the bottom; signs of the longest name.
HEAD, FOOT, LONGEST = 301, 20, 60
#: How rows of totals begin.
TOTAL = re.compile(r"(?i)^\W*(grand\s+|sub-?\s*)?total(s)?\b|^\W*sum\b")
_NAME = re.compile(r"[A-Za-z_#][\w .#/()%-]{0,39}")


def _looked_at(f: Frame, count: int, last: bool = False) -> list[tuple[Row, list[str], list[bool]]]:
    """(row, cells, is each a number or date) of the first or last rows in order."""
    order = [(t, True) if isinstance(t, str) else t for t in f.order]
    cells = F.array(*[F.trim(as_text(f.col(c), f.kind(c))) for c in f.columns])
    measured = lambda x: parse_number(x).isNotNull() | parse_number(x, "eu").isNotNull() | parse_date(x).isNotNull()
    flags = F.array(*[~is_blank(f.col(c), f.kind(c)) & measured(as_text(f.col(c), f.kind(c))) for c in f.columns])
    rows = f.df.select("*", cells.alias("__cells"), flags.alias("__flags")).orderBy(*terms(tuple((n, up != last) for n, up in order))).limit(count).collect()
    return [(r, r["__cells"], r["__flags"]) for r in rows]


def _filled(cells: list[str]) -> int:
    return sum(c != "" for c in cells)


def titles(rows: list[list[str]]) -> int:
    """How many first rows are titles: they fill less than three fifths of the cells that most rows fill, two at least."""
    counts = Counter(_filled(r) for r in rows if _filled(r))
    if not counts:
        return 0
    most = max(counts, key=lambda n: (counts[n], n))
    return 0 if most < 2 else next((i for i, r in enumerate(rows) if _filled(r) >= 0.6 * most), 0)


def is_header(cells: list[str], body: list[list[str]], measured: list[list[bool]], own: list[bool]) -> bool:
    """Whether a row names the columns of the rows under it.

    It has a name for each column, no two alike, none a number, a date or overlong. That is so for certain where a column below is mostly numbers or dates, or where most
    rows below have digits and it has none; it isn't where a name comes again as a value; else its cells have to look like names.
    """
    low = [c.lower() for c in cells]
    if not cells or "" in cells or len(set(low)) < len(low) or any(own) or any(len(c) > LONGEST for c in cells):
        return False
    if not body:
        return True
    for k in range(len(cells)):
        full = [m[k] for r, m in zip(body, measured, strict=True) if r[k] != ""]
        if full and sum(full) >= 0.8 * len(full):
            return True
    digits = lambda r: any(ch.isdigit() for c in r for ch in c)
    if not digits(cells) and 2 * sum(map(digits, body)) >= len(body):
        return True
    again = [r for r in body if [c.lower() for c in r] != low]
    if any(r[k].lower() == low[k] for r in again for k in range(len(cells))):
        return False
    return all(_NAME.fullmatch(c) and len(c.split()) <= 4 for c in cells)


def _is_row(f: Frame, row: Row) -> Column:
    keys = [t if isinstance(t, str) else t[0] for t in f.order]
    return reduce(Column.__and__, [named(k).eqNullSafe(F.lit(row[k])) for k in keys])


def tidied(f: Frame) -> Frame:
    """The table without titles above it and totals below it, its columns named by its own header if it has one.

    At most HEAD first and FOOT last rows are looked at; rows that go are known by their order's terms, which have to tell them apart. An empty table stays as it is.
    """
    first = _looked_at(f, HEAD)
    above = titles([c for _, c, _ in first])
    rest = first[above:]
    gone = [r for r, _, _ in first[:above]]
    names = None
    if rest and is_header(rest[0][1], [c for _, c, _ in rest[1:]], [m for _, _, m in rest[1:]], rest[0][2]):
        names = rest[0][1]
        gone.append(rest[0][0])
    for row, cells, _ in _looked_at(f, FOOT, last=True):
        said = next((c for c in cells if c), "")
        if said and not TOTAL.match(said) or row in gone:
            break
        gone.append(row)
    out = f.with_df(f.df.where(~reduce(Column.__or__, [_is_row(f, r) for r in gone]))) if gone else f
    if names is None:
        return out
    new = unique_names(names)
    shown = out.select(*[out.col(c).alias(f"\x01{i}") for i, c in enumerate(out.columns)])
    return Frame(shown.df.withColumnsRenamed({f"\x01{i}": n for i, n in enumerate(new)}), shown.order)
