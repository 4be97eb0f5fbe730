"""Filter comparisons as Columns that are never null, so that their negations are two-valued."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dialect import translated
from .values import as_date, as_number, as_text, detected_locale, fold, is_blank, named, parse_date, parse_number, strip

COMPARED: dict[str, Callable[[Column, Column], Column]] = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__, "eq": Column.__eq__, "ne": Column.__ne__}


def _sure(c: Column, otherwise: bool = False) -> Column:
    return F.coalesce(c, F.lit(otherwise))


def _compared(key: Column, op: str, literal: Column) -> Column:
    """Two-valued by null checks rather than a coalesce, so that it can be pushed down to a scan."""
    return (key.isNull() | (key != literal)) if op == "ne" else key.isNotNull() & COMPARED[op](key, literal)


def _moment(ts: Column, op: str, value, value2=None) -> Column:
    """A timestamp against days, as bounds on the timestamp itself rather than on a cast of it."""
    at = lambda d: F.lit(d.isoformat()).cast("timestamp")
    low, high = sorted([value, value if value2 is None else value2])
    start, stop = at(low), at(high + timedelta(days=1))
    inside = ts.isNotNull() & (ts >= start) & (ts < stop)
    return {"gt": ts.isNotNull() & (ts >= stop), "gte": ts.isNotNull() & (ts >= start), "lt": ts.isNotNull() & (ts < start), "lte": ts.isNotNull() & (ts < stop), "ne": ts.isNull() | (ts < start) | (ts >= stop)}.get(op, inside)


def _text(df: DataFrame, column: str) -> Column:
    return as_text(named(column), df.schema[column].dataType)


def _literal(value) -> str:
    return value.isoformat() if isinstance(value, date | datetime) else str(value)


def _reads(df: DataFrame, values: list[str], locale: str, order: str) -> list[tuple[float | None, date | None]]:
    """What literals say as a number and as a date; Spark folds this without a job."""
    one = df.sparkSession.sql("SELECT * FROM VALUES (1) AS t(x)")
    found = one.select(*[x for v in values for x in (F.coalesce(parse_number(F.lit(v), locale), parse_number(F.lit(v))), parse_date(F.lit(v), order))]).first()
    return [(found[2 * i], found[2 * i + 1]) for i in range(len(values))]


def _keys(df: DataFrame, column: str, values: list, locale: str | None, order: str) -> tuple[Column, list[Column]] | None:
    """A column and literals as dates or numbers; None if a literal can't be read. A text column is compared as dates if the first literal is a date and no number."""
    kind, c = df.schema[column].dataType, named(column)
    typed_date = isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType)
    if all(isinstance(v, int | float) for v in values) and not typed_date:
        read = [(float(v), None) for v in values]
    else:
        locale = locale or (detected_locale(df, column) if isinstance(kind, T.StringType) else "us")
        read = _reads(df, [_literal(v) for v in values], locale, order)
    dated = typed_date or (not isinstance(kind, T.NumericType) and read[0][0] is None and read[0][1] is not None) or any(isinstance(v, date | datetime) for v in values)
    if any(r[1 if dated else 0] is None for r in read):
        return None
    if dated:
        return as_date(c, kind, order), [F.lit(r[1]) for r in sorted(read, key=lambda r: r[1])]
    if isinstance(kind, T.StringType):
        locale = locale or detected_locale(df, column)
    return as_number(c, kind, locale or "us"), [F.lit(r[0]) for r in sorted(read, key=lambda r: r[0])]


def leaf(df: DataFrame, column: str, op: str, value=None, value2=None, values: Iterable = (), case_sensitive: bool = False, locale: str | None = None, date_order: str = "mdy") -> Column:
    """One of 18 comparisons on a column, or on any (`*`). Text ones ignore case unless case_sensitive; blanks and unreadable cells compare as false, and as true for ne.

    Literals of gt to between may be texts that read as numbers or dates. A text column's number format is found from a
    bounded sample unless locale is given. eq and ne compare as text where the literal is neither number nor date.
    """
    if column == "*":
        negated = {"notContains": "contains", "notEquals": "equals", "ne": "eq"}.get(op, op)
        columns = [c for c in df.columns if not c.startswith("__")]
        if negated in COMPARED or negated == "between":  # columns that can't be compared with the literal don't count
            columns = [c for c in columns if _keys(df, c, [value, value2] if negated == "between" else [value], locale or "us", date_order)] or columns
        each = [leaf(df, c, negated, value, value2, values, case_sensitive, locale, date_order) for c in columns]
        joined = reduce(Column.__and__ if op == "isEmpty" else Column.__or__, each)
        return ~joined if negated != op else joined
    kind = df.schema[column].dataType
    same = (lambda c: c) if case_sensitive else fold
    text, want = _text(df, column), same(F.lit("" if value is None else _literal(value)))
    if op in ("isEmpty", "isNotEmpty"):
        blank = is_blank(named(column), kind)
        return blank if op == "isEmpty" else ~blank
    if op in ("contains", "notContains"):
        found = same(text).contains(want)
        return ~found if op == "notContains" else found
    if op == "wholeWord":
        word = re.escape(_literal(value) if case_sensitive else _literal(value).lower())
        return same(text).rlike(rf"(?<![\p{{L}}\p{{N}}_]){word}(?![\p{{L}}\p{{N}}_])")
    if op in ("equals", "notEquals"):
        found = same(strip(text)) == strip(want)
        return ~found if op == "notEquals" else found
    if op == "startsWith":
        return same(strip(text)).startswith(want)
    if op == "endsWith":
        return same(strip(text)).endswith(want)
    if op == "matches":
        return text.rlike(translated(str(value), "" if case_sensitive else "i").java)
    if op == "in":
        wanted = [_literal(v).strip() if case_sensitive else _literal(v).strip().lower() for v in values]
        return same(strip(text)).isin(wanted)
    if isinstance(kind, T.TimestampType) and (op in COMPARED or op == "between"):
        days = [r[1] for r in _reads(df, [_literal(v)[:10] if isinstance(v, date | datetime) else _literal(v) for v in ([value] if value2 is None else [value, value2])], "us", date_order)]
        if None in days:
            if op in ("eq", "ne"):
                return leaf(df, column, "equals" if op == "eq" else "notEquals", value, case_sensitive=case_sensitive)
            raise ValueError(f"{value!r} is no date, so it can't be compared")
        return _moment(named(column), op, *days)
    if op in COMPARED or op == "between":
        keys = _keys(df, column, [value, value2] if op == "between" else [value], locale, date_order)
        if keys is None:
            if op in ("eq", "ne"):
                return leaf(df, column, "equals" if op == "eq" else "notEquals", value, case_sensitive=case_sensitive)
            raise ValueError(f"{value!r} is no number or date, so it can't be compared")
        key, ends = keys
        if isinstance(kind, T.StringType):  # nothing to push down, and reading a text is dear: once for a comparison
            return _sure(key.between(*ends)) if op == "between" else _sure(COMPARED[op](key, ends[0]), op == "ne")
        return _compared(key, "gte", ends[0]) & _compared(key, "lte", ends[1]) if op == "between" else _compared(key, op, ends[0])
    raise ValueError(f"no such comparison: {op}")


def any_of(*conditions: Column) -> Column:
    return reduce(Column.__or__, conditions) if conditions else F.lit(True)


def all_of(*conditions: Column) -> Column:
    return reduce(Column.__and__, conditions) if conditions else F.lit(True)


def words_anywhere(df: DataFrame, *words: str) -> Column:
    """Each word is in some column: the free-text search."""
    return all_of(*[leaf(df, "*", "contains", w) for w in words])


def row_text(df: DataFrame) -> Column:
    """The non-blank cells of a row, stripped and joined by a blank."""
    cells = [F.nullif(strip(_text(df, c)), F.lit("")) for c in df.columns if not c.startswith("__")]
    return F.concat_ws(" ", *cells)


def top_n(df: DataFrame, column: str, n: int, lowest: bool = False) -> DataFrame:
    """The n largest (or smallest) values with all ties. The n-th value is found by a top-n sort, not by a full one."""
    c = named(column)
    best = df.where(c.isNotNull()).select(c.alias("v")).orderBy(F.col("v").asc() if lowest else F.col("v").desc()).limit(n)
    edge = best.agg(F.max("v") if lowest else F.min("v")).scalar()
    return df.where(c <= edge if lowest else c >= edge)


def around_average(df: DataFrame, column: str, above: bool = True) -> DataFrame:
    """Rows above (or below) the column's average, which is rounded to 1e-10."""
    c = named(column).cast("double")
    mean = df.agg(F.round(F.avg(c) * 1e10) / 1e10).scalar()
    return df.where(c > mean if above else c < mean)


def period(column: Column, which: str, today: Column | None = None, n: int = 0) -> Column:
    """thisMonth, lastMonth, thisYear or lastDays (n, today included) of a date column."""
    d, now = column.cast("date"), F.current_date() if today is None else today.cast("date")
    if which in ("thisMonth", "lastMonth"):
        start = F.trunc(F.add_months(now, -1) if which == "lastMonth" else now, "month")
        return _sure((d >= start) & (d < F.add_months(start, 1)))
    if which == "thisYear":
        return _sure(F.year(d) == F.year(now))
    if which == "lastDays":
        return _sure((d > F.date_sub(now, n)) & (d <= now))
    raise ValueError(f"no such period: {which}")
