"""Steps that rewrite cells."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.ordering import carried_down
from millrace.functions.dialect import translated
from millrace.functions.values import collapse, date_text, named, number_text, parse_date, parse_number, sentence_case, strip, title_case

from .frame import Frame
from .rows import _quoted

#: Typographic quotes and what replaces them.
QUOTES = ("‘’‚‛“”„‟", "''''\"\"\"\"")


def rewrite(f: Frame, columns: Sequence[str] | str, change: Callable[[Column], Column]) -> Frame:
    """A change of all cells of text columns; nulls stay null."""
    return f.rewritten({c: change(f.col(c)) for c in f.texts(columns)})


def trim(f: Frame, columns: Sequence[str] | str = "*", inner: bool = True) -> Frame:
    return rewrite(f, columns, collapse if inner else strip)


@F.pandas_udf(T.StringType())
def _composed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def clean_text(f: Frame, columns: Sequence[str] | str = "*", nbsp: bool = True, zero_width: bool = True, quotes: bool = True, control: bool = True, nfc: bool = False) -> Frame:
    """NFC has no built-in function and takes a Python pass, so it is off unless asked for."""

    def change(c: Column) -> Column:
        c = F.regexp_replace(c, r"[   ]", " ") if nbsp else c
        c = F.regexp_replace(c, r"[​-‍⁠﻿]", "") if zero_width else c
        c = F.translate(c, *QUOTES) if quotes else c
        c = F.regexp_replace(c, r"[\u0000-\u0008\u000B\u000C\u000E-\u001F\u007F]", "") if control else c
        return F.when(c.rlike(r"[^\x00-\x7F]"), _composed(c)).otherwise(c) if nfc else c

    return rewrite(f, columns, change)


def change_case(f: Frame, columns: Sequence[str] | str, style: str) -> Frame:
    return rewrite(f, columns, {"lower": F.lower, "upper": F.upper, "title": title_case, "sentence": sentence_case}[style])


def replace_text(f: Frame, columns: Sequence[str] | str, find: str, new: str, regex: bool = False, whole: bool = False, match_case: bool = False) -> Frame:
    """All occurrences, or whole cells that match. A literal's `$` and `\\` stand for themselves; a pattern's replacement may use $1."""
    if not find:
        return f
    if not regex and not whole and match_case:
        return rewrite(f, columns, lambda c: F.replace(c, F.lit(find), F.lit(new)))
    p = translated(find, "" if match_case else "i") if regex else None
    pattern = p.java if p else ("" if match_case else "(?iu)") + _quoted(find)
    value = p.replacement(new) if p else new.replace("\\", "\\\\").replace("$", "\\$")
    return rewrite(f, columns, lambda c: F.regexp_replace(c, rf"^(?:{pattern})\z" if whole else pattern, value))


def normalize_dates(f: Frame, column: str, style: str = "iso", order: str = "mdy", pivot: int = 69) -> Frame:
    """Readable dates in one style; other cells stay."""
    c = f.col(column)
    if isinstance(f.kind(column), T.StringType):
        return f.rewritten({column: F.coalesce(date_text(parse_date(c, order, pivot), style), c)})
    return f.rewritten({column: date_text(c, style)})


def convert_numbers(f: Frame, column: str, locale: str = "us", percent_as_fraction: bool = False) -> Frame:
    """Readable numbers in plain form; other cells stay."""
    c = f.col(column)
    if not isinstance(f.kind(column), T.StringType):
        return f
    return f.rewritten({column: F.coalesce(number_text(parse_number(c, locale, percent_as_fraction)), c)})


def typed(f: Frame, column: str, to: str, locale: str = "us", order: str = "mdy") -> Frame:
    """A column as double or date instead of text; unreadable cells are null."""
    c = f.col(column)
    return f.rewritten({column: parse_number(c, locale) if to == "number" else parse_date(c, order)})


def fill_down(f: Frame, *columns: str) -> Frame:
    """Blank cells take the last value above; leading blanks stay. Ranges of the order are filled side by side and joined by what they carry."""
    pinned = f.rewritten({c: f.col(c) for c in columns})
    values = {c: F.when(~pinned.blank(c), pinned.col(c)) for c in columns}
    return pinned.with_df(carried_down(pinned.df, values, pinned.order).select(*[named(c) for c in pinned.df.columns]))


def fill_blank(f: Frame, columns: Sequence[str] | str, value: str) -> Frame:
    wanted = f.columns if columns == "*" else columns
    return f.rewritten({c: F.when(f.blank(c), F.lit(value).cast(f.kind(c))).otherwise(f.col(c)) for c in wanted})


def override_cells(f: Frame, column: str, cells: DataFrame, key: str) -> Frame:
    """Single cells replaced by cells (key, value), joined on a key; a key that is not there changes nothing."""
    new = cells.select(F.col(key).alias("__id"), F.col("value").cast(f.kind(column)).alias("__new"), F.lit(True).alias("__hit"))
    joined = f.df.join(new, f.df[key] == new["__id"], "left")
    value = F.when(F.col("__hit"), F.col("__new")).otherwise(named(column))
    return f.with_df(joined.withColumn(column, value).select(*[named(c) for c in f.df.columns]))
