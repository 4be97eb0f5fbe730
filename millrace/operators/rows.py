"""Steps that keep, drop, order or multiply rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ordering import rank
from millrace.functions.values import SPACE, as_date, as_number, as_text, named, natural_key, non_blank, quoted, strip

from .frame import Frame, unique_names


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(Column.__and__, conditions)


def filter_rows(f: Frame, condition: Column, keep: bool = True) -> Frame:
    return f.with_df(f.df.where(condition if keep else ~condition))


def remove_rows(f: Frame, ids: DataFrame, on: Sequence[str], keep: bool = False) -> Frame:
    """Rows whose key is in ids go (or only those stay)."""
    return f.with_df(f.df.join(ids.select(*on).distinct(), list(on), "left_semi" if keep else "left_anti"))


def drop_empty_rows(f: Frame, columns: Sequence[str] | str = "*") -> Frame:
    """Rows that are blank in all of the columns."""
    return f.with_df(f.df.where(~_all([f.blank(c) for c in (f.columns if columns == "*" else columns)])))


def dedupe(f: Frame, on: Sequence[str] | str = "*", ignore_case: bool = False, keep: str = "first") -> Frame:
    """The first or last row of each key in order. ignore_case also evens out white space."""
    keys = f.columns if on == "*" else list(on)
    if ignore_case:
        exprs = [F.lower(strip(F.regexp_replace(as_text(f.col(c), f.kind(c)), r"\s+", " "))) for c in keys]
    else:
        exprs = [f.col(c) for c in keys]
    # One grouping with partial aggregation, so a hot key is reduced before it is shuffled.
    pick = F.min_by if keep == "first" else F.max_by
    row = pick(F.struct(*[f.df[quoted(c)] for c in f.df.columns]), rank(f.df, f.order))
    return f.with_df(f.df.groupBy(*[e.alias(f"__k{i}") for i, e in enumerate(exprs)]).agg(row.alias("__row")).select("__row.*"))


def skip_rows(f: Frame, top: int = 0, bottom: int = 0) -> Frame:
    placed = f.positioned()
    kept = placed.where(F.col("__pos") > top) if top else placed
    if bottom:
        kept = kept.where(F.col("__pos") <= f.df.agg(F.count(F.lit(1))).scalar() - bottom)
    return f.with_df(kept.drop("__pos"))


def promote_header(f: Frame, row: int = 0) -> Frame:
    """The names come from the row at a place (from 0); it and the rows above go."""
    found = f.page(row, 1).collect()
    if not found:
        raise IndexError(f"there is no row {row + 1}")
    names = unique_names(["" if v is None else str(v) for v in found[0]])
    rest = skip_rows(f, row + 1)
    out = rest.select(*[rest.col(c).alias(f"\x01{i}") for i, c in enumerate(rest.columns)])
    return Frame(out.df.withColumnsRenamed({f"\x01{i}": n for i, n in enumerate(names)}), out.order)


def remove_repeated_headers(f: Frame) -> Frame:
    same = [F.lower(strip(as_text(f.col(c), f.kind(c)))) == c.strip().lower() for c in f.columns]
    return f.with_df(f.df.where(~_all(same)))


def sort_rows(f: Frame, *keys: tuple) -> Frame:
    """By (column, ascending, kind): kind is auto, number, date or text. Stable; blanks and unreadable cells come last both ways."""
    made, order = {}, []
    for i, key in enumerate(keys):
        name, up, kind = (*key, True, "auto")[:3] if len(key) == 1 else (*key, "auto")[:3]
        c, t = f.col(name), f.kind(name)
        if kind == "number":
            made[f"__s{i}"] = as_number(c, t)
        elif kind == "date":
            made[f"__s{i}"] = as_date(c, t)
        elif kind == "text" or t.typeName() == "string":
            made[f"__s{i}"] = natural_key(non_blank(as_text(c, t)))
        else:
            made[f"__s{i}"] = c
        order.append((f"__s{i}", up))
    old = [t for t in f.order if (t if isinstance(t, str) else t[0]) not in made]
    return Frame(f.df.withColumns(made), (*order, *old))


def split_to_rows(f: Frame, column: str, delimiter: str, trim: bool = True) -> Frame:
    """A row for each piece that is not empty; a row without any stays with an empty cell."""
    n = sum(c.startswith("__piece") for c in f.df.columns)
    at, names = f"__piece{n}", f.df.columns
    # Nulls and texts without a piece have an array of one empty text; stripping and dropping is done on rows, in generated code.
    text = F.coalesce(f.col(column), F.lit(""))
    full = text.rlike(rf"^(?:{_quoted(delimiter)}|[{SPACE}])*+\z") if trim else text.rlike(rf"^(?:{_quoted(delimiter)})*+\z")
    pieces = F.split(F.when(full, F.lit("")).otherwise(text), _quoted(delimiter))
    rows = f.df.withColumn("__none", full).select(*[named(c) for c in names if c != column], "__none", F.posexplode(pieces).alias(at, column))
    cell = strip(named(column)) if trim else named(column)
    out = rows.withColumn(column, cell).where((named(column) != "") | F.col("__none"))
    return Frame(out.select(*[named(c) for c in names], at), (*f.order, at))


def _quoted(literal: str) -> str:
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


