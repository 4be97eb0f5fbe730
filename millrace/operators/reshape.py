"""Aggregation and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.ordering import rank
from millrace.functions.values import as_number, as_text, detected_locale, is_blank, number_text, strip

from .frame import Frame


def _rank(f: Frame) -> Column:
    """The order as one value to take minima of."""
    return rank(f.df, f.order)


def metric_of(c: Column, kind: T.DataType, fn: str, rank: Column, locale: str = "us") -> Column:
    """sum, average, min, max over readable numbers; count of non-blank, distinct of raw non-blank cells; first and last in order; concat of non-empty cells."""
    if fn in ("sum", "average", "avg", "mean", "min", "max"):
        n = as_number(c, kind, locale)
        return {"sum": F.sum, "min": F.min, "max": F.max}.get(fn, F.avg)(n)
    if fn == "count":
        return F.count(F.when(~is_blank(c, kind), 1))
    if fn == "distinct":
        return F.count_distinct(F.when(~is_blank(c, kind), c))
    if fn == "first":
        return F.min_by(c, rank)
    if fn == "last":
        return F.max_by(c, rank)
    if fn == "concat":
        text = as_text(c, kind)
        pairs = F.collect_list(F.when(text != "", F.struct(rank.alias("o"), text.alias("v"))))
        return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["v"]), ", ")
    raise ValueError(f"no such metric: {fn}")


def metric(f: Frame, column: str, fn: str, locale: str | None = None) -> Column:
    """metric_of a column; the number format of a text column is found from a bounded sample unless given."""
    if locale is None:
        locale = detected_locale(f.df, column) if isinstance(f.kind(column), T.StringType) and fn in ("sum", "average", "avg", "mean", "min", "max") else "us"
    return metric_of(f.col(column), f.kind(column), fn, _rank(f), locale)


def aggregate(f: Frame, by: Sequence[str], metrics: Sequence[str | tuple[str, str]], ordered: bool = True) -> Frame:
    """Groups by exact values, in order of first appearance. Metrics are "count" or (column, function), named column_function.

    Partial aggregation comes with Spark, so hot groups are reduced before the shuffle; concat alone holds a group's cells.
    """
    made = [F.count(F.lit(1)).alias("count") if m == "count" else metric(f, *m).alias("_".join(m)) for m in metrics]
    first = [F.min(_rank(f)).alias("__first")] if ordered else []
    return Frame(f.df.groupBy(*[f.col(c) for c in by]).agg(*made, *first), ("__first",) if ordered else tuple(by))


def wide_to_long(f: Frame, ids: Sequence[str], values: Sequence[str] | str, key: str, value: str, skip_blank: bool = False) -> Frame:
    """A row for each cell of the value columns, row by row."""
    wanted = [c for c in f.columns if c not in ids] if values == "*" else list(values)
    if not wanted:
        raise ValueError("no columns to unpivot")
    same = len({f.kind(c).simpleString() for c in wanted}) == 1
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("k"), (f.col(c) if same else as_text(f.col(c), f.kind(c))).alias("v")) for i, c in enumerate(wanted)])
    out = f.select(*ids, cells.alias("__cells"))
    df = out.df.withColumn("__cell", F.explode("__cells"))
    df = df.where(~(F.col("__cell.v").isNull() | (strip(F.col("__cell.v").cast("string")) == ""))) if skip_blank else df
    df = df.withColumns({key: F.col("__cell.k"), value: F.col("__cell.v"), "__at": F.col("__cell.i")}).drop("__cells", "__cell")
    return Frame(df, (*out.order, "__at"))


def long_to_wide(f: Frame, ids: Sequence[str], key: str, value: str, combine: str = "error", keys: Sequence[str] | None = None, most: int = 2000) -> Frame:
    """A column for each key. combine: error, first, last, sum, count, average, min, max, concat.

    Keys not given are found by one aggregation, in order of first appearance. With text values, a cell of one value is kept as it is.
    """
    name = F.when(f.blank(key), "(blank)").otherwise(as_text(f.col(key), f.kind(key)))
    if keys is None:
        seen = f.df.groupBy(name.alias("k")).agg(F.min(_rank(f)).alias("o")).orderBy("o").limit(most + 1).collect()
        keys = [r["k"] for r in seen]
        if len(keys) > most:
            raise ValueError(f"more than {most} keys")
    if combine == "error":
        twice = f.df.groupBy(*[f.col(c) for c in ids], name.alias("__key")).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError("some cells have several values; choose how to combine them")
    fn, rank, kind, c = "first" if combine == "error" else combine, _rank(f), f.kind(value), f.col(value)
    out = []
    for k in keys:
        here, mine = F.when(name == k, rank), F.when(name == k, c)
        made = metric_of(mine if fn not in ("first", "last") else c, kind, fn, here)
        if kind.typeName() == "string":
            n = F.count(F.when(name == k, 1))
            shown = number_text(made) if fn in ("sum", "average", "avg", "mean", "min", "max") else made.cast("string")
            made = F.coalesce(F.when(n == 1, F.min_by(c, here)).otherwise(shown), F.lit(""))
        out.append(made.alias(k))
    grouped = f.df.groupBy(*[f.col(x) for x in ids])
    return Frame(grouped.agg(*out, F.min(rank).alias("__first")), ("__first",))
