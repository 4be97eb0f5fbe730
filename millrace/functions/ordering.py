"""Row order without a single-partition window.

A global order is laid out once: Spark range-partitions the rows over all terms of the order, sorts each range and
numbers its rows. The number of ranges is spark.sql.shuffle.partitions, less where AQE finds them small, so ranges keep their size
as tables grow, and a term of few values or of many nulls is cut by the terms after it. The laid out rows are staged,
because the bounds come from a sample: every reader then sees the same ranges. What crosses ranges (how many rows come
before, the last value seen) is carried over a table of one row for each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage
from .values import named, quoted

Term = str | tuple[str, bool]
#: Bits of __at that number the rows of a range; those above are the range's own number.
ROW_BITS = 33


def terms(order: Sequence[Term]) -> list[Column]:
    """Sort terms out of names or (name, ascending) pairs; nulls last both ways."""
    pairs = [(t, True) if isinstance(t, str) else t for t in order]
    return [named(n).asc_nulls_last() if up else named(n).desc_nulls_last() for n, up in pairs]


def laid_out(df: DataFrame, order: Sequence[Term]) -> DataFrame:
    """df with __range and __at, staged: ranges are numbered in order, and __at rises along the whole order."""
    by = terms(order)
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    return stage(rows, "ordered").withColumn("__range", F.shiftright("__at", ROW_BITS))


def _before(ranges: DataFrame, **sums: str) -> DataFrame:
    """(__range, name…): running sums of columns over the ranges before each; a row for each range."""
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select("__range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for name, c in sums.items()])


def with_position(df: DataFrame, order: Sequence[Term], name: str = "pos") -> DataFrame:
    """df with each row's place in order, from 1. The order should name a row uniquely."""
    rows = laid_out(df, order)
    base = _before(rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n")), __base="n")
    placed = rows.join(F.broadcast(base), "__range")  # a row for each range, so as many as shuffle partitions at most
    return placed.withColumn(name, F.col("__base") + F.col("__at").bitwiseAND((1 << ROW_BITS) - 1) + 1).drop("__range", "__at", "__base")


def carried_down(df: DataFrame, values: dict[str, Column], order: Sequence[Term]) -> DataFrame:
    """df with each named column replaced by its expression's last non-null value up to the row, null before the first."""
    n = range(len(values))
    rows = laid_out(df.withColumns({f"__v{i}": v for i, v in enumerate(values.values())}), order)
    inside = Window.partitionBy("__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"__l{i}": F.last(f"__v{i}", ignorenulls=True).over(inside) for i in n})
    last = rows.groupBy("__range").agg(*[F.max_by(f"__v{i}", F.when(F.col(f"__v{i}").isNotNull(), F.col("__at"))).alias(f"__t{i}") for i in n])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("__range", *[F.last(f"__t{i}", ignorenulls=True).over(before).alias(f"__c{i}") for i in n])
    out = local.join(F.broadcast(carry), "__range")  # a row for each range
    filled = {name: F.coalesce(f"__l{i}", f"__c{i}") for i, name in enumerate(values)}
    return out.withColumns(filled).drop("__range", "__at", *[f"__{x}{i}" for i in n for x in "vlc"])


def running_sum(df: DataFrame, value: Column, order: Sequence[Term], name: str) -> DataFrame:
    """df with the sum of value over all rows up to each one in order."""
    rows = laid_out(df.withColumn("__v", value), order)
    base = _before(rows.groupBy("__range").agg(F.sum("__v").alias("n")), __base="n")
    inside = Window.partitionBy("__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("__s", F.sum("__v").over(inside)).join(F.broadcast(base), "__range")  # a row for each range
    return out.withColumn(name, F.col("__base") + F.coalesce("__s", F.lit(0))).drop("__range", "__at", "__v", "__s", "__base")


def rank(df: DataFrame, order: Sequence[Term]) -> Column:
    """The order as one value to take minima and maxima of, nulls last both ways. Falling texts are compared by the complement of their bytes."""
    parts = []
    for t in order:
        name, up = (t, True) if isinstance(t, str) else t
        c, kind = df[quoted(name)], df.schema[name].dataType.typeName()
        if not up:
            if kind in ("date", "timestamp"):
                c = -F.unix_micros(c.cast("timestamp"))
            elif kind == "boolean":
                c = ~c
            elif kind in ("string", "binary"):
                c = F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))
            else:
                c = -c
        parts += [df[quoted(name)].isNull(), c] if df.schema[name].nullable else [c]
    return F.struct(*[p.alias(f"o{i}") for i, p in enumerate(parts)])
