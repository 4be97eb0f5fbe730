"""A table kept in its order, so that a page, a row's place or the next hit opens only the ranges it needs."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.ordering import ROW_BITS, terms
from millrace.functions.staging import new_path
from millrace.functions.values import named

from .frame import Frame


@dataclass(frozen=True)
class OrderIndex:
    """Rows written once, a folder a range, each with its place in it; `ranges` and `ends` are their numbers and how many rows there are up to their ends.

    The driver holds a number a range, so as many as shuffle partitions at most. Places count from 0 and are those of Frame.sorted.
    """

    path: str
    rows: DataFrame
    columns: tuple[str, ...]
    ranges: tuple[int, ...]
    ends: tuple[int, ...]

    @classmethod
    def of(cls, f: Frame) -> OrderIndex:
        spark, by, path = f.df.sparkSession, terms(f.order), new_path(f.df.sparkSession, "index")
        laid = f.df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
        laid.withColumn("__range", F.shiftright("__at", ROW_BITS).cast("int")).write.partitionBy("__range").parquet(path)
        schema = T.StructType([*laid.schema, T.StructField("__range", T.IntegerType())])
        rows = spark.read.schema(schema).parquet(path)
        sizes = sorted(tuple(r) for r in rows.groupBy("__range").count().collect())
        return cls(path, rows, tuple(f.columns), tuple(r for r, _ in sizes), tuple(accumulate(n for _, n in sizes)))

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def _range_of(self, place: int) -> int:
        return bisect_right(self.ends, place)

    def _at(self, place: int) -> int:
        k = self._range_of(place)
        return (self.ranges[k] << ROW_BITS) + place - (self.ends[k - 1] if k else 0)

    def _between(self, first: int, last: int) -> DataFrame:
        """Rows of places first to last, both included and there."""
        opened = list(self.ranges[self._range_of(first) : self._range_of(last) + 1])
        read = self.rows.sparkSession.read.schema(self.rows.schema).option("basePath", self.path)
        return read.parquet(*[f"{self.path}/__range={r}" for r in opened]).where(F.col("__at").between(self._at(first), self._at(last)))

    def page(self, start: int, count: int) -> DataFrame:
        """The rows from place start on, count at most, in order. A start before the first row or past the last gives what is there."""
        first, last = max(start, 0), min(start + count, len(self)) - 1
        found = self._between(first, last) if first <= last else self.rows.where(F.lit(False))
        return found.orderBy("__at").select(*[named(c) for c in self.columns])

    def find(self, hit: Column, after: int = -1, back: bool = False, wrap: bool = True) -> int | None:
        """The place of the next row (back: the one before) that hit holds for, from the place after on, that one last of all; None where no row is one.

        Ranges are opened in the order of the search, twice as many with each job, so a near hit reads one range and a far one takes few jobs.
        """
        n = len(self)
        if back:
            ways = [(0, min(after, n) - 1)] + [(max(after, 0), n - 1)] * wrap
        else:
            ways = [(max(after + 1, 0), n - 1)] + [(0, min(after, n - 1))] * wrap
        for first, last in ways:
            step = 1
            while first <= last:
                if back:
                    k = max(self._range_of(last) - step + 1, 0)
                    lo, hi = max(first, self.ends[k - 1] if k else 0), last
                else:
                    k = min(self._range_of(first) + step - 1, len(self.ends) - 1)
                    lo, hi = first, min(last, self.ends[k] - 1)
                best = self._between(lo, hi).where(hit).agg((F.max if back else F.min)("__at")).first()[0]
                if best is not None:
                    k = self.ranges.index(best >> ROW_BITS)
                    return (self.ends[k - 1] if k else 0) + (best & ((1 << ROW_BITS) - 1))
                first, last, step = (first, lo - 1, step * 2) if back else (hi + 1, last, step * 2)
        return None
