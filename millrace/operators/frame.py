"""Frame: a DataFrame with an explicit row order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.ordering import Term, terms, with_position
from millrace.functions.values import is_blank, named, quoted


def unique_names(names: Sequence[str]) -> list[str]:
    """Blank names become column_N, repeated ones get _2, _3."""
    out: list[str] = []
    for k, raw in enumerate(names, 1):
        name = base = raw.strip() or f"column_{k}"
        n = 2
        while name in out:
            name, n = f"{base}_{n}", n + 1
        out.append(name)
    return out


@dataclass(frozen=True)
class Frame:
    """df and the sort terms that put its rows in order; columns that start with `__` are hidden. Immutable and lazy."""

    df: DataFrame
    order: tuple[Term, ...] = field(default=())

    @classmethod
    def of(cls, df: DataFrame, *order: Term) -> Frame:
        """With no order given, rows keep the order they are read in."""
        if order:
            return cls(df, tuple(order))
        return cls(df.withColumn("__rid", F.monotonically_increasing_id()), ("__rid",))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]

    @property
    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith("__")]

    def kind(self, column: str) -> T.DataType:
        return self.df.schema[column].dataType

    def col(self, column: str) -> Column:
        return self.df[quoted(column)]

    def blank(self, column: str) -> Column:
        return is_blank(self.col(column), self.kind(column))

    def texts(self, columns: Sequence[str] | str = "*") -> list[str]:
        wanted = self.columns if columns == "*" else list(columns)
        return [c for c in wanted if isinstance(self.kind(c), T.StringType)]

    def with_df(self, df: DataFrame) -> Frame:
        return Frame(df, self.order)

    def select(self, *visible: Column | str) -> Frame:
        """The visible columns anew; columns that the order needs stay as hidden ones."""
        keep = list(self.hidden)
        shown = [v if isinstance(v, Column) else self.col(v) for v in visible]
        names = self.df.select(*shown).columns
        order, extra = [], []
        for t in self.order:
            name, up = (t, True) if isinstance(t, str) else t
            if not name.startswith("__") and name not in names:
                hidden = f"__was_{name}"
                extra.append(self.col(name).alias(hidden))
                name = hidden
            order.append((name, up))
        extra += [self.col(c) for c in keep]
        return Frame(self.df.select(*shown, *extra), tuple(order))

    def rewritten(self, values: dict[str, Column]) -> Frame:
        """Cells of columns replaced. Terms of the order that are replaced go on by the old values."""
        pinned, order = {}, []
        for t in self.order:
            name, up = (t, True) if isinstance(t, str) else t
            if name in values:
                pinned[f"__was_{name}"] = self.col(name)
                name = f"__was_{name}"
            order.append((name, up))
        return Frame(self.df.withColumns(pinned | values), tuple(order))

    def sorted(self) -> DataFrame:
        """The visible rows in order, for a sink or a page."""
        return self.df.orderBy(*terms(self.order)).select(*[named(c) for c in self.columns])

    def positioned(self, name: str = "__pos") -> DataFrame:
        return with_position(self.df, self.order, name)

    def result(self) -> DataFrame:
        """The visible columns, in no order."""
        return self.df.select(*[named(c) for c in self.columns])

    def page(self, start: int, count: int) -> DataFrame:
        return self.df.orderBy(*terms(self.order)).offset(start).limit(count).select(*[named(c) for c in self.columns])
