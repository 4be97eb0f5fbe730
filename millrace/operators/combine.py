"""Joins with a reference table, and comparison with one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.values import as_text, collapse, fold, named, number_text, parse_number, strip

from .frame import Frame, unique_names
from .reshape import _rank


def _key(f: Frame, column: str, trimmed: bool, folded: bool, numeric: bool) -> Column:
    """A key part: typed as it is, or text evened out; null if blank, so that it never matches."""
    kind = f.kind(column)
    if not isinstance(kind, T.StringType) and not (trimmed or folded or numeric):
        return f.col(column)
    t = as_text(f.col(column), kind)
    t = collapse(t) if trimmed else t
    t = fold(t) if folded else t
    t = F.coalesce(number_text(parse_number(t)), t) if numeric else t
    return F.when(strip(t) != "", t)


def _keys(f: Frame, columns: Sequence[str], side: str, *how: bool) -> tuple[list[Column], Column]:
    """Key columns __k<side>0…, and whether any part is there: rows whose key is blank throughout match nothing."""
    parts = [_key(f, c, *how) for c in columns]
    there = F.coalesce(*[F.when(p.isNotNull(), True) for p in parts], F.lit(False))
    return [p.alias(f"__k{side}{i}") for i, p in enumerate(parts)], there


def join(f: Frame, ref: Frame, on: Sequence[tuple[str, str]], how: str = "left", bring: Sequence[str] | None = None, duplicates: str = "first", trimmed: bool = False, folded: bool = False, numeric: bool = False) -> Frame:
    """left, inner, semi or anti join on normalised keys. duplicates: the reference's first row of a key, or fanout. Misses are null.

    No side is broadcast by hint: Spark does that by size, and splits skewed keys otherwise.
    """
    left_keys, left_there = _keys(f, [a for a, _ in on], "l", trimmed, folded, numeric)
    right_keys, right_there = _keys(ref, [b for _, b in on], "r", trimmed, folded, numeric)
    left = f.df.select("*", *left_keys, left_there.alias("__there"))
    both = [F.col(f"__kl{i}").eqNullSafe(F.col(f"__kr{i}")) if len(on) > 1 else F.col(f"__kl{i}") == F.col(f"__kr{i}") for i in range(len(on))]
    condition = both[0]
    for c in both[1:]:
        condition = condition & c
    condition = condition & F.col("__there") if len(on) > 1 else condition
    drop = ["__there", *[f"__kl{i}" for i in range(len(on))], *[f"__kr{i}" for i in range(len(on))]]
    if how in ("semi", "anti"):
        right = ref.df.where(right_there).select(*right_keys).distinct()
        return f.with_df(left.join(right, condition, f"left_{how}").drop(*drop))
    wanted = [c for c in (bring if bring is not None else [c for c in ref.columns if c not in [b for _, b in on]]) if c in ref.columns]
    names = unique_names([*f.columns, *[f"{c}_ref" if c in f.columns else c for c in wanted]])[len(f.columns) :]
    cells = [ref.col(c).alias(f"__b{i}") for i, c in enumerate(wanted)]
    right = ref.df.where(right_there).select(*right_keys, *cells, _rank(ref).alias("__ref"))
    keys = [f"__kr{i}" for i in range(len(on))]
    if duplicates == "first":
        row = F.min_by(F.struct(*[f"__b{i}" for i in range(len(wanted))], F.lit(0).alias("__none")), "__ref")
        right = right.groupBy(*keys).agg(row.alias("__row")).select(*keys, *[F.col(f"__row.__b{i}").alias(f"__b{i}") for i in range(len(wanted))])
    out = left.join(right, condition, how).withColumnsRenamed({f"__b{i}": n for i, n in enumerate(names)}).drop(*drop)
    if duplicates == "first":
        return f.with_df(out)
    n = sum(c.startswith("__ref_") for c in out.columns)
    return Frame(out.withColumnRenamed("__ref", f"__ref_{n}"), (*f.order, f"__ref_{n}"))


def compare(f: Frame, ref: Frame, keys: Sequence[str], columns: Sequence[str] | None = None, removed: bool = True, duplicates: str = "error") -> Frame:
    """_diff (added, changed, unchanged, removed) and _changes ("col: old → new; …") against an earlier table.

    Rows with a blank key are added, and such reference rows are never removed. Repeated reference keys: error, first or last.
    Removed rows come after the others, in the reference's order.
    """
    shared = [c for c in f.columns if c in ref.columns and c not in keys] if columns is None else list(columns)
    ref_keys, there = _keys(ref, keys, "r", False, False, False)
    old = ref.df.where(there)
    if duplicates == "error":
        twice = old.groupBy(*[ref.col(k) for k in keys]).count().where("count > 1").count()
        if twice:
            raise ValueError(f"{twice} keys of the reference table repeat")
    pick = F.max_by if duplicates == "last" else F.min_by
    cells = F.struct(*[ref.col(c).alias(f"o{i}") for i, c in enumerate(ref.columns)])
    old = old.select(*ref_keys, cells.alias("__old"), _rank(ref).alias("__ref")).groupBy(*[f"__kr{i}" for i in range(len(keys))]).agg(pick("__old", "__ref").alias("__old"), pick("__ref", "__ref").alias("__ref"))
    new_keys, new_there = _keys(f, keys, "l", False, False, False)
    new = f.df.select("*", *new_keys, new_there.alias("__there"), F.lit(True).alias("__new"))
    condition = F.col("__there")
    for i in range(len(keys)):
        condition = condition & F.col(f"__kl{i}").eqNullSafe(F.col(f"__kr{i}"))
    j = new.join(old, condition, "full" if removed else "left")
    was = lambda c: F.col(f"__old.o{ref.columns.index(c)}")
    differs = {c: ~named(c).eqNullSafe(was(c)) for c in shared}
    short = lambda c, kind: (lambda t: F.when(F.char_length(t) > 30, F.concat(F.substring(t, 1, 29), F.lit("…"))).otherwise(t))(as_text(c, kind))
    notes = [F.when(d, F.concat(F.lit(f"{c}: "), short(was(c), ref.kind(c)), F.lit(" → "), short(named(c), f.kind(c)))) for c, d in differs.items()]
    both = F.col("__new") & F.col("__old").isNotNull()
    any_change = F.exists(F.array(*differs.values()), lambda x: x) if differs else F.lit(False)
    diff = F.when(F.col("__new").isNull(), "removed").when(F.col("__old").isNull(), "added").when(any_change, "changed").otherwise("unchanged")
    changes = F.when(both, F.concat_ws("; ", *notes)).otherwise("")
    made = {c: F.when(F.col("__new"), named(c)).otherwise(was(c) if c in ref.columns else F.lit(None)) for c in f.columns}
    out = j.withColumns({"_diff": diff, "_changes": changes, "__gone": F.col("__new").isNull()} | {f"__m{i}": made[c] for i, c in enumerate(f.columns)})
    hidden = [c for c in f.hidden]
    shown = [F.col(f"__m{i}").alias(c) for i, c in enumerate(f.columns)]
    out = out.select(*shown, "_diff", "_changes", "__gone", F.col("__ref").alias("__refrank"), *hidden)
    return Frame(out, ("__gone", *f.order, "__refrank"))


