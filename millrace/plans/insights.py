"""Profiles, histograms, suggestions and contracts, each in one or two aggregations over the table."""

from __future__ import annotations

import itertools
import os
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.values import ambiguous_date, as_date, as_number, as_text, is_blank, may_be_date, may_be_number, named, natural_key, number_locale, parse_date, parse_number, strip
from millrace.operators.frame import Frame


def inferred(f: Frame, sample: int = 400, share: float = 0.9) -> dict[str, tuple[str, str]]:
    """Column -> (number, date or text; us or eu), from the first rows: a bounded probe of all text columns at once. Typed columns answer for themselves."""
    out: dict[str, tuple[str, str]] = {}
    for c in f.columns:
        kind = f.kind(c)
        out[c] = ("number" if isinstance(kind, T.NumericType) else "date" if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType) else "text", "us")
    texts = f.texts()
    if not texts:
        return out
    head = f.page(0, sample)
    aggs = []
    for i, c in enumerate(texts):
        v = named(c)
        full = ~is_blank(v)
        number = parse_number(v).isNotNull() | parse_number(v, "eu").isNotNull()
        aggs += [F.sum(full.cast("int")).alias(f"n{i}"), F.sum((full & number).cast("int")).alias(f"m{i}"), F.sum((full & ~number & parse_date(v).isNotNull()).cast("int")).alias(f"d{i}"), number_locale(v).alias(f"l{i}")]
    seen = head.agg(*aggs).first()
    for i, c in enumerate(texts):
        n, m, d = seen[f"n{i}"] or 0, seen[f"m{i}"] or 0, seen[f"d{i}"] or 0
        kind = "text" if not n else "date" if d >= share * n or (m + d >= share * n and d > m) else "number" if m >= share * n else "text"
        out[c] = (kind, seen[f"l{i}"])
    return out


def profile(f: Frame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n, empty, filled, distinct_values, min_length, max_length, min_number, max_number, sum_number, mean_number, spaced, unparsed), a row for each column, from one aggregation."""
    columns = list(columns or f.columns)
    rows = []
    for c in columns:
        v, kind = named(c), f.kind(c)
        full, n = ~is_blank(v, kind), as_number(v, kind)
        text = as_text(v, kind)
        rows.append(
            F.struct(
                F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.sum((~full).cast("long")).alias("empty"), F.sum(full.cast("long")).alias("filled"), F.count_distinct(F.when(full, v)).alias("distinct_values"),
                F.min(F.when(full, F.char_length(text))).cast("long").alias("min_length"), F.max(F.when(full, F.char_length(text))).cast("long").alias("max_length"),
                F.min(n).alias("min_number"), F.max(n).alias("max_number"), F.sum(n).alias("sum_number"), F.avg(n).alias("mean_number"), F.sum((full & (text != strip(text))).cast("long")).alias("spaced"), F.sum((full & n.isNull()).cast("long")).alias("unparsed"),
            )
        )
    out = f.df.agg(*[r.alias(f"r{i}") for i, r in enumerate(rows)])
    return out.select(F.explode(F.array(*[f"r{i}" for i in range(len(rows))])).alias("r")).select("r.*")


def distinct_values(f: Frame, column: str, search: str = "", where: Column | None = None, blanks: bool = False) -> DataFrame:
    """(value, n) of the stripped values; order by n falling, then natural_key(value), for a list.

    search keeps values that hold it, without case; where keeps rows, as the filters of the other columns do; blanks counts blank cells as a value that no search hides.
    """
    text = strip(as_text(f.col(column), f.kind(column)))
    wanted = (text != "") & F.lower(text).contains(search.lower()) if search else text != ""
    rows = f.df if where is None else f.df.where(where)
    return rows.where(wanted | (text == "") if blanks else wanted).groupBy(text.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def facets(f: Frame, filters: dict[str, Column], columns: Sequence[str] = ()) -> DataFrame:
    """(column, value, n): the distinct stripped values of columns, those of filters if none are given, each counted under the filters of the other columns.

    filters has a condition a column, at most 62. Each row keeps a mask of the filters it fails; it counts for a column if it fails none, or that column's own only, so one scan and
    one grouping serve all columns. A filter that is null fails. Blank cells aren't counted.
    """
    if len(filters) > 62:
        raise ValueError("at most 62 filters")
    wanted = list(columns) or list(filters)
    bits = {c: 1 << i for i, c in enumerate(filters)}
    failed = reduce(Column.__add__, [F.when(F.coalesce(cond, F.lit(False)), F.lit(0)).otherwise(F.lit(bits[c])).cast("long") for c, cond in filters.items()], F.lit(0).cast("long"))
    cells = [F.struct(F.lit(c).alias("column"), strip(as_text(f.col(c), f.kind(c))).alias("value"), F.lit(bits.get(c, 0)).cast("long").alias("own")) for c in wanted]
    rows = f.df.select(failed.alias("failed"), F.array(*cells).alias("cells")).where("failed = 0 or bit_count(failed) = 1")
    each = rows.select(F.explode(F.filter("cells", lambda x: ((F.col("failed") == 0) | (F.col("failed") == x["own"])) & (x["value"] != ""))).alias("x"))
    return each.groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))


def top_values(f: Frame, column: str, n: int = 6) -> DataFrame:
    return distinct_values(f, column).orderBy(F.desc("n"), natural_key(F.col("value"))).limit(n)


def histogram(f: Frame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n): equal-width bins of a number column, the last one closed; empty bins are left out."""
    v = as_number(f.col(column), f.kind(column))
    ends = f.df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("e.lo")) / width), F.lit(bins - 1))).otherwise(0)
    rows = f.df.select(v.alias("v")).where("v IS NOT NULL").withColumn("e", ends)
    out = rows.withColumns({"bin": at.cast("long"), "low": F.col("e.lo") + at * width, "high": F.col("e.lo") + (at + 1) * width})
    return out.groupBy("bin", "low", "high").agg(F.count(F.lit(1)).alias("n"))


def date_histogram(f: Frame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n): bins of whole days, as many days as the span takes for `bins` bins at most; empty bins are left out."""
    d = as_date(f.col(column), f.kind(column))
    ends = f.df.agg(F.struct(F.min(d).alias("lo"), F.max(d).alias("hi"))).scalar()
    width = F.greatest(F.lit(1), F.ceil((F.datediff("e.hi", "e.lo") + 1) / bins)).cast("int")
    at = F.floor(F.datediff("d", "e.lo") / width).cast("int")
    rows = f.df.select(d.alias("d")).where("d IS NOT NULL").withColumn("e", ends)
    out = rows.withColumns({"bin": at.cast("long"), "low": F.date_add("e.lo", at * width), "high": F.least(F.date_add("e.lo", (at + 1) * width - 1), F.col("e.hi"))})
    return out.groupBy("bin", "low", "high").agg(F.count(F.lit(1)).alias("n"))


def selection_stats(f: Frame, columns: Sequence[str]) -> DataFrame:
    """(count, numeric_count, sum, avg, min, max) over the cells of columns."""
    cells = f.df.select(F.explode(F.array(*[F.struct(as_text(f.col(c), f.kind(c)).alias("t"), as_number(f.col(c), f.kind(c)).alias("n")) for c in columns])).alias("x")).select("x.*")
    return cells.where(strip("t") != "").agg(F.count(F.lit(1)).alias("count"), F.count("n").alias("numeric_count"), F.sum("n").alias("sum"), F.avg("n").alias("avg"), F.min("n").alias("min"), F.max("n").alias("max"))


#: How much an issue matters.
SEVERITY = {
    "totals": "high", "repeatedHeader": "high", "artifacts": "medium", "emptyRows": "medium", "duplicates": "medium", "invisible": "medium", "mixedDates": "medium", "notNumber": "medium",
    "emptyCols": "low", "whitespace": "low", "numText": "low", "dates": "low", "ambiguousDates": "low", "caseVariants": "low", "structured": "low",
}
#: What the first cell of a totals row says, and rows that a page break leaves behind.
TOTAL = r"(?i)^(?:(?:grand |sub)?-?totals?\b|sum\b)"
ARTIFACT = r"(?i)^(?:page \d+(?: of \d+)?|[-=_*\s]{3,})$"


def issues(f: Frame) -> DataFrame:
    """(kind, column, n, severity): what may need cleaning, over all rows: an aggregation over the rows and one over each text column, and groupings for repeated rows and case variants.

    Counts of cells are of the kind's column; emptyRows, totals, repeatedHeader, artifacts and duplicates count rows. A text
    column is one of numbers or dates if nine tenths of its cells are: numText and dates count the cells that are, notNumber those that aren't.
    """
    row = F.concat_ws(" ", *[F.nullif(strip(as_text(f.col(c), f.kind(c))), F.lit("")) for c in f.columns])
    repeats = _and([F.lower(strip(as_text(f.col(c), f.kind(c)))) == c.strip().lower() for c in f.columns])
    total = lambda x: F.coalesce(F.sum(F.coalesce(x, F.lit(False)).cast("long")), F.lit(0))
    listed = lambda one, found: one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column"), n.alias("n")) for k, c, n in found])).alias("x")).select("x.*")
    whole = [("emptyRows", row == ""), ("totals", row.rlike(TOTAL)), ("repeatedHeader", repeats), ("artifacts", row.rlike(ARTIFACT))]
    one = f.df.agg(F.count(F.lit(1)).alias("rows"), *[total(x).alias(k) for k, x in whole], *[total(~f.blank(c)).alias(f"full{i}") for i, c in enumerate(f.columns)])
    empty = [("emptyCols", c, ((F.col(f"full{i}") == 0) & (F.col("rows") > 0)).cast("long")) for i, c in enumerate(f.columns)]
    flat = listed(one, [*[(k, "", F.col(k)) for k, _ in whole], *empty])
    for c in f.texts():  # a column at a time: small generated code, and a scan of that column only
        # Each step is a column, worked out once for a row. Numbers and days have a digit and 40 signs at most: no other cell, above all no long text, is looked at for them, and only what looks like one is parsed.
        v, t, w = F.col("v"), F.col("t"), F.col("w")
        slim = f.df.select(f.col(c).alias("v")).withColumn("t", strip(v)).withColumn("w", F.when((F.length(t) <= 40) & t.rlike("[0-9]"), t))
        slim = slim.withColumns({"x": F.when(may_be_number(w), w), "day": parse_date(F.when(may_be_date(w), w)).isNotNull()})
        x = F.col("x")
        shapes = {
            "whitespace": (t != "") & ((v != t) | t.rlike(r"[ \t]{2}")),
            "invisible": v.rlike(r"[\u00A0\u200B-\u200D\u2060\uFEFF\u2018\u2019\u201C\u201D\u0000-\u0008\u000B\u000C\u000E-\u001F]"),
            "ambiguousDates": ambiguous_date(t), "structured": t.rlike(r"(?s)^[{\[].*[}\]]$"),
            "full": t != "", "number": parse_number(x).isNotNull() | parse_number(x, "eu").isNotNull(), "day": F.col("day"), "iso": F.col("day") & w.rlike(r"^\d{4}-"),
        }
        one = slim.agg(*[total(flag).alias(k) for k, flag in shapes.items()])
        n = {k: F.col(k) for k in shapes}
        if_numbers = lambda x: F.when(F.col("number") >= 0.9 * F.col("full"), x).otherwise(0)
        if_dates = lambda x: F.when((F.col("day") >= 0.9 * F.col("full")) & (F.col("number") < F.col("day")), x).otherwise(0)
        found = [(k, c, n[k]) for k in list(shapes)[:4]]
        found += [("numText", c, if_numbers(n["number"])), ("notNumber", c, if_numbers(n["full"] - n["number"])), ("dates", c, if_dates(n["day"])), ("mixedDates", c, if_dates(F.least(n["iso"], n["day"] - n["iso"])))]
        flat = flat.unionByName(listed(one, found))
    # Texts of over 64 signs by a digest of 65, so that they aren't shuffled.
    keys = [F.when(F.length(f.col(c)) > 64, F.concat(F.sha2(f.col(c).cast("binary"), 256), F.lit("#"))).otherwise(f.col(c)) if c in f.texts() else f.col(c) for c in f.columns]
    rows = f.df.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).count()
    counted = lambda df, kind, c, n: df.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n")).select(F.lit(kind).alias("kind"), F.lit(c).alias("column"), "n")
    flat = flat.unionByName(counted(rows.where("count > 1"), "duplicates", "", F.col("count") - 1))
    for c in f.texts():  # values by hash, so that long texts aren't shuffled
        v = strip(f.col(c))
        groups = f.df.where(v != "").groupBy(F.xxhash64(F.lower(v)).alias("h")).agg(F.min(F.xxhash64(v)).alias("a"), F.max(F.xxhash64(v)).alias("b"))
        flat = flat.unionByName(counted(groups.where("a <> b"), "caseVariants", c, F.lit(1)))
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return flat.where("n > 0").withColumn("severity", severity[F.col("kind")])


def case_variants(f: Frame, column: str) -> DataFrame:
    """(folded, variants, n): values that differ in case or outer white space only."""
    v = strip(f.col(column))
    out = f.df.where(~f.blank(column)).groupBy(F.lower(v).alias("folded")).agg(F.count_distinct(f.col(column)).alias("variants"), F.count(F.lit(1)).alias("n"))
    return out.where("variants > 1")


def _and(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


@dataclass(frozen=True)
class Shape:
    """A column's contract: its null rate, its distinct values if there are few, its range of numbers, and whether nine tenths of its cells are numbers."""

    null_rate: float
    values: frozenset[str] | None
    low: float | None
    high: float | None
    numeric: bool = False


def contract(f: Frame, most: int = 20) -> dict[str, Shape]:
    """The shapes of all columns from one aggregation; value sets are kept up to `most` values."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(f.columns):
        v, kind = named(c), f.kind(c)
        text, n = strip(as_text(v, kind)), as_number(v, kind)
        aggs += [F.sum(is_blank(v, kind).cast("long")).alias(f"e{i}"), F.approx_count_distinct(text).alias(f"d{i}"), F.min(n).alias(f"l{i}"), F.max(n).alias(f"h{i}"), F.count(n).alias(f"m{i}")]
    seen = f.df.agg(*aggs).first()
    few = [i for i in range(len(f.columns)) if seen[f"d{i}"] <= 2 * most]
    sets = {}
    if few:
        got = f.df.agg(*[F.collect_set(F.when(~f.blank(f.columns[i]), strip(as_text(f.col(f.columns[i]), f.kind(f.columns[i]))))).alias(f"s{i}") for i in few]).first()
        sets = {i: frozenset(got[f"s{i}"]) for i in few if len(got[f"s{i}"]) <= most}
    n = seen["n"] or 1
    numeric = lambda i: 0 < 0.9 * (seen["n"] - seen[f"e{i}"]) <= seen[f"m{i}"]
    return {c: Shape((seen[f"e{i}"] or 0) / n, sets.get(i), seen[f"l{i}"], seen[f"h{i}"], seen["n"] > 0 and numeric(i)) for i, c in enumerate(f.columns)}


def drift(old: dict[str, Shape], new: dict[str, Shape], null_points: float = 0.05) -> list[tuple[str, str, str]]:
    """(kind, column, detail): missing and added columns, new values, a null rate or range that moved, a column that is no longer of numbers."""
    out = [("missing", c, "") for c in old if c not in new] + [("added", c, "") for c in new if c not in old]
    for c in old.keys() & new.keys():
        a, b = old[c], new[c]
        if a.values is not None and b.values is not None and (fresh := b.values - a.values):
            out.append(("newValue", c, ", ".join(sorted(fresh)[:5])))
        if abs(b.null_rate - a.null_rate) >= null_points:
            out.append(("nullRate", c, f"{a.null_rate:.2f} → {b.null_rate:.2f}"))
        if a.numeric and not b.numeric:
            out.append(("type", c, "no longer numbers"))
        if None not in (a.low, a.high, b.low, b.high) and (b.low < a.low or b.high > a.high):
            out.append(("range", c, f"{b.low:g} to {b.high:g}"))
    return sorted(out)


def like_these(f: Frame, chosen: Column, columns: Sequence[str] | None = None, most: int = 3) -> list[tuple[str, str, int, int]]:
    """(column, value, chosen rows, other rows): values that all chosen rows share, those with the fewest other rows first. One aggregation for the values, one for the counts."""
    columns = list(columns or f.columns)
    text = {c: strip(as_text(f.col(c), f.kind(c))) for c in columns}
    seen = f.df.where(chosen).agg(*[F.min(text[c]).alias(f"a{i}") for i, c in enumerate(columns)], *[F.max(text[c]).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    shared = {c: seen[f"a{i}"] for i, c in enumerate(columns) if seen[f"a{i}"] not in (None, "") and seen[f"a{i}"] == seen[f"b{i}"]}
    if not shared:
        return []
    n = f.df.agg(*[F.sum((text[c] == v).cast("long")).alias(f"n{i}") for i, (c, v) in enumerate(shared.items())], F.sum(chosen.cast("long")).alias("k")).first()
    out = [(c, v, n["k"], n[f"n{i}"] - n["k"]) for i, (c, v) in enumerate(shared.items())]
    return sorted(out, key=lambda x: (x[3], x[0]))[:most]


def rules_like(f: Frame, chosen: Column, columns: Sequence[str] | None = None, most: int = 3) -> list[tuple[str, int, int]]:
    """(rule, chosen rows, other rows): rules that all chosen rows fulfil, those with the fewest other rows first; pairs of the best five where no single rule is exact.

    A rule is empty, equals, startsWith (three characters at least) or, for columns of numbers and days, gte and lte. One
    aggregation finds the candidates (the common start of all texts is that of the smallest and the largest), one counts
    them and one counts the pairs.
    """
    columns = list(columns or f.columns)
    text = {c: F.lower(strip(as_text(f.col(c), f.kind(c)))) for c in columns}
    ranged = [c for c in columns if isinstance(f.kind(c), T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType)]
    ends = [(k, e, c) for k, e in (("a", F.min), ("b", F.max)) for c in columns]
    seen = f.df.where(chosen).agg(F.count(F.lit(1)).alias("k"), *[e(text[c]).alias(f"{k}{columns.index(c)}") for k, e, c in ends], *[e(f.col(c)).alias(f"{k}{k}{columns.index(c)}") for k, e, c in ends if c in ranged]).first()
    rules: dict[str, Column] = {}
    for i, c in enumerate(columns):
        a, b = seen[f"a{i}"], seen[f"b{i}"]
        if a is None:
            continue
        start = os.path.commonprefix([a, b])
        if b == "":
            rules[f"{c} empty"] = text[c] == ""
        elif a == b:
            rules[f"{c} equals {a}"] = text[c] == a
        elif a and c in ranged:
            low, high = seen[f"aa{i}"], seen[f"bb{i}"]
            rules |= {f"{c} gte {low}": f.col(c) >= F.lit(low), f"{c} lte {high}": f.col(c) <= F.lit(high)}
        elif len(start.strip()) >= 3:
            rules[f"{c} startsWith {start}"] = text[c].startswith(start)
    if not rules:
        return []
    others = lambda x: F.coalesce(F.sum((F.coalesce(x, F.lit(False)) & ~F.coalesce(chosen, F.lit(False))).cast("long")), F.lit(0))

    def counted(rules: dict[str, Column]) -> list[tuple[str, int, int]]:
        n = f.df.agg(*[others(x).alias(f"n{i}") for i, x in enumerate(rules.values())]).first()
        return sorted(((name, seen["k"], n[f"n{i}"]) for i, name in enumerate(rules)), key=lambda x: (x[2], x[0]))

    out = counted(rules)
    if len(out) > 1 and out[0][2] > 0:
        alone = {name: n for name, _, n in out}
        pairs = {" and ".join(x): x for x in itertools.combinations(sorted(list(alone)[:5]), 2)}
        better = [x for x in counted({name: rules[a] & rules[b] for name, (a, b) in pairs.items()}) if x[2] < min(alone[r] for r in pairs[x[0]])]
        out = sorted(out + better, key=lambda x: (x[2], x[0] in pairs, x[0]))
    return out[:most]


def find_cells(f: Frame, needle: str, key: str) -> DataFrame:
    """(key, column): cells that hold a text, without case."""
    hits = [F.when(F.lower(as_text(f.col(c), f.kind(c))).contains(needle.lower()), F.lit(c)) for c in f.columns]
    return f.df.select(f.col(key).alias(key), F.explode(F.array_compact(F.array(*hits))).alias("column"))


def changed_cells(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(column, n): how many cells a step changed, by the columns both have."""
    shared = [c for c in before.columns if c in after.columns and c != key and not c.startswith("__")]
    j = before.alias("a").join(after.alias("b"), key)
    one = j.agg(*[F.sum((~named(c, "a").eqNullSafe(named(c, "b"))).cast("long")).alias(f"n{i}") for i, c in enumerate(shared)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n")) for i, c in enumerate(shared)])).alias("x")).select("x.*")


def lineage(states: Sequence[tuple[str, Frame]], key: str, value, column: str) -> list[tuple[str, str | None]]:
    """(step, cell) through named states of a table for one row; a row or column that is not there any more gives None."""
    parts = []
    for i, (name, f) in enumerate(states):
        if column in f.columns and key in f.df.columns:
            parts.append(f.df.where(f.df[key] == value).select(F.lit(i).alias("i"), F.lit(name).alias("step"), as_text(f.col(column), f.kind(column)).alias("cell")).limit(1))
    got = {}
    if parts:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        got = {r["i"]: r["cell"] for r in out.collect()}
    return [(name, got.get(i)) for i, (name, _) in enumerate(states)]


