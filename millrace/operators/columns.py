"""Steps that name, order, make and take apart columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.dialect import translated
from millrace.functions.ordering import rank
from millrace.functions.values import as_text, strip

from .frame import Frame, unique_names
from .rows import _quoted

#: What the extraction presets look for, without case.
PRESETS = {
    "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "phone": r"\+?\d[\d\s().-]{6,}\d",
    "url": r"(?:https?://|www\.)[^\s<>\"]+",
    "number": r"-?\$?\d[\d,]*(?:\.\d+)?%?",
    "date": r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{2,4}|[A-Za-z]{3,9}\.? \d{1,2},? \d{4}",
    "zip": r"\b\d{5}(?:-\d{4})?\b",
    "hashtag": r"#[\w-]+",
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}


def rename(f: Frame, old: str, new: str) -> Frame:
    if new in f.columns:
        raise ValueError(f"there is a column {new!r} already")
    order = tuple((new if n == old else n, up) for n, up in [(t, True) if isinstance(t, str) else t for t in f.order])
    return Frame(f.df.withColumnRenamed(old, new), order)


def drop_columns(f: Frame, *columns: str) -> Frame:
    if missing := set(columns) - set(f.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    return f.select(*[c for c in f.columns if c not in columns])


def select_columns(f: Frame, *columns: str) -> Frame:
    return f.select(*columns)


def duplicate_column(f: Frame, column: str, name: str | None = None) -> Frame:
    name = unique_names([*f.columns, name or column])[-1]
    at = f.columns.index(column) + 1
    return f.select(*f.columns[:at], f.col(column).alias(name), *f.columns[at:])


def reorder_columns(f: Frame, *first: str) -> Frame:
    """The named ones that exist, then the others."""
    named = [c for c in first if c in f.columns]
    return f.select(*named, *[c for c in f.columns if c not in named])


def drop_empty_columns(f: Frame) -> Frame:
    """One pass finds the columns that are blank throughout; without rows all stay."""
    seen = f.df.agg(F.count(F.lit(1)).alias("n"), *[F.max(~f.blank(c)).alias(f"c{i}") for i, c in enumerate(f.columns)]).first()
    return f.select(*[c for i, c in enumerate(f.columns) if not seen["n"] or seen[f"c{i}"]])


def add_column(f: Frame, name: str, value: Column, after: str | None = None) -> Frame:
    """A column of a formula's values, at the end or after another."""
    name = unique_names([*f.columns, name])[-1]
    at = f.columns.index(after) + 1 if after in f.columns else len(f.columns)
    return f.select(*f.columns[:at], value.alias(name), *f.columns[at:])


def pieces_of(c: Column, delimiter: str) -> Column:
    """Stripped pieces of a text; a blank splits on white space, anything else as it stands."""
    return F.split(strip(c), r"\s+") if delimiter == " " else F.transform(F.split(c, _quoted(delimiter)), strip)


def split_column(f: Frame, column: str, delimiter: str, into: Sequence[str] = (), width: int | None = None, keep: bool = False) -> Frame:
    """Pieces as columns, two at least. width is the most pieces; the last then holds the rest. Without it, one pass finds the widest row."""
    pieces = pieces_of(F.coalesce(f.col(column), F.lit("")), delimiter)
    limit = width
    if width is None:
        width = f.df.agg(F.max(F.size(pieces))).first()[0] or 1
    width = max(2, width)
    joiner = " " if delimiter == " " else delimiter
    parts = [F.coalesce(F.get(pieces, F.lit(i)), F.lit("")) for i in range(width)]
    if limit is not None:
        parts[-1] = F.array_join(F.slice(pieces, width, F.greatest(F.size(pieces) - width + 1, F.lit(0))), joiner)
    names = [into[i] if i < len(into) else f"{column}_{i + 1}" for i in range(width)]
    at = f.columns.index(column)
    before, after = f.columns[: at + keep], f.columns[at + 1 :]
    names = unique_names([*before, *after, *names])[len(before) + len(after) :]
    return f.select(*before, *[p.alias(n) for p, n in zip(parts, names, strict=True)], *after)


def merge_columns(f: Frame, columns: Sequence[str], joiner: str, into: str, skip_blank: bool = True, keep: bool = True) -> Frame:
    cells = F.array(*[as_text(f.col(c), f.kind(c)) for c in columns])
    merged = F.array_join(F.filter(cells, lambda x: strip(x) != "") if skip_blank else cells, joiner)
    rest = [c for c in f.columns if keep or c not in columns]
    at = max(rest.index(c) for c in columns) + 1 if keep else min(f.columns.index(c) for c in columns)
    name = unique_names([*rest, into])[-1]
    return f.select(*rest[:at], merged.alias(name), *rest[at:])


def extract(f: Frame, column: str, into: str, preset: str | None = None, pattern: str | None = None, every: bool = False, flags: str = "") -> Frame:
    """The first match (group 1 if there is one), or all joined by "; "; blank without any. Presets ignore case."""
    p = "(?iu)" + PRESETS[preset] if preset else translated(pattern, flags)
    p, group = (p, min(1, regex.compile(p.replace("(?iu)", "(?i)")).groups)) if preset else (p.java, min(1, p.groups))
    c = F.coalesce(f.col(column), F.lit(""))
    found = F.array_join(F.regexp_extract_all(c, F.lit(p), F.lit(group)), "; ") if every else F.regexp_extract(c, p, group)
    return add_column(f, into, strip(found) if preset in ("email", "phone") else found, column)


def _structured(f: Frame, column: str, cells: Sequence[Column], names: Sequence[str], keep: bool) -> Frame:
    """The column taken apart: cells in its place, or after it if it is kept, under free names."""
    at = f.columns.index(column)
    before, after = f.columns[: at + keep], f.columns[at + 1 :]
    names = unique_names([*before, *after, *names])[len(before) + len(after) :]
    return f.select(*before, *[c.alias(n) for c, n in zip(cells, names, strict=True)], *after)


def json_paths(f: Frame, column: str, most: int = 300) -> list[tuple[str, str]]:
    """(name, path) of all scalar values in a column of JSON texts, `items[0].sku` say, in the order in which rows have them first.

    A grouping a level of nesting, over what is nested that deep; only the paths, a bounded number of them, come to the driver. Texts that are no JSON have none.
    """
    texts = f.df.select(rank(f.df, f.order).alias("o"), F.try_parse_json(f.col(column)).alias("v"), f.col(column).alias("t"))
    rows = texts.where("v is not null").select("o", "t", "v", F.lit("").alias("name"), F.lit("$").alias("path"), F.array().cast("array<int>").alias("at"))
    found: dict[tuple[str, str], tuple] = {}
    while True:
        each = rows.withColumnRenamed("v", "whole").lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("whole").outer()))
        inside = F.schema_of_variant("value")
        mark = F.when(F.col("key").contains("'"), '"').otherwise("'")
        sign = F.concat(F.lit("["), mark, F.col("key"), mark, F.lit("]"))
        place = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))
        name = F.when(F.col("key").isNull(), F.concat("name", place)).when(F.col("name") == "", F.col("key")).otherwise(F.concat("name", F.lit("."), "key"))
        # A parsed object has its keys sorted; their order is the text's.
        order = F.array_position(F.json_object_keys(F.call_function("get_json_object", "t", "path")), F.col("key")).cast("int")
        each = each.select("o", "t", F.col("value").alias("v"), name.alias("name"), F.concat("path", F.coalesce(sign, place)).alias("path"), F.array_append("at", F.coalesce(F.nullif(order, F.lit(0)), F.col("pos"))).alias("at"), (inside.startswith("OBJECT<") | inside.startswith("ARRAY<")).alias("deep"))
        seen = each.groupBy("name", "path").agg(F.min(F.when(~F.col("deep"), F.struct("o", "at"))).alias("leaf"), F.max("deep").alias("deep"), F.min(F.struct("o", "at")).alias("first"))
        level = seen.orderBy("first").limit(most).collect()
        found |= {(r["name"], r["path"]): r["leaf"] for r in level if r["leaf"] is not None}
        if not any(r["deep"] for r in level):
            break
        rows = each.where("deep").drop("deep")
    return [k for k, _ in sorted(found.items(), key=lambda x: x[1])][:most]


def structure_json(f: Frame, column: str, keys: Sequence[str | tuple[str, str]] | None = None, keep: bool = True, unparsed: bool = False) -> Frame:
    """Fields of a JSON text as columns, blank where missing; `a.b` and `a[0]` reach inside. Without keys, all paths that the column has. A text that is no JSON gives blanks, and stands in _unparsed if that is asked for."""
    text = F.coalesce(f.col(column), F.lit(""))
    parsed = F.try_parse_json(text)
    paths = [(k, f"$.{k}") if isinstance(k, str) else k for k in (json_paths(f, column) if keys is None else keys)]
    made = [F.coalesce(F.variant_get(parsed, path, "string"), F.lit("")) for _, path in paths]
    if unparsed:
        made.append(F.when(parsed.isNull(), text).otherwise(""))
    return _structured(f, column, made, [*[k for k, _ in paths], *["_unparsed"] * unparsed], keep)


def _pieces(f: Frame, column: str, pieces: Column, into: Sequence[str], width: int | None, keep: bool) -> Frame:
    if width is None:
        width = max(1, f.df.agg(F.max(F.size(pieces))).first()[0] or 1)
    cells = [F.coalesce(F.get(pieces, F.lit(i)), F.lit("")) for i in range(width)]
    return _structured(f, column, cells, [into[i] if i < len(into) else f"{column}_{i + 1}" for i in range(width)], keep)


def structure_spaces(f: Frame, column: str, into: Sequence[str] = (), width: int | None = None, keep: bool = False) -> Frame:
    """Pieces set apart by tabs or two blanks and more. Without a width, one pass finds the widest row; pieces over it go."""
    return _pieces(f, column, F.split(strip(F.coalesce(f.col(column), F.lit(""))), r"\t+| {2,}"), into, width, keep)


def structure_delimited(f: Frame, column: str, delimiter: str = ",", into: Sequence[str] = (), width: int | None = None, keep: bool = False) -> Frame:
    """Stripped pieces between delimiters, quotes being plain characters. Without a width, one pass finds the widest row; pieces over it go."""
    return _pieces(f, column, F.transform(F.split(F.coalesce(f.col(column), F.lit("")), _quoted(delimiter)), strip), into, width, keep)


def structure_key_values(f: Frame, column: str, keys: Sequence[str], separator: str = ":", keep: bool = False) -> Frame:
    """Values of `key: value` parts as columns, then text: the parts without a key, joined by "; ".

    Parts end at a semicolon, a line break, a pipe, or a comma that another key follows. A key that comes again is key_2, key_3.
    """
    s = _quoted(separator)
    parts = F.transform(F.split(F.coalesce(f.col(column), F.lit("")), rf"[;\n|]|,(?=\s*[\w .\-]{{1,40}}?\s*{s})"), strip)
    pair = rf"(?s)^([\w .\-]{{1,40}}?)\s*{s}\s*(.*)$"

    def value(name: str) -> Column:
        base, n = re.fullmatch(r"(.+)_(\d+)", name).groups() if re.fullmatch(r".+_\d+", name) else (name, "1")
        of = lambda k: F.transform(F.filter(parts, lambda x: F.regexp_extract(x, pair, 1) == k), lambda x: F.regexp_extract(x, pair, 2))
        plain = F.get(of(name), F.lit(0))
        return F.coalesce(plain if n == "1" else F.coalesce(plain, F.get(of(base), F.lit(int(n) - 1))), F.lit(""))

    rest = F.array_join(F.filter(parts, lambda x: ~x.rlike(pair) & (x != "")), "; ")
    return _structured(f, column, [*map(value, keys), rest], [*keys, "text"], keep)


def match_columns(wanted: Sequence[str], have: Sequence[str]) -> dict[str, str]:
    """Wanted name -> the first column of the same name but for case, blanks, underscores, hyphens and dots; names that are there as they stand are left out."""
    bare = lambda c: re.sub(r"[\s_.\-]+", "", c).lower()
    by_name = {bare(c): c for c in reversed(have)}
    return {w: by_name[bare(w)] for w in wanted if w not in have and bare(w) in by_name}


def json_keys(f: Frame, column: str, most: int = 300) -> list[str]:
    """The top-level keys of a JSON column in the order of the first row that has them, from one aggregation."""
    keys = f.df.select(rank(f.df, f.order).alias("o"), F.posexplode(F.json_object_keys(f.col(column))).alias("p", "k"))
    return [r["k"] for r in keys.groupBy("k").agg(F.min(F.struct("o", "p")).alias("o")).orderBy("o").limit(most).collect()]


def pair_names(f: Frame, column: str, separator: str = "=", most: int = 300) -> list[str]:
    """The keys of a column's key=value pairs in the order of the first row that has them, from one aggregation."""
    pair = rf'(?:^|[\s;,|])([\w.\-]+)\s*{_quoted(separator)}\s*(?:"(?:[^"\\]|\\.)*"|[^\s;,|]*)'
    keys = f.df.select(rank(f.df, f.order).alias("o"), F.posexplode(F.regexp_extract_all(F.coalesce(f.col(column), F.lit("")), F.lit(pair), F.lit(1))).alias("p", "k"))
    return [r["k"] for r in keys.groupBy("k").agg(F.min(F.struct("o", "p")).alias("o")).orderBy("o").limit(most).collect()]


def structure_pairs(f: Frame, column: str, keys: Sequence[str], separator: str = "=", keep: bool = True) -> Frame:
    """Values of key=value pairs (logfmt: bare or quoted) as columns."""
    at = f.columns.index(column)
    before, after = f.columns[: at + keep], f.columns[at + 1 :]
    c = F.coalesce(f.col(column), F.lit(""))

    def value(k: str) -> Column:
        raw = F.regexp_extract(c, rf'(?:^|[\s;,|]){_quoted(k)}\s*{_quoted(separator)}\s*("(?:[^"\\]|\\.)*"|[^\s;,|]*)', 1)
        return F.regexp_replace(F.regexp_replace(raw, r'^"|"$', ""), r"\\(.)", "$1")

    return f.select(*before, *[value(k).alias(k) for k in keys], *after)


def structure_fixed(f: Frame, column: str, cuts: Sequence[int], into: Sequence[str] = (), keep: bool = True) -> Frame:
    """Stripped slices between character positions, the last one open."""
    at = f.columns.index(column)
    before, after = f.columns[: at + keep], f.columns[at + 1 :]
    ends = [*cuts[1:], None]
    parts = [strip(F.substring(f.col(column), a + 1, 1 << 30 if b is None else b - a)) for a, b in zip(cuts, ends, strict=True)]
    names = [into[i] if i < len(into) else f"{column}_{i + 1}" for i in range(len(cuts))]
    return f.select(*before, *[p.alias(n) for p, n in zip(parts, names, strict=True)], *after)


def structure_pattern(f: Frame, column: str, pattern: str, into: Sequence[str] = (), keep: bool = True, flags: str = "") -> Frame:
    """Groups of a pattern as columns, blank where it doesn't match. Names not given are those of the groups, or column_N."""
    p = translated(pattern, flags)
    if not p.groups:
        raise ValueError("the pattern has no groups")
    at = f.columns.index(column)
    before, after = f.columns[: at + keep], f.columns[at + 1 :]
    c = F.coalesce(f.col(column), F.lit(""))
    names = [into[i] if i < len(into) else n or f"{column}_{i + 1}" for i, n in enumerate(p.names)]
    names = unique_names([*before, *after, *names])[len(before) + len(after) :]
    return f.select(*before, *[F.coalesce(F.regexp_extract(c, p.java, i), F.lit("")).alias(n) for i, n in enumerate(names, 1)], *after)
