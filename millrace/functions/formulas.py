"""Spreadsheet functions as Columns.

A formula cell is a value or an error. Errors are nulls here, so `iferror` is a default for null, and what a
spreadsheet shows as an error code (a division by zero, text that is no number, no match) is null. Blank text
counts as 0 in arithmetic, positions count characters from 1, and text comparisons ignore case.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import translated
from .values import DATE_FORMATS, collapse, fold, is_blank, number_text, parse_date, parse_number, strip, title_case  # noqa: F401


def num(c: Column | float, text: bool = False) -> Column:
    """A number out of a number, or out of text if text is set: blank is 0, unreadable null."""
    c = c if isinstance(c, Column) else F.lit(c)
    return F.when(is_blank(c), 0.0).otherwise(parse_number(c)) if text else c.cast("double")


# Logic. `If` and `Ifs` take conditions that may be null, which count as errors and give null.
def If(condition: Column, then: Column, otherwise: Column | None = None) -> Column:
    return F.when(condition, then).when(~condition, F.lit(False) if otherwise is None else otherwise)


def Ifs(*pairs: Column) -> Column:
    out = F.lit(None)
    for condition, value in reversed(list(zip(pairs[::2], pairs[1::2], strict=True))):
        out = F.when(condition, value).when(~condition, out)
    return out


def iferror(value: Column, other: Column) -> Column:
    return F.coalesce(value, other)


def And(*conditions: Column) -> Column:
    """False at the first false argument; an error before it gives null."""
    out = F.lit(True)
    for c in reversed(conditions):
        out = F.when(~c, False).when(c, out)
    return out


def Or(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in reversed(conditions):
        out = F.when(c, True).when(~c, out)
    return out


def Not(condition: Column) -> Column:
    return ~condition


def isblank(c: Column) -> Column:
    return is_blank(c)


def isnumber(c: Column) -> Column:
    return parse_number(c.cast("string")).isNotNull()


def coalesce(*values: Column) -> Column:
    """The first that is not blank, else an empty text."""
    return F.coalesce(*[F.when(~is_blank(v), v) for v in values], F.lit(""))


# Text. Numbers among the arguments are read as they are shown.
def shown_number(x: Column) -> Column:
    """A double with 12 significant digits at most and never an exponent; whole numbers under 10^15 in full."""

    def spelled(p: Column) -> Column:
        digits, e = F.regexp_replace(F.regexp_replace(F.substring_index(p, "e", 1), r"[-.]", ""), "0+$", ""), F.substring_index(p, "e", -1).try_cast("int")
        n = F.length(digits)
        large = F.concat(digits, F.repeat(F.lit("0"), e - n + 1))
        mixed = F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, n))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        return F.concat(F.when(p.startswith("-"), "-").otherwise(""), F.when(e >= n - 1, large).when(e >= 0, mixed).otherwise(small))

    # The argument is bound once: spelled() reads it often.
    said = F.get(F.transform(F.array(F.format_string("%.11e", x)), spelled), F.lit(0))
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.try_cast("long").cast("string")).when(F.abs(x) < float("inf"), said)


def as_shown(c: Column) -> Column:
    """A cell of any type as text; null for null. Spark folds the choice, since a column's type is known."""
    kind = F.typeof(c)
    real = kind.isin("double", "float") | kind.startswith("decimal")
    truth = F.upper(c.cast("string"))
    return F.when(real, shown_number(c.cast("string").try_cast("double"))).when(kind == "boolean", truth).otherwise(c.cast("string"))


def length(c: Column) -> Column:
    return F.char_length(as_shown(c))


def left(c: Column, n: int = 1) -> Column:
    c = as_shown(c)
    return F.lit(None).cast("string") if n < 0 else F.substring(c, 1, n)


def right(c: Column, n: int = 1) -> Column:
    c = as_shown(c)
    return F.lit(None).cast("string") if n < 0 else F.when(F.char_length(c) <= n, c).otherwise(F.right(c, F.lit(n)))


def mid(c: Column, start: int, n: int) -> Column:
    c = as_shown(c)
    return F.lit(None).cast("string") if start < 1 or n < 0 else F.substring(c, start, n)


upper, lower, proper, trim = F.upper, F.lower, title_case, collapse


def concat(*values: Column) -> Column:
    return F.concat(*[F.coalesce(as_shown(v), F.lit("")) for v in values])


def textjoin(joiner: str, skip_blank: bool, *values: Column) -> Column:
    texts = F.array(*[F.coalesce(as_shown(v), F.lit("")) for v in values])
    return F.array_join(F.filter(texts, lambda x: x != "") if skip_blank else texts, joiner)


def substitute(c: Column, old: str, new: str, nth: int | None = None) -> Column:
    """All occurrences, or the nth one only."""
    c = as_shown(c)
    if not old:
        return c
    if nth is None:
        return F.replace(c, F.lit(old), F.lit(new))
    head = F.substring_index(c, old, nth)
    enough = F.char_length(c) - F.char_length(F.replace(c, F.lit(old), F.lit(""))) >= nth * len(old)
    return F.when(enough, F.concat(head, F.lit(new), F.substring(c, F.char_length(head) + len(old) + 1, F.char_length(c)))).otherwise(c)


def replace(c: Column, start: int, n: int, new: str) -> Column:
    c = as_shown(c)
    return F.lit(None).cast("string") if start < 1 or n < 0 else F.concat(F.substring(c, 1, start - 1), F.lit(new), F.substring(c, F.lit(start + n), F.char_length(c)))


def find(needle: str, c: Column, start: int = 1) -> Column:
    return F.nullif(F.locate(needle, as_shown(c), start), F.lit(0))


def search(needle: str, c: Column, start: int = 1) -> Column:
    return F.nullif(F.locate(needle.lower(), fold(as_shown(c)), start), F.lit(0))


def contains(c: Column, needle: str) -> Column:
    return fold(as_shown(c)).contains(fold(F.lit(needle)))


def startswith(c: Column, needle: str) -> Column:
    return fold(as_shown(c)).startswith(fold(F.lit(needle)))


def endswith(c: Column, needle: str) -> Column:
    return fold(as_shown(c)).endswith(fold(F.lit(needle)))


def value(c: Column, order: str = "mdy") -> Column:
    """The number a text stands for; a date's is its serial day."""
    return F.coalesce(parse_number(c), serial(parse_date(c, order)))


_TOKEN = re.compile(r'"([^"]*)"|\\(.)|(y+|m+|d+)|([0#.,]+)|(%)|([^A-Za-z@*_\[\];"\\])', re.IGNORECASE)


def text(c: Column, pattern: str) -> Column:
    """A number by a pattern of 0 # , . % or a date by one of y m d (one to four letters each), with literals between; null for null.

    0 is a digit that is always shown, # one that is shown where it is needed. "…" and \\x are literal.
    """
    parts, at = [], 0
    while at < len(pattern):
        m = _TOKEN.match(pattern, at)
        if not m:
            raise ValueError(f"not a format: {pattern!r}")
        k = m.lastindex
        parts.append(("literal" if k in (1, 2, 6) else {3: "date", 4: "digits", 5: "percent"}[k], m[k]))
        at = m.end()
    if any(kind == "date" for kind, _ in parts):
        if any(kind == "percent" or (kind == "digits" and set(v) - set(".,")) for kind, v in parts):
            raise ValueError(f"not a format: {pattern!r}")
        return F.concat(*[_date_part(c, v.lower()) if kind == "date" else F.lit(v) for kind, v in parts])
    digits = [i for i, (kind, _) in enumerate(parts) if kind == "digits"]
    if len(digits) > 1:
        raise ValueError(f"not a format: {pattern!r}")
    say = lambda some: "".join(v for _, v in some)
    if not digits:
        return F.when(c.isNotNull(), say(parts))
    whole, _, places = parts[digits[0]][1].partition(".")
    if "," in places or "." in places or whole.startswith(",") or whole.endswith(","):
        raise ValueError(f"not a format: {pattern!r}")
    x = c.cast("double") * (100 if any(kind == "percent" for kind, _ in parts) else 1)
    rounded = F.round(F.abs(x).try_cast("decimal(38,12)"), len(places))
    shown = rounded.cast(f"decimal(38,{len(places)})").cast("string")
    ints, least = F.substring_index(shown, ".", 1), whole.count("0")
    ints = F.when(F.length(ints) < least, F.lpad(ints, least, "0")).otherwise(ints) if least else F.when(ints != "0", ints).otherwise("")
    ints = F.regexp_replace(ints, r"\B(?=(\d{3})+(?!\d))", ",") if "," in whole else ints
    sure = places.count("0")
    rest = F.substring_index(shown, ".", -1) if places else F.lit("")
    rest = F.concat(F.substring(rest, 1, sure), F.rtrim(F.substring(rest, sure + 1, 40), F.lit("0")))
    sign = F.when((x < 0) & (rounded != 0), "-").otherwise("")
    return F.concat(sign, F.lit(say(parts[: digits[0]])), ints, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit(say(parts[digits[0] + 1 :])))


def _date_part(c: Column, letters: str) -> Column:
    n, of = len(letters), {"y": F.year, "m": F.month, "d": F.dayofmonth}[letters[0]](c)
    if letters[0] == "y":
        return F.lpad(of.cast("string"), 4, "0") if n > 2 else F.lpad((of % 100).cast("string"), 2, "0")
    if n > 2:
        return F.date_format(c, {"m": "MMM", "d": "EEE"}[letters[0]] + ("" if n == 3 else letters[0].upper() if letters[0] == "m" else "E"))
    return of.cast("string") if n == 1 else F.lpad(of.cast("string"), 2, "0")


# Numbers. Rounding shifts the decimal text, so 1.005 rounds up to 1.01; halves go away from zero.
def round_(c: Column, places: int = 0) -> Column:
    x = c.cast("double")
    return F.when(x.isNotNull(), F.coalesce(F.round(x.try_cast("decimal(38,12)"), places).cast("double"), x))


def _outward(c: Column, places: int, up: bool) -> Column:
    x = c.cast("double")
    shifted = F.abs(x.try_cast("decimal(38,12)")) * F.lit(10.0**places).try_cast("decimal(20,6)")
    whole = F.ceil(shifted) if up else F.floor(shifted)
    return F.signum(x) * whole.cast("double") / F.lit(10.0**places)


def roundup(c: Column, places: int = 0) -> Column:
    return _outward(c, places, True)


def rounddown(c: Column, places: int = 0) -> Column:
    return _outward(c, places, False)


def abs_(c: Column) -> Column:
    return F.abs(c.cast("double"))


def int_(c: Column) -> Column:
    return F.floor(c.cast("double"))


def mod(p: Column, q: Column | float) -> Column:
    """Floored: the sign of the divisor; by zero null."""
    p, q = num(p), F.nullif(num(q), F.lit(0.0))
    return p - q * F.floor(p / q)


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(num(a), num(b))


def power(a: Column, b: Column) -> Column:
    """0^0 and what overflows are null."""
    out = F.pow(num(a), num(b))
    return F.when(~((num(a) == 0) & (num(b) == 0)) & ~F.isnan(out) & (F.abs(out) < float("inf")), out)


def _numbers(values: tuple[Column, ...]) -> Column:
    return F.filter(F.array(*[v.cast("double") for v in values]), lambda x: x.isNotNull())


def sum_(*values: Column) -> Column:
    return F.aggregate(_numbers(values), F.lit(0.0), lambda a, x: a + x)


def average(*values: Column) -> Column:
    return F.try_divide(sum_(*values), F.size(_numbers(values)))


def min_(*values: Column) -> Column:
    return F.coalesce(F.array_min(_numbers(values)), F.lit(0.0))


def max_(*values: Column) -> Column:
    return F.coalesce(F.array_max(_numbers(values)), F.lit(0.0))


# Dates. A serial is the number of days since 1899-12-30.
def serial(c: Column) -> Column:
    return F.datediff(c, F.lit("1899-12-30").cast("date")).cast("double")


def date(y: Column, m: Column, d: Column) -> Column:
    """Months and days beyond their range carry over."""
    return F.date_add(F.add_months(F.try_to_date(F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-01-01"))), (m - 1).cast("int")), (d - 1).cast("int"))


year, month, day = F.year, F.month, F.dayofmonth


def weekday(c: Column, kind: int = 1) -> Column:
    """1: Sunday is 1; 2: Monday is 1; 3: Monday is 0."""
    return F.dayofweek(c) if kind == 1 else F.weekday(c) + (1 if kind == 2 else 0)


def _months_between(a: Column, b: Column) -> Column:
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - F.when(F.dayofmonth(b) < F.dayofmonth(a), 1).otherwise(0)


def datedif(a: Column, b: Column, unit: str) -> Column:
    months = _months_between(a, b)
    out = {
        "D": F.datediff(b, a),
        "M": months,
        "Y": F.floor(months / 12),
        "YM": F.pmod(months, F.lit(12)),
        "MD": F.datediff(b, F.add_months(a, months.cast("int"))),
        "YD": F.datediff(b, F.add_months(a, (F.floor(months / 12) * 12).cast("int"))),
    }[unit.upper()]
    return F.when(a <= b, out.cast("long"))


def edate(c: Column, months: int | Column) -> Column:
    return F.add_months(c, months)


# Patterns, with flags i, m and s. One that Spark can't take is an error when the formula is built.
def regexmatch(c: Column, pattern: str, flags: str = "") -> Column:
    return as_shown(c).rlike(translated(pattern, flags).java)


def regexextract(c: Column, pattern: str, flags: str = "", group: int | None = None) -> Column:
    """The first match, its first group if there is one; null without a match."""
    p, c = translated(pattern, flags), as_shown(c)
    return F.when(c.rlike(p.java), F.regexp_extract(c, p.java, min(1, p.groups) if group is None else group))


def regexreplace(c: Column, pattern: str, new: str, flags: str = "") -> Column:
    p = translated(pattern, flags)
    return F.regexp_replace(as_shown(c), p.java, p.replacement(new))
