"""Value kernels: how cells of text are read as blanks, numbers and dates, and printed again. Column in, Column out."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the cleaning rules know it, for Java regular expressions.
SPACE = r"\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: Currency signs and codes that may stand before or after a number.
CURRENCY = r"[$€£¥₹₩₽₺₴₦₪﷼]|(?i:usd|eur|gbp)"
#: The first three letters of the English months.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


#: The same characters one by one.
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def quoted(name: str) -> str:
    """A column's name for Spark, whatever signs are in it."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str, side: str = "") -> Column:
    """The column of a name, with dots, blanks or backticks in it or not; side: an alias to take it of."""
    return F.col(f"{side}.{quoted(name)}" if side else quoted(name))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"[ \t\u00A0]+", " "))


def is_blank(c: Column, kind: T.DataType | None = None) -> Column:
    """Null, or text of white space only. Give the column's type where it is known, to keep typed columns free of casts."""
    if kind is not None and not isinstance(kind, T.StringType):
        return c.isNull()
    return c.isNull() | (strip(c.cast("string")) == "")


def non_blank(c: Column, kind: T.DataType | None = None) -> Column:
    """c, or null where it is blank."""
    return F.when(~is_blank(c, kind), c)


def fold(c: Column) -> Column:
    """Lower case for comparisons: dotted capital I is i, final sigma is sigma, long s is s."""
    return F.translate(F.lower(F.replace(c, F.lit("İ"), F.lit("i"))), "ςſ", "σs")


def parse_number(c: Column, locale: str = "us", percent_as_fraction: bool = True) -> Column:
    """Double of a text as people write numbers, or null: parentheses and signs, currencies, group marks, percent; `us` 1,234.5 or `eu` 1.234,5."""
    # A plain chain of replacements, each used once or twice: branches would be copied into each other.
    raw = strip(c)
    signed = strip(F.regexp_replace(raw, r"^\((.*)\)$", "$1"))
    rated = strip(F.regexp_replace(signed, r"^[-−+]", ""))
    priced = F.regexp_replace(strip(F.regexp_replace(rated, "%$", "")), rf"^(?:{CURRENCY})[{SPACE}]*|[{SPACE}]*(?:{CURRENCY})$", "")
    t = F.regexp_replace(priced, rf"^[-−+]|[{SPACE}']", "")
    minus = signed.rlike(r"^[-−]") | priced.rlike(r"^[-−]")
    if locale == "eu":
        fine = t.rlike(r"^(?:[1-9]\d{0,2}(?:\.\d{3})+|\d+)(?:,\d*)?$|^,\d+$")
        digits = F.translate(t, ",.", ".")
    else:
        fine = t.rlike(r"^(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?(?:[eE][-+]?\d+)?$|^\.\d+(?:[eE][-+]?\d+)?$")
        digits = F.replace(t, F.lit(","), F.lit(""))
    value = F.when(fine & (F.length(raw) <= 40), digits.try_cast("double"))
    value = value * F.when(raw.rlike(r"^\(.*\)$") != minus, -1.0).otherwise(1.0)
    return value * F.when(rated.rlike("%$"), 0.01).otherwise(1.0) if percent_as_fraction else value


def may_be_number(t: Column) -> Column:
    """Whether a stripped text has the signs of numbers only: true wherever parse_number finds one, and far cheaper."""
    return t.rlike(rf"^(?:[-−+()%.,'0-9eE{SPACE}]|{CURRENCY})+$")


def number_locale(values: Column) -> Column:
    """Aggregate over text: `eu` if strictly more values are shaped like 1.234,5 than like 1,234.5, else `us`."""
    t = strip(values)
    eu = t.rlike(r"\d,\d{1,2}$|\d,\d{4,}$|\.\d{3},|\.\d{3}\.\d{3}")
    us = t.rlike(r"\d\.\d{1,2}$|\d\.\d{4,}$|,\d{3}\.|,\d{3},\d{3}")
    return F.when(F.sum(eu.cast("int")) > F.sum(us.cast("int")), "eu").otherwise("us")


def detected_locale(df: DataFrame, column: str, sample: int = 250) -> str:
    """number_locale of a text column's first non-blank cells: a probe of a bounded number of rows."""
    c = named(column)
    return df.where(~is_blank(c)).select(c.alias("v")).limit(sample).agg(number_locale(F.col("v"))).first()[0] or "us"


def _date(y: Column, m: Column, d: Column) -> Column:
    """A real calendar day of the years 1000 to 2999, or null."""
    text = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    # The year's text, of four digits, tells its thousand: the day's own would work the day out anew for each use.
    return F.when(y.rlike("^[12]"), F.try_to_date(text, "yyyy-MM-dd"))


def _year(y: Column, pivot: int) -> Column:
    short = y.try_cast("int")
    return F.when(F.length(y) == 2, F.when(short <= pivot, short + 2000).otherwise(short + 1900).cast("string")).otherwise(y)


def _month(name: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3)))
    return F.when(at > 0, at.cast("string"))


def parse_date(c: Column, order: str = "mdy", pivot: int = 69) -> Column:
    """Date of a text, or null. Y-M-D; a/b/Y, where a part over 12 decides and else order (`mdy`, `dmy`, or `reject` for neither); Mon D, Y and D Mon Y; YYYYMMDD. Times are read over."""
    t = strip(c)
    part = lambda p, k: F.regexp_extract(t, p, k)
    time = r"(?:[T ,]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?: ?[AaPp][Mm])?(?: ?(?:Z|[-+]\d{2}:?\d{2}))?)?"
    ymd = rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){time}$"
    slash = rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}){time}$"
    week = r"^(?:[A-Za-z]{3,9},? +)?"
    mon_d = week + r"([A-Za-z]{3,9})\.? +(\d{1,2})(?:st|nd|rd|th)?,? +(\d{4})$"
    d_mon = week + r"(\d{1,2})(?:st|nd|rd|th)?[ -]+([A-Za-z]{3,9})\.?,?[ -]+(\d{4})$"
    plain = r"^(\d{4})(\d{2})(\d{2})$"
    a, b, y = part(slash, 1), part(slash, 2), _year(part(slash, 3), pivot)
    day_first = _date(y, b, a)
    month_first = _date(y, a, b)
    by_order = {"mdy": month_first, "dmy": day_first}.get(order, F.lit(None).cast("date"))
    by_order = F.when(a.try_cast("int") == b.try_cast("int"), month_first).otherwise(by_order) if order == "reject" else by_order
    over = lambda x: x.rlike(r"^(?:1[3-9]|[2-9]\d)$")  # noqa: E731 - over 12
    slashed = F.when(over(a), day_first).when(over(b), month_first).otherwise(by_order)
    found = (
        F.when(t.rlike(ymd), _date(part(ymd, 1), part(ymd, 2), part(ymd, 3)))
        .when(t.rlike(slash), slashed)
        .when(t.rlike(mon_d), _date(part(mon_d, 3), _month(part(mon_d, 1)), part(mon_d, 2)))
        .when(t.rlike(d_mon), _date(part(d_mon, 3), _month(part(d_mon, 2)), part(d_mon, 1)))
        .when(t.rlike(plain), _date(part(plain, 1), part(plain, 2), part(plain, 3)))
    )
    return F.when(F.length(t).between(1, 40), found)


def may_be_date(t: Column) -> Column:
    """Whether a stripped text starts as a date of numbers or names a month: true wherever parse_date finds a day, and far cheaper."""
    return t.rlike(rf"^[0-9]{{1,4}}[-/.][0-9]{{1,2}}[-/.][0-9]|^[0-9]{{8}}$|(?i:{'|'.join(MONTHS)})")


def ambiguous_date(c: Column) -> Column:
    """Two parts of up to 12 that differ, so that their order matters."""
    t = strip(c)  # by patterns alone: try_cast of what is no number costs an exception each
    small = t.rlike(r"^(?:0?\d|1[0-2])[-/.](?:0?\d|1[0-2])[-/.](?:\d{4}|\d{2})\b")
    return F.coalesce(small & ~t.rlike(r"^0?(\d+)[-/.]0?\1[-/.]"), F.lit(False))


#: The date formats by name.
DATE_FORMATS = {"iso": "yyyy-MM-dd", "us": "MM/dd/yyyy", "eu": "dd/MM/yyyy", "long": "MMM d, yyyy", "compact": "yyyyMMdd"}


def date_text(c: Column, style: str = "iso") -> Column:
    return F.date_format(c, DATE_FORMATS[style])


def number_text(c: Column) -> Column:
    """A double as people write it: whole numbers plain, others rounded to 1e-10 without trailing zeros; null for null."""
    x = c.cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    fine = F.regexp_replace(F.round(x, 10).try_cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    return F.when(whole, x.cast("long").cast("string")).otherwise(F.coalesce(fine, x.cast("string")))


def as_text(c: Column, kind: T.DataType) -> Column:
    """The canonical text of a column of any type; blank for null."""
    if isinstance(kind, T.StringType):
        t = c
    elif isinstance(kind, T.FloatType | T.DoubleType | T.DecimalType):
        t = number_text(c)
    elif isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        t = F.date_format(c, "yyyy-MM-dd")
    else:
        t = c.cast("string")
    return F.coalesce(t, F.lit(""))


def as_number(c: Column, kind: T.DataType, locale: str = "us", percent_as_fraction: bool = True) -> Column:
    return c.cast("double") if isinstance(kind, T.NumericType) else parse_number(c.cast("string"), locale, percent_as_fraction)


def as_date(c: Column, kind: T.DataType, order: str = "mdy") -> Column:
    return c.cast("date") if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType) else parse_date(c.cast("string"), order)


#: Accented Latin letters and what they are without, worked out from the Unicode decompositions.
_PLAIN = {chr(k): d[0] for k in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(k))) > 1}


def unaccented(c: Column) -> Column:
    return F.translate(c, "".join(_PLAIN), "".join(_PLAIN.values()))


def natural_key(c: Column) -> Column:
    """Sort key under which item 2 comes before item 10, without case or accents."""
    runs = F.regexp_extract_all(F.lower(strip(c)), F.lit(r"(\d+|\D+)"), F.lit(1))
    bare = lambda x: F.coalesce(F.nullif(F.ltrim(x, F.lit("0")), F.lit("")), F.lit("0"))
    key = F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(bare(x), F.greatest(F.lit(40), F.length(x)), F.lit("0"))).otherwise(x))
    return unaccented(F.array_join(key, ""))


def title_case(c: Column) -> Column:
    """First letters up after the start, blanks, -, ( and /, and in O'Brien."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(rf"([{SPACE}(/-]?(?:[a-z]')?[^{SPACE}(/'-]*(?:'[^{SPACE}(/-]*)?)"), F.lit(1))

    def up(x: Column) -> Column:
        lead = F.regexp_extract(x, rf"^[{SPACE}(/-]?", 0)
        rest = F.substring(x, F.length(lead) + 1, F.length(x))
        irish = rest.rlike("^[a-z]'[a-z]")
        return F.concat(lead, F.upper(F.substring(rest, 1, 1)), F.when(irish, F.concat(F.lit("'"), F.upper(F.substring(rest, 3, 1)), F.substring(rest, F.lit(4), F.length(rest)))).otherwise(F.substring(rest, F.lit(2), F.length(rest))))

    return F.array_join(F.transform(parts, up), "")


def sentence_case(c: Column) -> Column:
    low = F.lower(c)
    lead = F.regexp_extract(low, rf"^[{SPACE}]*", 0)
    at = F.length(lead) + 1
    return F.concat(lead, F.upper(F.substring(low, at, F.lit(1))), F.substring(low, at + 1, F.length(low)))
