"""Transforms learned from examples: 16 kinds of text change as Columns, and a search for those that fit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .values import DATE_FORMATS, date_text, number_text, parse_date, parse_number, sentence_case, strip, title_case

#: The character classes that can be stripped or kept.
CLASSES = {"digits": "0-9", "letters": r"\p{L}", "punctuation": r"\p{P}\p{S}", "space": r"\s"}
#: The patterns that can be extracted.
PATTERNS = {"number": r"-?\d+(?:[.,]\d+)*", "word": r"\p{L}+", "email": r"[\w.+-]+@[\w-]+\.[\w.-]+", "parenthesised": r"(?<=\()[^)]*(?=\))", "quoted": r'(?<=")[^"]*(?=")'}

Change = tuple


def apply(change: Change, c: Column) -> Column:
    """A change as a Column; null where it doesn't fit a cell."""
    kind, *a = change
    if kind == "trim":
        return strip(c)
    if kind == "case":
        return {"lower": F.lower, "upper": F.upper, "title": title_case, "sentence": sentence_case}[a[0]](c)
    if kind == "stripClass":
        return F.regexp_replace(c, f"[{CLASSES[a[0]]}]", "")
    if kind == "keepClass":
        return F.regexp_replace(c, f"[^{CLASSES[a[0]]}]", "")
    if kind == "extractPattern":
        return F.nullif(F.regexp_extract(c, PATTERNS[a[0]], 0), F.lit(""))
    if kind == "splitTake":
        parts = F.split(c, "\\Q" + a[0] + "\\E")
        return strip(F.try_element_at(parts, F.lit(a[1])))
    if kind == "dateReformat":
        return date_text(parse_date(c, a[1]), a[0])
    if kind == "numberReformat":
        return number_text(parse_number(c, a[0]))
    if kind == "addPrefix":
        return F.concat(F.lit(a[0]), c)
    if kind == "removePrefix":
        return F.when(c.startswith(a[0]), F.substring(c, F.lit(len(a[0]) + 1), F.char_length(c)))
    if kind == "addSuffix":
        return F.concat(c, F.lit(a[0]))
    if kind == "removeSuffix":
        return F.when(c.endswith(a[0]), F.left(c, F.char_length(c) - len(a[0])))
    if kind == "pad":
        return F.when(F.char_length(c) < a[0], F.lpad(c, a[0], a[1])).otherwise(c)  # lpad alone would cut longer cells
    if kind == "replaceLiteral":
        return F.replace(c, F.lit(a[0]), F.lit(a[1]))
    if kind == "mapValue":
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in a[0] for x in pair]), c)
    if kind == "compose":
        return apply(a[1], apply(a[0], c))
    raise ValueError(f"no such change: {kind}")


def candidates(examples: Sequence[tuple[str, str]]) -> Iterator[Change]:
    """Changes worth a try for (before, after) examples, the plainer ones first."""
    yield ("trim",)
    yield from (("case", x) for x in ("lower", "upper", "title", "sentence"))
    digits = sum(x.isdigit() for x in examples[0][1])
    yield from (("numberReformat", x) for x in ("us", "eu") if digits)
    yield from (("dateReformat", s, o) for s in DATE_FORMATS for o in ("mdy", "dmy") if digits >= 5)
    yield from (("extractPattern", p) for p in PATTERNS)
    yield from (("splitTake", d, k) for d in (" ", ",", "-", "/", "_", ":", ";", "@", ".", "|") for k in (1, 2, 3, -1, -2))
    yield from ((k, x) for x in CLASSES for k in ("keepClass", "stripClass"))
    before, after = examples[0]
    if before and before in after:
        head, tail = after.split(before, 1)
        yield from ([("addPrefix", head)] if head and not tail else []) + ([("addSuffix", tail)] if tail and not head else [])
        if head and not tail and len(set(head)) == 1:
            yield ("pad", len(after), head[0])
    if after and after in before:
        head, tail = before.split(after, 1)
        yield from ([("removePrefix", head)] if head and not tail else []) + ([("removeSuffix", tail)] if tail and not head else [])
    start = next((k for k, (a, b) in enumerate(zip(before, after, strict=False)) if a != b), min(len(before), len(after)))
    end = next((k for k, (a, b) in enumerate(zip(before[start:][::-1], after[start:][::-1], strict=False)) if a != b), min(len(before), len(after)) - start)
    old = before[start : len(before) - end]
    if old:
        yield ("replaceLiteral", old, after[start : len(after) - end])
    yield ("mapValue", tuple(examples))


def synthesize(spark: SparkSession, examples: Sequence[tuple[str, str]]) -> list[Change]:
    """The changes that turn every example's first text into its second, plainest first; two steps are tried if one is not enough. One job tries all of a kind; a table of the examples comes last."""
    single = list(dict.fromkeys(candidates(examples)))
    df = spark.createDataFrame(list(examples), "before string, after string").coalesce(1)

    def fitting(tried: list[Change]) -> list[Change]:
        fits = [F.min(F.coalesce(apply(x, F.col("before")) == F.col("after"), F.lit(False))).alias(f"x{i}") for i, x in enumerate(tried)]
        return [x for x, ok in zip(tried, df.agg(*fits).first(), strict=True) if ok]

    found = fitting(single[:-1])
    if not found:
        firsts = [("trim",), ("case", "lower"), ("case", "title")]
        found = fitting([("compose", x, y) for x in single[:-1] if x[0] in ("splitTake", "extractPattern", "keepClass") for y in firsts])
    return [*found, single[-1]]
