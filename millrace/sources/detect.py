"""Which format lines of text are in, by one aggregation over a bounded head of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.ordering import terms
from millrace.functions.values import strip
from millrace.operators.frame import Frame

from .readers import _ACCESS, _STAMP

#: Lines that are looked at.
HEAD = 2000


def shares(f: Frame) -> dict[str, float]:
    """Format -> share of the non-blank lines that have its shape."""
    line = F.col("line")
    shapes: dict[str, Column] = {
        "ndjson": F.try_parse_json(line).isNotNull() & line.rlike(r"^\s*[{\[]"),
        "prefixed-json": line.rlike(r"^[^{]+\{.*\}\s*$") & F.try_parse_json(F.regexp_extract(line, r"(\{.*\})\s*$", 1)).isNotNull(),
        "access-log": line.rlike(_ACCESS),
        "log-lines": line.rlike(_STAMP),
        "logfmt": line.rlike(r"^(?:[^=]*\s)?[\w.\-]+=\S+(?:.*\s[\w.\-]+=)"),
        "markdown-table": line.rlike(r"^\s*\|.*\|\s*$"),
        "box-table": line.rlike(r"^\s*\+[-+]+\+\s*$|^\s*\|.*\|\s*$"),
        "key-value-blocks": line.rlike(r"^\s*[\w .\-]{1,40}?\s*[:=]\s+\S"),
        "list": line.rlike(r"^\s*(?:[-*•–]|\d+[.)])\s+\S"),
        "whitespace-runs": line.rlike(r"\S(?:\t+| {2,})\S"),
    }
    head = f.df.orderBy(*terms(f.order)).limit(HEAD).where(strip(line) != "")
    counts = {d: F.size(F.split(F.regexp_replace(line, r'"[^"]*"', ""), "\\Q" + d + "\\E")) for d in (",", "\t", ";", "|")}
    seen = head.agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(x, F.lit(False)).cast("int")).alias(f"s{i}") for i, x in enumerate(shapes.values())],
        *[F.mode(x).alias(f"m{i}") for i, x in enumerate(counts.values())], *[F.collect_list(x).alias(f"c{i}") for i, x in enumerate(counts.values())], F.max(line.rlike(r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$").cast("int")).alias("rule"),
    ).first()
    n = seen["n"] or 1
    out = {k: (seen[f"s{i}"] or 0) / n for i, k in enumerate(shapes)}
    if not seen["rule"]:
        out["markdown-table"] = 0.0
    for i, d in enumerate(counts):
        mode = seen[f"m{i}"] or 1
        out[f"delimited {d!r}"] = sum(c == mode for c in seen[f"c{i}"]) / n if mode > 1 else 0.0
    return out


#: How sure a format is when all its lines fit, and the share of fitting lines it needs.
SURE = {"ndjson": 0.97, "access-log": 0.95, "markdown-table": 0.95, "box-table": 0.94, "prefixed-json": 0.9, "log-lines": 0.88, "logfmt": 0.85, "key-value-blocks": 0.95, "whitespace-runs": 0.9, "list": 0.7}
NEEDED = {"key-value-blocks": 0.6, "whitespace-runs": 0.8}


def ranked(f: Frame) -> list[tuple[str, float]]:
    """Formats with a confidence from 0.05 to 0.99, the likeliest first; plain lines come with 0.3."""
    out = [("lines", 0.3)]
    for kind, share in shares(f).items():
        if kind.startswith("delimited"):
            if share > 0:
                out.append((kind, 0.5 + 0.45 * share - (0.2 if "|" in kind else 0)))
        elif share >= NEEDED.get(kind, 0.7):
            out.append((kind, SURE[kind] * (0.5 + 0.5 * share)))
    return sorted(((k, round(min(0.99, max(0.05, c)), 3)) for k, c in out), key=lambda x: -x[1])
