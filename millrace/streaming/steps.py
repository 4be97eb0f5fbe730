"""Steps on streams: row-local ones run as they are, ordered ones are refused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.frame import Frame


def on_stream(df: DataFrame, *steps: Callable[[Frame], Frame]) -> DataFrame:
    """Apply row-local steps (filters, projections, cell rewrites) to a streaming DataFrame. A stream has no row order, so steps that need one fail when they ask for it."""
    if not df.isStreaming:
        raise ValueError("not a stream")
    f = Frame(df, ())
    for step in steps:
        f = step(f)
        if f.order:
            raise ValueError("a step that orders rows can't run on a stream")
    return f.result()


def windowed(df: DataFrame, ts: str, width: str, late: str, by: list[str], *metrics: Column) -> DataFrame:
    """Metrics by time window and keys with a watermark for late rows."""
    keys = [F.window(ts, width), *[F.col(c) for c in by]]
    out = df.withWatermark(ts, late).groupBy(*keys).agg(*metrics)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *[c for c in out.columns if c not in ("window", *by)])
