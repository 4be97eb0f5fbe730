"""Helpers the operators share: connected components, batches of rows; staging is the library's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.staging import drop_staged, new_path, shared_dir, stage  # noqa: F401

#: Rows to a Python batch. Texts may be long, so batches are kept far below Spark's 10,000 rows.
BATCH_ROWS = 256
#: And bytes to one, so that a batch of very long texts is closed early.
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts small, whatever the session had before, if it had more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


_slot: dict = {}


def kept(key, make: Callable[[], object]):
    """make()'s result, kept in the worker process for its next tasks; only the latest key's, so that a process that has served several operators holds one model."""
    if key not in _slot:
        _slot.clear()
        _slot[key] = make()
    return _slot[key]


def groups(texts: list[str | None], chars: int = 400_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about so many characters together, a longer text alone: bounded memory for work on whole runs."""
    start = total = 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if k > start and total + n > chars:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


_AZ = {65 + i: 97 + i for i in range(26)}


def lower_ascii(s: str) -> str:
    """Lower-case A-Z only."""
    return s.lower() if s.isascii() else s.translate(_AZ)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (src, dst), component being its smallest reachable node.

    Alternates large-star and small-star steps; each step is two shuffles over the edges, staged in the
    shared folder, and the number of steps grows with the logarithm of a component's diameter. Nulls and
    loops are dropped; no edges give no rows.
    """

    def star(e: DataFrame) -> DataFrame:
        near = e.groupBy("u").agg(F.min("v").alias("lo")).select("u", F.least("u", "lo").alias("m"))
        return e.join(near, "u")

    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = stage(e, "edges")
    seen = signature(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = star(large).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        after = stage(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "edges")
        now = signature(after)
        drop_staged(e)
        e = after
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
