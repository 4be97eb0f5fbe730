"""SimHash near-dedup by anchor-point covering.

Every text gets a 64-bit SimHash of its word shingles. The anchors are the codewords of a product of
perfect binary codes laid over blocks of the fingerprint: two [23,12] Golay codes (covering radius 3) by
default, so every fingerprint has exactly one home anchor, which is within the covering radius in each
block. Two fingerprints that differ in at most t bits differ in e1 + e2 <= t bits over the two blocks, so
the second lies within radius + e1 and radius + e2 of the first one's home anchor: copying each distinct
fingerprint to every such anchor and comparing it with the fingerprints at home there finds every pair.
With t = 2 that is about 61 copies a fingerprint over 2^24 anchors, growing in proportion to the distinct fingerprints.
Equal fingerprints are collapsed before the search, so groups of copies cost one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, kept, lower_ascii, small_batches, stage, table

SHINGLE, SEED, BITS = 3, 42, 2
#: Start bit and length of the blocks that the codes cover; the other bits take part only in the comparison.
BLOCKS = ((0, 23), (23, 23))
#: Generator polynomial of the [23,12] Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of a text: a bit is set if it is set in over half of the shingles' XXH64. None or no words: 0."""
    if text is None:
        return 0
    words = lower_ascii(text).encode("utf-8", "surrogatepass").split()  # bytes: splits on 0x20 and 0x09-0x0D only
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    n = len(words) - k + 1
    ends = [*np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist(), len(joined)]
    starts = [0, *[e + 1 for e in ends[: n - 1]]]
    digest = xxhash.xxh64_digest
    set_in = np.zeros(64, np.int64)
    for i in range(0, n, 25500):  # bounded memory however long the text
        some = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[i : i + 25500], ends[i + k - 1 : i + k + 25499], strict=False)])
        bits = np.unpackbits(np.frombuffer(some, np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255  # 255 rows still fit a byte
        set_in += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        set_in += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * set_in > n).tobytes(), "big")


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """Column of signed 64-bit fingerprints (never null)."""

    @F.pandas_udf(T.LongType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept("simhash", lambda: None)  # lets go of an earlier operator's model
        for texts in batches:
            yield pd.Series(np.array([simhash(t, shingle, seed) for t in texts], dtype=np.uint64).astype(np.int64))

    return of(text)


def _remainder(x: np.ndarray) -> np.ndarray:
    for bit in range(22, 10, -1):
        x = np.where(x >> bit & 1, x ^ (GOLAY << (bit - 11)), x)
    return x


@lru_cache(1)
def golay_errors() -> tuple[np.ndarray, np.ndarray]:
    """For each 11-bit remainder, the errors of weight up to 5 that have it: (errors, weight beyond the radius), the one of weight <= 3 first; unused places cost 9."""
    flips = [0]
    for _ in range(5):
        flips = sorted({e | 1 << i for e in flips for i in range(23)} | set(flips))
    word = np.array(flips, dtype=np.int64)
    beyond = np.maximum(np.bitwise_count(word).astype(np.int64) - 3, 0)
    rest = _remainder(word)
    by = np.lexsort((beyond, rest))
    counts = np.bincount(rest, minlength=2048)
    place = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)
    errors, cost = np.zeros((2048, counts.max()), np.int64), np.full((2048, counts.max()), 9)
    errors[rest[by], place], cost[rest[by], place] = word[by], beyond[by]
    return errors, cost


def anchors_of(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fps, anchor, is it home): every anchor within radius + e1, radius + e2 of a fingerprint with e1 + e2 <= bits."""
    errors, cost = golay_errors()
    anchors, costs = [], []
    for start, size in BLOCKS:
        x = fps.astype(np.uint64) >> np.uint64(start)
        x = (x & np.uint64((1 << size) - 1)).astype(np.int64)
        rest = _remainder(x)
        anchors.append(x[:, None] ^ errors[rest])
        costs.append(cost[rest])
    total = costs[0][:, :, None] + costs[1][:, None, :]
    i, a, b = np.nonzero(total <= bits)
    return i, anchors[0][i, a] << 23 | anchors[1][i, b], total[i, a, b] == 0


_COPIES = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("home", T.BooleanType())])


def replicate(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(anchor, fp, home): each fingerprint of column fp at its home anchor and at every other one it has to be looked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(values), 1024):
                part = values[k : k + 1024]
                i, anchor, home = anchors_of(part.view(np.uint64), bits)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[i]), pa.array(home)], names=_COPIES.names)

    return fps.select("fp").mapInArrow(run, _COPIES)


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(src, dst), each pair of distinct fingerprints that differ in 1 to bits bits, src < dst, perhaps more than once."""
    if not 0 <= bits <= 2:
        raise ValueError("the Golay anchors serve thresholds of 0 to 2 bits")
    copies = stage(replicate(fps, bits), "anchors")
    home = copies.where("home").select("anchor", F.col("fp").alias("src"))
    apart = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= bits
    pairs = home.join(copies.select("anchor", F.col("fp").alias("dst")), "anchor").where(F.col("src") != F.col("dst")).where(apart)
    return pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of docs.

    Null, empty or wordless texts have fingerprint 0 and link like any other. component_id is the smallest
    id reachable by links; ids that are null are rows of their own component's smallest id if that has one.
    Repeated rows stay repeated. An empty table gives no rows. Other columns of docs are not read.
    """
    small_batches(docs.sparkSession)
    marked = stage(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle, seed).alias("fp")), "simhash")
    classes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    joined = connected_components(links(classes, bits))
    named = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    lows = named.groupBy("group").agg(F.min("least").alias("component_id"))
    of_class = stage(named.join(lows, "group").select("fp", "component_id"), "classes")
    return marked.join(of_class, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component, one row for an id; all columns of docs stay.

    Rows without an id can't stand for a group and are kept as they are.
    """
    found = near_duplicates(docs, id_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    rest = docs.where(F.col(id_col).isNotNull())
    kept = rest.join(found, rest[id_col] == found["__kept"], "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
