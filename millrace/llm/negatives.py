"""Hard negatives by a block matrix product on a grid of tasks.

Rows are sorted by label and packed into blocks, and each block is cut into chunks of dimensions. Anchors' blocks and rows' blocks meet
on a grid: each goes to a line of it, whose cells multiply their chunks into partial tiles of 64-bit whole numbers. A shuffle on
the tile adds the chunks' parts up, and the same task reduces the tile: to the first positives of each anchor, and in a second pass
to the first negatives of each anchor's windows. A tile whose rows all have the anchors' label is made in the first pass only, and one
without that label in the second only. Tiles are of bounded size, whatever a label's; what leaves one is a few rows an anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage, table

#: Anchors and rows in a block, dimensions in a chunk, blocks to a line of the grid.
ANCHORS, ROWS, CHUNK, LINE = 256, 1024, 32, 4
POSITIVES, NEGATIVES, SCALE = 5, 5, 256
#: A negative's score is from LOW to HIGH hundredths of its positive's.
LOW, HIGH = 80, 100


def whole(vectors: DataFrame, id_col: str = "vec_id", label: Column | str = "label", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, label, x): rows with an id, a label and a vector without null or non-finite components, as floor(scale * component)."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).alias("label"), F.when(fine, v).alias("v"))
    return rows.where("id is not null and label is not null and v is not null").select("id", "label", F.transform("v", lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def _pack(rows: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                ids, labels, lists = part.columns
                size = np.diff(lists.offsets.to_numpy())
                width = max(1, int(size.max()))
                x = np.zeros((part.num_rows, -(-width // chunk) * chunk), np.int64)  # a shorter vector goes on with zeros
                x[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy(zero_copy_only=False)
                for k in range(x.shape[1] // chunk):
                    one = [pa.array([block]), pa.array([k]), labels.slice(0, 1), labels.slice(len(labels) - 1, 1)]
                    one += [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) if k == 0 else pa.nulls(1, pa.list_(c.type)) for c in (ids, labels)]
                    yield pa.RecordBatch.from_arrays([*one, pa.array([x[:, k * chunk : (k + 1) * chunk].tobytes()])], names=_NAMES)
                block += 1

    return run


_NAMES = ["block", "chunk", "least", "most", "ids", "labels", "x"]


def blocks_of(rows: DataFrame, size: int, chunk: int = CHUNK) -> DataFrame:
    """(block, chunk, least, most, ids, labels, x): runs of rows in the order of labels, with their least and most label; ids and labels go with chunk 0 alone."""
    kind = rows.schema["label"].dataType
    kinds = [T.LongType(), T.LongType(), kind, kind, T.ArrayType(T.LongType()), T.ArrayType(kind), T.BinaryType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(_NAMES, kinds, strict=True)])
    return stage(rows.repartitionByRange("label", "id").sortWithinPartitions("label", "id").mapInArrow(_pack(size, chunk), schema), "blocks")


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            one = b.slice(r, 1)
            x, y = (np.frombuffer(one.column(n)[0].as_py(), np.int64).reshape(len_, -1) for n, len_ in (("x", one.column("n")[0].as_py()), ("y", one.column("m")[0].as_py())))
            small = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1] < 2.0**53
            tile = (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64) if small else x @ y.T
            yield pa.RecordBatch.from_arrays([*[one.column(n) for n in _TILE[:-1]], pa.array([tile.tobytes()])], names=_TILE)


_TILE = ["a_block", "b_block", "anchors", "a_labels", "tops", "ids", "labels", "tile"]


def tiles(anchors: DataFrame, rows: DataFrame, wanted: Column, reduce: Callable[[dict, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """reduce(row, scores) over the tiles of anchors' and rows' blocks for which wanted holds of a.least, a.most, b.least and b.most."""
    lines = [max(1, -(-x.select("block").distinct().count() // LINE)) for x in (anchors, rows)]
    at = lambda block, n: F.pmod(F.xxhash64(block), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = anchors.select(F.col("block").alias("a_block"), "chunk", "least", "most", F.col("ids").alias("anchors"), F.col("labels").alias("a_labels"), "tops", "n", "x", at("block", lines[0]).alias("i"), every(lines[1]).alias("j"))
    b = rows.select(F.col("block").alias("b_block"), "chunk", "least", "most", "ids", "labels", F.col("n").alias("m"), F.col("x").alias("y"), every(lines[0]).alias("i"), at("block", lines[1]).alias("j"))
    met = a.alias("a").join(b.alias("b"), (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j")) & (F.col("a.chunk") == F.col("b.chunk")) & wanted)
    met = met.select("a_block", "b_block", "anchors", "a_labels", "tops", "ids", "labels", "n", "m", "x", "y")
    kinds = {f.name: f.dataType for f in met.schema}
    parts = met.mapInArrow(_partial, T.StructType([T.StructField(n, kinds.get(n, T.BinaryType())) for n in _TILE]))

    def add(parts: pa.Table) -> pa.Table:
        first = next(r for r in parts.select(_TILE[2:-1]).to_pylist() if r["anchors"] is not None)
        total = sum(np.frombuffer(t.as_py(), np.int64) for t in parts["tile"])
        return reduce(first, total.reshape(len(first["anchors"]), len(first["ids"])))

    return parts.groupBy("a_block", "b_block").applyInArrow(add, schema)


def _different(row: dict) -> np.ndarray:
    a, b = (np.array(row[n], dtype=None if isinstance(row[n][0], int) else object) for n in ("a_labels", "labels"))
    return a[:, None] != b[None, :]


_POSITIVE = "anchor_id long, id long, score long"
_NEGATIVE = "anchor_id long, top long, id long, score long"


def _first_positives(count: int):
    def reduce(row: dict, scores: np.ndarray) -> pa.Table:
        ids, anchors, out = np.array(row["ids"]), np.array(row["anchors"]), []
        other = _different(row) | (anchors[:, None] == ids)
        for i, anchor in enumerate(anchors.tolist()):
            some = np.flatnonzero(~other[i])
            for j in some[np.lexsort((ids[some], -scores[i, some]))[:count]].tolist():
                out.append((anchor, int(ids[j]), int(scores[i, j])))
        columns = zip(*out, strict=True) if out else [[]] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "id", "score"])

    return reduce


def _first_negatives(count: int, low: int, high: int):
    def reduce(row: dict, scores: np.ndarray) -> pa.Table:
        ids, out = np.array(row["ids"]), []
        fits = _different(row)
        for i, (anchor, tops) in enumerate(zip(row["anchors"], row["tops"], strict=True)):
            if not tops:
                continue
            some = np.flatnonzero(fits[i])
            some = some[np.lexsort((ids[some], -scores[i, some]))]
            s = scores[i, some]
            for top in tops:
                inside = some[(s >= -(-low * top // 100)) & (s <= min(high * top // 100, 2**63 - 1))][:count]
                out += [(anchor, top, int(ids[j]), int(scores[i, j])) for j in inside.tolist()]
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "top", "id", "score"])

    return reduce


def _best(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    by = W.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= count)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows and anchors (id, label, x).

    A score is the whole inner product with the anchor, a shorter vector going on with zeros; it must fit in 64 bits. Positives are the
    first rows of the anchor's label with another id, negatives the first rows of another label whose score is from low to
    high hundredths of the positive's; higher scores first, ties by smaller id. An anchor without positives, and a positive
    without negatives, has no row. Rows of one id count once, as the one of the least label and vector. Empty tables give no rows.
    """
    least = lambda df: df.groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x")
    b = blocks_of(least(rows), ROWS, chunk)
    a = blocks_of(least(anchors), ANCHORS, chunk)
    sizes = lambda df: df.join(df.where("chunk = 0").select("block", F.size("ids").alias("n")), "block")
    a, b = sizes(a), sizes(b)
    none = F.lit(None).cast("array<array<bigint>>").alias("tops")
    meet = (F.col("a.least") <= F.col("b.most")) & (F.col("b.least") <= F.col("a.most"))
    found = tiles(a.select("*", none), b, meet, _first_positives(positives), _POSITIVE)
    best = stage(_best(found, ["anchor_id"], positives).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    tops = best.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("t"))
    each = a.where("chunk = 0").select("block", F.posexplode("ids").alias("at", "anchor_id")).join(tops, "anchor_id", "left")
    of_block = each.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("t", F.array().cast("array<bigint>")).alias("t")))).alias("e")).select("block", F.col("e.t").alias("tops"))
    windowed = a.join(of_block, "block").withColumn("tops", F.when(F.col("chunk") == 0, F.col("tops")))
    alike = (F.col("a.least") == F.col("a.most")) & (F.col("b.least") == F.col("b.most")) & (F.col("a.least") == F.col("b.least"))
    found = tiles(windowed, b, ~alike, _first_negatives(negatives, low, high), _NEGATIVE)
    last = _best(found, ["anchor_id", "top"], negatives)
    out = best.join(last, (best["anchor_id"] == last["anchor_id"]) & (best["positive_score"] == last["top"]))
    return out.select(best["anchor_id"], "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = whole(table(spark, sf_dir, "embeddings"), label=label)
    return hard_negatives(rows, rows.where("id % 100 = 0"))


OP11_SQL = f"""
WITH r AS MATERIALIZED (
    SELECT DISTINCT ON (vec_id) * FROM (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor({SCALE} * CAST(e AS DOUBLE))) AS x
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)
    ORDER BY vec_id, label, x),
s AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
    FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}
"""
