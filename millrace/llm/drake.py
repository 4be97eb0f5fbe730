"""Centroid clustering in exact whole numbers with Drake's adaptive bounds.

Each vector keeps an upper bound of the distance to its centroid, lower bounds of those to its next nearest ones, and one
bound for all the others. Centroids that move loosen the bounds by as much. A vector whose upper bound stays under all its
lower bounds keeps its centroid unseen; else the distance to its own, then those to the kept ones, then all are computed exactly.
Vectors are packed into blocks of rows. A round is one pass over the blocks that writes them with their bounds and the
sums of their clusters; only the centroids, a number that doesn't grow with the data, come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_staged, stage, table

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Centroids that a vector keeps by name, its own among them; vectors in a block.
NEAREST, ROWS = 3, 2048


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, x): vectors of so many components, none null or non-finite, as floor(scale * component). A null vector or one of another length goes."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.when((F.size(v) == dimensions) & fine, v).alias("v")).where("v is not null")
    return rows.select("id", F.transform("v", lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def seeds(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors of the smallest hashes of their ids, ties by the vectors themselves; fewer if there are fewer. An id that is null hashes as an empty text."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(h, "x").limit(clusters).select("x").collect()
    return np.array([r["x"] for r in first], np.int64).reshape(len(first), -1 if first else 0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row a vector and a column a centroid."""
    if not x.size or not c.size or float(max(np.abs(x).max(), np.abs(c).max())) ** 2 * 4 * x.shape[1] < 2.0**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return np.rint((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], axis=1)


class Bounds:
    """who: each vector's nearest known centroids, its own first; up: at least the distance to its own; low: at most those to who[1:], then to all the rest."""

    def __init__(self, who: np.ndarray, up: np.ndarray, low: np.ndarray):
        self.who, self.up, self.low = who, up, low

    @classmethod
    def fresh(cls, x: np.ndarray, c: np.ndarray, nearest: int) -> Bounds:
        d = squared(x, c)
        by, keep = np.argsort(d, axis=1, kind="stable"), min(nearest, len(c))
        near = np.sqrt(np.take_along_axis(d, by, 1).astype(np.float64))
        rest = near[:, keep : keep + 1] if keep < len(c) else np.full((len(x), 1), np.inf)
        return cls(by[:, :keep].astype(np.int32), near[:, 0].copy(), np.concatenate([near[:, 1:keep], rest], axis=1))

    def moved(self, by: np.ndarray) -> None:
        self.up += by[self.who[:, 0]]
        self.low[:, :-1] -= by[self.who[:, 1:]]
        self.low[:, -1] -= by.max(initial=0.0)

    def open(self, some: np.ndarray) -> np.ndarray:
        """Those of some whose own centroid isn't certainly the only nearest one; the margin covers what sums of square roots lose."""
        return some[self.up[some] * (1 + 1e-9) + 1e-6 >= self.low[some].min(axis=1)]

    def settle(self, x: np.ndarray, c: np.ndarray) -> tuple[int, int]:
        """Exact assignments again; how many vectors had their kept centroids and all centroids computed."""
        left = self.open(np.arange(len(x)))
        near = x[left].astype(np.int64) - c[self.who[left, 0]]
        self.up[left] = np.sqrt((near.astype(np.float64) ** 2).sum(1))
        left = self.open(left)
        d = np.take_along_axis(squared(x[left], c), self.who[left], 1) if len(left) else np.empty((0, self.who.shape[1]), np.int64)
        by = np.lexsort((self.who[left], d), axis=1)
        d, self.who[left] = np.sqrt(np.take_along_axis(d, by, 1).astype(np.float64)), np.take_along_axis(self.who[left], by, 1)
        self.up[left], self.low[left, :-1] = d[:, 0], d[:, 1:]
        far = left[d[:, 0] * (1 + 1e-9) + 1e-6 >= self.low[left, -1]]
        if len(far):
            again = Bounds.fresh(x[far], c, self.who.shape[1])
            self.who[far], self.up[far], self.low[far] = again.who, again.up, again.low
        return len(left), len(far)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows; components take as few bytes as the block's largest one needs."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            ids, x = part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            kind = next(k for k in ("<i2", "<i4", "<i8") if x.size == 0 or np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
            packed = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([kind]), pa.array([x.astype(kind).tobytes()]), *[pa.array([b""])] * 3, pa.array([b""]), pa.array([0]), pa.array([0])]
            yield pa.RecordBatch.from_arrays(packed, names=_BLOCK)


_BLOCK = ["ids", "kind", "x", "who", "up", "low", "sums", "listed", "scanned"]


def _round(c: np.ndarray, by: np.ndarray, nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r].as_py() for n in ("kind", "x", "who", "up", "low")}
                x = np.frombuffer(row["x"], row["kind"]).reshape(-1, c.shape[1]).astype(np.int64)
                if row["who"]:
                    keep = min(nearest, len(c))
                    state = Bounds(np.frombuffer(row["who"], np.int32).reshape(-1, keep).copy(), np.frombuffer(row["up"]).copy(), np.frombuffer(row["low"]).reshape(-1, keep).copy())
                    state.moved(by)
                    listed, scanned = state.settle(x, c)
                else:
                    state, listed, scanned = Bounds.fresh(x, c, nearest), len(x), len(x)
                own = state.who[:, 0]
                sums = np.zeros((len(c), c.shape[1] + 1), np.int64)
                np.add.at(sums[:, 1:], own, x)
                sums[:, 0] = np.bincount(own, minlength=len(c))
                done = [b.column("ids").slice(r, 1), *[pa.array([v]) for v in (row["kind"], row["x"], state.who.tobytes(), state.up.tobytes(), state.low.tobytes(), sums.tobytes(), listed, scanned)]]
                yield pa.RecordBatch.from_arrays(done, names=_BLOCK)

    return run


def _added(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for raw in b.column(0).to_pylist():
                part = np.frombuffer(raw, np.int64)
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)) // width), pa.array(np.arange(len(total)) % width), pa.array(total)], names=["cluster", "place", "value"])

    return run


def _means(blocks: DataFrame, c: np.ndarray) -> np.ndarray:
    """The floored means of the clusters, added up in tasks and then over them; an empty cluster's centroid stays."""
    sums = np.zeros((len(c), c.shape[1] + 1), object)
    parts = blocks.select("sums").mapInArrow(_added(c.shape[1] + 1), "cluster long, place long, value long")
    for r in parts.groupBy("cluster", "place").agg(F.sum("value").alias("value")).collect():
        sums[r["cluster"], r["place"]] = r["value"]
    return np.array([[int(v) // int(s[0]) for v in s[1:]] if s[0] else old.tolist() for s, old in zip(sums, c, strict=True)], np.int64)


def clustered(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, nearest: int = NEAREST, work: list | None = None) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance), centroids): rows (id, x) of whole vectors of one length after so many rounds of nearest centroids and floored means, then assigned once more.

    A row for each row, ids of any type, null and repeated ones too. Equal distances go to the smaller number. Fewer rows than clusters make fewer
    clusters, an empty table no rows. Components times 2 * sqrt(length) must fit in 31 bits for the sums of squares to fit in 64. work, if given, gets
    a (vectors, lists computed, full scans) for each pass.
    """
    c = seeds(rows, clusters, seed)
    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not len(c):
        return rows.sparkSession.createDataFrame([], out), c
    kinds = [T.ArrayType(rows.schema["id"].dataType), T.StringType(), *[T.BinaryType()] * 5, T.LongType(), T.LongType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(_BLOCK, kinds, strict=True)])
    blocks = rows.select("id", "x").mapInArrow(_pack, schema)
    by, before = np.zeros(len(c)), None
    for k in range(rounds + 1):
        blocks = stage(blocks.mapInArrow(_round(c, by, nearest), schema), "drake")
        if work is not None:
            work.append(tuple(blocks.agg(F.sum(F.size("ids")), F.sum("listed"), F.sum("scanned")).first()))
        if before is not None:
            drop_staged(before)
        before = blocks
        if k < rounds:
            fresh = _means(blocks, c)
            by = np.sqrt(((fresh - c).astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)
            c = fresh

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = np.frombuffer(b.column("x")[r].as_py(), b.column("kind")[r].as_py()).reshape(-1, c.shape[1]).astype(np.int64)
                own = np.frombuffer(b.column("who")[r].as_py(), np.int32).reshape(len(x), -1)[:, 0]
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(r, 1).flatten(), pa.array(own), pa.array(((x - c[own]) ** 2).sum(1))], names=["id", "cluster", "distance"])

    return blocks.select("ids", "kind", "x", "who").mapInArrow(unpack, out), c


def summed(members: DataFrame, c: np.ndarray) -> DataFrame:
    """members with cluster_inertia, inertia and centroid_sha256. The clusters' sums, a row each, are collected."""
    per = {r["cluster"]: r["s"] for r in members.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    named = [(k, per.get(k, 0), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for k, v in enumerate(c.tolist())]
    about = members.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, centroid_sha256 string")
    return members.join(about, "cluster").withColumn("inertia", F.lit(sum(per.values())).cast("long"))


def op13_drake(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summed(*clustered(whole(table(spark, sf_dir, "embeddings"))))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds: int = ROUNDS) -> str:
    """The rounds one after another, all distances in each."""

    def near(k: int) -> str:
        d = "CAST(list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT)"
        best = f"SELECT v.vec_id, v.x, min(struct_pack(d := {d}, n := c.n)) AS best FROM v, c{k} c GROUP BY v.vec_id, v.x"
        return f"a{k} AS MATERIALIZED (SELECT vec_id, x, best.n AS n, best.d AS d FROM ({best}))"

    def mean(k: int) -> str:
        s = "CAST(sum(x[i]) AS BIGINT)"
        floored = f"({s} - (({s} % count(*)) + count(*)) % count(*)) // count(*)"
        of = f"SELECT n, list(m ORDER BY i) AS x FROM (SELECT n, i, {floored} AS m FROM a{k}, range(1, 65) t(i) GROUP BY n, i) GROUP BY n"
        return f"c{k + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN ({of}) m USING (n))"

    steps = ", ".join(f"{near(k)}, {mean(k)}" for k in range(rounds))
    fine = "len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64"
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {fine}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS n, x FROM v ORDER BY n LIMIT {CLUSTERS}), {steps}, {near(rounds)}
SELECT vec_id, CAST(a.n AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.n) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.n = c.n
"""


OP13_SQL = _sql()
