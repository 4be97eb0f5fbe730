"""Embedding near-dedup: exact cosine-threshold pairs by dual traversal of cover trees.

Unit vectors with cosine >= c lie within t = sqrt(2 - 2c) of each other. Vectors of a label are one search
space. The top tree level of each label of over CHUNK vectors is a net of pivots drawn from a bounded sample of the label:
each vector joins its nearest pivot and every node keeps its covering radius. Node pairs further apart than both radii plus t are pruned before
any row moves. What survives is compared in units: pairs of bounded chunks of two nodes, so neither a hot
label nor a hot node ever meets in one task. In a unit both chunks get the lower levels, nested nets with
halving radii, and the two trees are walked together: a pair of nodes is pruned by the covering-radius bound,
linked as a whole if the bound says that all its pairs link, or opened up. Equal vectors are collapsed to one
class first. Units return link counts and spanning edges, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, stage, table

COSINE = 0.98
#: Vectors in a chunk of a node, pivots a label, vectors of the sample a label.
CHUNK, PIVOTS, SAMPLE = 1024, 16, 512
RADII = (1.0, 0.5, 0.25, 0.125)


def usable(label: Column, v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tree:
    """Nested nets over unit vectors: each node is a run of `order`, with centre, covering radius and children one level down."""

    def __init__(self, x: np.ndarray):
        self.x, self.order, self.nodes, self.roots = x, np.arange(len(x)), [], []
        self.roots = self._grow(0, len(x), 0)

    def _grow(self, start: int, end: int, level: int) -> list[int]:
        made = []
        while start < end:
            members = self.order[start:end]
            centre = members[0]
            far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.x[members] @ self.x[centre])))
            near = far <= RADII[level]
            near[0] = True
            self.order[start:end] = np.concatenate([members[near], members[~near]])
            stop = start + int(near.sum())
            made.append(len(self.nodes))
            self.nodes.append([centre, float(far[near].max()) + 1e-9, start, stop, []])
            if stop - start > 16 and level + 1 < len(RADII):
                self.nodes[made[-1]][4] = self._grow(start, stop, level + 1)
            start = stop
        return made


def unit_links(a: Tree, b: Tree, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all pairs of a and b with cosine >= the threshold."""
    reach, found = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9, []

    def walk(some: list[int], others: list[int]) -> None:
        p, q = [a.nodes[i] for i in some], [b.nodes[j] for j in others]
        apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a.x[[n[0] for n in p]] @ b.x[[n[0] for n in q]].T)))
        room = np.add.outer([n[1] for n in p], [n[1] for n in q])
        for i, j in zip(*np.nonzero(apart <= room + reach), strict=True):
            m, n = p[i], q[j]
            rows, cols = a.order[m[2] : m[3]], b.order[n[2] : n[3]]
            if apart[i, j] + room[i, j] < reach - 1e-6:
                found.append((np.repeat(rows, len(cols)), np.tile(cols, len(rows))))
            elif m[4] or n[4]:
                walk(m[4] or [some[i]], n[4] or [others[j]])
            else:
                r, c = np.nonzero(a.x[rows] @ b.x[cols].T >= cosine)
                found.append((rows[r], cols[c]))

    walk(a.roots, b.roots)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *[f[0] for f in found]]), np.concatenate([none, *[f[1] for f in found]])


def _lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n vertices reaches over the edges i-j."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        after = low.copy()
        np.minimum.at(after, i, m)
        np.minimum.at(after, j, m)
        np.minimum.at(after, low[i], m)
        np.minimum.at(after, low[j], m)
        after = after[after]
        if (after == low).all():
            return low
        low = after


def _search(cosine: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "node"], kind="stable", ignore_index=True)
        node, mult, x = rows["node"].to_numpy(), rows["mult"].to_numpy(), unit(rows["v"].tolist())
        if not rows["two"].iloc[0]:
            tree = Tree(x)
            i, j = unit_links(tree, tree, cosine)
            i, j = i[i != j], j[i != j]
            n = np.bincount(i, mult[j], len(x))
        else:
            half = int((rows["side"] == 0).sum())
            if not 0 < half < len(x):  # the other chunk came out empty
                return pd.DataFrame({"node": node[:0], "n": np.empty(0, np.int64), "root": node[:0]})
            i, j = unit_links(Tree(x[:half]), Tree(x[half:]), cosine)
            j = j + half
            n = np.bincount(i, mult[j], len(x)) + np.bincount(j, mult[i], len(x))
        low = _lowest(len(x), i, j)
        hit = np.flatnonzero(n)
        return pd.DataFrame({"node": node[hit], "n": n[hit].astype(np.int64), "root": node[low[hit]]})

    return run


def _net(rows: pd.DataFrame) -> pd.DataFrame:
    """The pivots of one label's sample, each with its distances to all of them: the widest nested net of PIVOTS centres or more, its first ones."""
    x = unit(rows.sort_values("node", kind="stable")["v"].tolist()[:SAMPLE])
    for radius in RADII:
        net, open_ = [], np.ones(len(x), bool)
        while open_.any():
            c = int(np.argmax(open_))
            net.append(c)
            open_ &= np.sqrt(np.maximum(0, 2 - 2 * x @ x[c])) > radius
        if len(net) >= PIVOTS:
            break
    p = x[net[:PIVOTS]]
    apart = [np.linalg.norm(p - c, axis=1) for c in p]
    return pd.DataFrame({"label": rows["label"].iloc[0], "dim": rows["dim"].iloc[0], "cell": np.arange(len(p), dtype=np.int32), "pivot": list(p), "apart": apart})


def _pivots(classes: DataFrame) -> DataFrame:
    """(label, dim, cell, pivot, apart, salts) of the labels of over CHUNK vectors, a row a pivot; salts: parts of about 4 CHUNK vectors the label is placed in. A label's sample is drawn by hash, about 2 SAMPLE vectors whatever its size."""
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CHUNK)
    drawn = classes.join(sizes, ["label", "dim"]).where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < F.lit(1 << 20) * (2.0 * SAMPLE) / F.col("size"))
    doubles = T.ArrayType(T.DoubleType())
    kind = T.StructType([classes.schema["label"], classes.schema["dim"], T.StructField("cell", T.IntegerType()), T.StructField("pivot", doubles), T.StructField("apart", doubles)])
    nets = drawn.select("label", "dim", "node", "v").groupBy("label", "dim").applyInPandas(_net, kind)
    salts = sizes.select("label", "dim", F.ceil(F.col("size") / (4 * CHUNK)).cast("int").alias("salts"))
    return stage(nets.join(salts, ["label", "dim"]), "pivots")


def _nearest(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """rows of one part of a label with their nearest pivot (cell) and its distance (far)."""
    if not len(rows):
        return pd.DataFrame({c: [] for c in ("node", "mult", "label", "dim", "v", "cell", "far")})
    pivots = pivots.sort_values("cell")
    cos = unit(rows["v"].tolist()) @ np.stack(pivots["pivot"].tolist()).T
    at = cos.argmax(axis=1)
    return rows[["node", "mult", "label", "dim", "v"]].assign(cell=pivots["cell"].to_numpy()[at], far=np.sqrt(np.maximum(0, 2 - 2 * cos.max(axis=1))))


def _placed(classes: DataFrame, pivots: DataFrame) -> DataFrame:
    """classes with cell and far. Labels without pivots are one cell; the others are dealt out in salted parts, each of which meets the label's pivots."""
    columns = ["node", "mult", "label", "dim", "v"]
    salts = pivots.where("cell = 0").select("label", "dim", "salts")
    kind = T.StructType([*[classes.schema[c] for c in columns], T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
    parts = classes.join(salts, ["label", "dim"]).withColumn("salt", F.pmod(F.xxhash64("v", "node"), F.col("salts")).cast("int")).select(*columns, "salt")
    copies = pivots.select("label", "dim", "cell", "pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    large = parts.groupBy("label", "dim", "salt").cogroup(copies.groupBy("label", "dim", "salt")).applyInPandas(_nearest, kind)
    small = classes.join(salts, ["label", "dim"], "left_anti").select(*columns, F.lit(0).alias("cell"), F.lit(2.0).alias("far"))
    return small.unionByName(large)


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(node, n, root) for classes (node, mult, label, dim, v): n vectors of other classes linked in some unit, root reached there. A node may come more than once."""
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    pivots = _pivots(classes)
    placed = stage(_placed(classes, pivots), "placed")
    cells = placed.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("size"), F.max("far").alias("radius"))
    cells = cells.withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    mine, other = cells.alias("m"), cells.select(F.col("label").alias("l2"), F.col("dim").alias("d2"), F.col("cell").alias("cell2"), F.col("radius").alias("radius2"), F.col("chunks").alias("chunks2"))
    pairs = mine.join(other, (F.col("label") == F.col("l2")) & (F.col("dim") == F.col("d2")))
    pairs = pairs.join(pivots.select("label", "dim", "cell", "apart"), ["label", "dim", "cell"], "left").withColumn("apart", F.get("apart", "cell2"))
    near = pairs.where((F.col("cell") == F.col("cell2")) | (F.coalesce("apart", F.lit(0.0)) <= F.col("radius") + F.col("radius2") + reach + 1e-9))
    near = stage(near.select("label", "dim", "cell", "chunks", "cell2", "chunks2"), "near")
    rows = placed.join(near, ["label", "dim", "cell"])
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("v", "node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("chunk2", F.explode(F.sequence(F.lit(0), F.col("chunks2") - 1)))
    me, it = F.struct("cell", "chunk"), F.struct(F.col("cell2").alias("cell"), F.col("chunk2").alias("chunk"))
    rows = rows.select("label", "dim", F.least(me, it).alias("p"), F.greatest(me, it).alias("q"), (me > it).cast("int").alias("side"), (me != it).alias("two"), "node", "mult", "v")
    node = classes.schema["node"].dataType
    found = T.StructType([T.StructField("node", node), T.StructField("n", T.LongType()), T.StructField("root", node)])
    return rows.groupBy("label", "dim", "p", "q").applyInPandas(_search(cosine), found)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors.

    Rows link if their labels and sizes are equal and their cosine reaches the threshold. Null labels, null or
    zero vectors and vectors with null or non-finite components link with nothing, nor do rows without an id.
    Repeated rows count as different vectors that link; rows sharing an id are one vertex of the components.
    An empty table gives no rows. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    good = usable(F.col("label"), F.col("v")) & F.col("vec_id").isNotNull()
    classes = rows.where(good).groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("mult"))
    classes = stage(classes.withColumn("dim", F.size("v")), "classes")
    found = stage(links(classes, cosine), "links")
    joined = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")).unionByName(_copies(rows.where(good), classes)))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = classes.join(counts, "node", "left").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"))
    linked = rows.where(good).join(named, ["label", "v"]).select("vec_id", "n_links")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    out = linked.unionByName(alone).join(joined.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _copies(good: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges from the members of classes of more than one row to the class's node."""
    return good.join(classes.where("mult > 1").select("label", "v", "node"), ["label", "v"]).select(F.col("vec_id").alias("src"), F.col("node").alias("dst"))


def op5_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT m.vec_id, (SELECT count(*) FROM e WHERE e.a = m.vec_id)::BIGINT AS n_links, m.c AS component_id, m.vec_id = m.c AS kept
FROM (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY a) m
"""
