"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

The words to take (budget x all words) are shared by weight; a source whose share exceeds `epochs` times
its size is clamped there and the excess goes to the others by weight until none is above. Sorted by
cap / weight, the clamped sources are a prefix, so running sums over the table of sources find the level.
Each document is then taken floor(target / size of source) times, and once more if it comes early enough in
its source's seeded order. Where the order is cut is found from sums over hash buckets, then over buckets of the one that
holds the cut, so only one in 16^6 rows is sorted: no source, however hot, is ever gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

SEED, EPOCHS, BUDGET, WEIGHTS = 42, 3, 1.0, (1, 2, 3)
#: Hexadecimal digits of the order's hash that make a bucket, and a bucket of the bucket that holds the cut.
DIGITS = (3, 6)


def words_in(text: Column) -> Column:
    """Number of runs of anything but space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, budget: float = BUDGET) -> DataFrame:
    """(source, source_size, target) for sizes (source, size). Weights repeat over the sources by code point, null last.

    The windows run over a row for each source, not over documents. Sources without words get target 0.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_code) - 1) % len(weights)
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    src = src.withColumn("cap", F.col("source_size") * epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    src = src.withColumns({"left": F.sum("source_size").over(Window.partitionBy()) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0)), "weights": F.sum("weight").over(after)})
    fits = F.col("left").cast("double") * F.col("weight") <= F.col("cap").cast("double") * F.col("weights")
    src = src.withColumn("level", F.when(fits, F.col("left").cast("double") / F.col("weights")))
    src = src.withColumn("level", F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return src.select("source", "source_size", F.least(target, F.col("cap").cast("double")).alias("target"))


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, budget: float = BUDGET) -> DataFrame:
    """targets() and, for each source, whole (repetitions of all documents) and cut (the last order key taken once more) for sizes (doc_id, source, size, h)."""
    goal = stage(targets(sizes, weights, epochs, budget), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    ours = F.col("source").eqNullSafe(F.col("s"))
    key = goal.withColumnRenamed("source", "s")
    edge = key.where("rest >= 0").select("s", F.lit("").alias("bucket"), F.lit(0).cast("long").alias("before"), "rest")
    for digits in DIGITS:
        inside = sizes.join(edge, ours & F.col("h").startswith(F.col("bucket")))
        sums = inside.groupBy("source", F.substring("h", 1, digits).alias("bucket")).agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("rest").alias("rest"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # 4096 rows a source at most
        sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(run)).where(F.col("upto") > F.col("rest"))
        edge = sums.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "rest"), "bucket").alias("e"))
        edge = stage(edge.select(F.col("source").alias("s"), "e.*"), "edges")
    inside = sizes.join(edge, ours & F.col("h").startswith(F.col("bucket")))
    order = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("mid", F.col("before") + F.sum("size").over(order) - F.col("size") / 2).where(F.col("mid") <= F.col("rest"))
    cuts = inside.groupBy("source").agg(F.max(F.struct("h", "doc_id", "size")).alias("last")).select(F.col("source").alias("s2"), "last")
    joined = key.join(edge.select(F.col("s").alias("s1"), "bucket"), F.col("s").eqNullSafe(F.col("s1")), "left").join(cuts, F.col("s").eqNullSafe(F.col("s2")), "left")
    return stage(joined.select("s", "source_size", "target", "whole", "bucket", "last"), "plan")


def repetitions(sizes: DataFrame, planned: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """sizes with source_size, target and times: how often the mix takes each document."""
    j = sizes.join(planned, F.col("source").eqNullSafe(F.col("s")))
    ours, bucket = F.struct("h", "doc_id", "size"), F.substring("h", 1, DIGITS[-1])
    # No bucket in the plan: the rest is all of the source's words or more, which only rounding can bring about.
    more = F.when(F.col("bucket").isNull(), F.lit(True)).when(bucket != F.col("bucket"), bucket < F.col("bucket")).otherwise(F.coalesce(ours <= F.col("last"), F.lit(False)))
    times = F.least(F.col("whole") + F.when(more, 1).otherwise(0), F.lit(epochs))
    return j.withColumn("times", F.when(F.col("size") > 0, times).otherwise(F.lit(0)).cast("long")).drop("s", "whole", "bucket", "last")


def sized(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Column | None = None) -> DataFrame:
    carried = [] if carry is None else [carry.alias("row")]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), seeded(F.col(id_col), seed).alias("h"), *carried)


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, budget: float = BUDGET) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each row of docs; taken is the words the mix takes of it.

    A null text has no words and a null source is a source of its own. Rows with the same id, size and source
    are taken alike. The order within a source depends on seed and id only, so reruns agree. An empty table
    gives no rows; if no document has words, every target is 0. Other columns of docs are not read.
    """
    sizes = stage(sized(docs, seed), "sizes")
    found = repetitions(sizes, plan(sizes, weights, epochs, budget), epochs)
    return found.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all columns of docs. Documents without words are never taken."""
    sizes = stage(sized(docs, seed), "sizes")
    rows = repetitions(sized(docs, seed, carry=F.struct(*[F.col(f"`{c}`") for c in docs.columns])), plan(sizes))
    return rows.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sizes GROUP BY source),
fill AS (
  SELECT 0 AS i, s.source, s.source_size, s.weight, false AS clamped, 0::DOUBLE AS target FROM src s
  UNION ALL
  SELECT i + 1, source, source_size, weight,
         clamped OR level * weight > 3 * source_size,
         CASE WHEN clamped OR level * weight > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE level * weight END
  FROM (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (clamped) OVER (), 0))::DOUBLE
                  / sum(weight) FILTER (NOT clamped) OVER () AS level FROM fill WHERE i < 60)),
goal AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM fill WHERE i = 60),
ordered AS (
  SELECT s.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS rest,
         sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 AS mid
  FROM sizes s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE size * (whole + CASE WHEN mid <= rest THEN 1 ELSE 0 END) END::BIGINT AS taken
FROM ordered
"""
