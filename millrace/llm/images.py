"""Local image descriptors: find cropped or edited copies by matched corners.

Corners are all local maxima of the Harris response over a threshold, at several scales. Each gets an orientation from the intensity
centroid of its disc and 128 binary tests of the smoothed patch, turned by it. The descriptor's three bands of 43, 43
and 42 bits are the tags of three Hamming tables, which are joined on the tag. Bucket mates vote for the turn and zoom that would
lay one image on the other. Every pair of images with VOTES votes for one is verified: all their
descriptors are compared, those nearest to each other and within DISTANCE bits give a turn, a zoom and a shift each,
and the pair links if INLIERS corners agree on one.

Images with equal pixels are one class from the start and have one row in the tables. Large groups are gathered
first, in rounds that cost a row an entry: each entry votes with its bucket's centre, and each class is verified against the
mate it has most votes with. Then every pair of entries of different classes in a bucket votes, however full the bucket is, so that nothing
that shares VOTES tags goes unverified. Most of these pairs are of unlike images with one vote, so they never become rows: images are dealt
out in blocks, a task has two of them, and only pairs of images with VOTES votes leave it. Comparing remains quadratic in full buckets of
different classes; memory is bounded by two blocks, and an entry goes only to blocks that have its tag.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, drop_staged, small_batches, stage, table

#: BLOCK bounds the memory of describing: so many corners are tested at a time.
SCALES, RADIUS, TESTS, BLOCK = (1.0, 0.75, 0.5), 16, 128, 4096
DISTANCE, INLIERS, SHIFT_BIN, TURN_BINS = 16, 6, 12.0, 12
#: Votes that make a pair of images a candidate, and pairs of different classes an entry, above which gathering goes on longer.
VOTES, PAIRS = 2, 2
#: Blocks of images at least, entries that a block has on average at most, and pairs of entries that vote at a time.
BLOCKS, ENTRIES, MEETINGS = 8, 1 << 20, 1 << 20


@lru_cache(1)
def _pattern() -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the disc for the centroid, and the (TESTS, 2, 2) point pairs of the tests."""
    y, x = np.mgrid[-6:7, -6:7]
    disc = np.stack([x[x * x + y * y <= 36], y[x * x + y * y <= 36]], axis=1)
    pairs = np.random.default_rng(5).uniform(-RADIUS / 2**0.5, RADIUS / 2**0.5, (TESTS, 2, 2))  # turned, they stay within RADIUS
    return disc, pairs


def _blur(a: np.ndarray, r: int) -> np.ndarray:
    p = np.pad(a, ((r, r), (r, r)), mode="edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    k = 2 * r + 1
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)


def _scaled(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return a
    h, w = max(1, round(a.shape[0] * scale)), max(1, round(a.shape[1] * scale))
    y, x = np.linspace(0, a.shape[0] - 1, h), np.linspace(0, a.shape[1] - 1, w)
    y0, x0 = np.minimum(y.astype(int), max(0, a.shape[0] - 2)), np.minimum(x.astype(int), max(0, a.shape[1] - 2))
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    return (a[np.ix_(y0, x0)] * (1 - fx) + a[np.ix_(y0, x1)] * fx) * (1 - fy) + (a[np.ix_(y1, x0)] * (1 - fx) + a[np.ix_(y1, x1)] * fx) * fy


def corners(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of all local maxima of the Harris response over its threshold, row by row; their number grows with the area, so that a crop keeps its share."""
    if min(a.shape) < 8:
        return np.empty(0, int), np.empty(0, int)
    gy, gx = np.gradient(a)
    xx, yy, xy = _blur(gx * gx, 2), _blur(gy * gy, 2), _blur(gx * gy, 2)
    r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    peak = np.pad(r, 2, constant_values=-np.inf)
    for axis in (0, 1):  # the 5 x 5 maximum, one direction after the other
        n = peak.shape[axis] - 4
        peak = np.maximum.reduce([peak.take(range(k, k + n), axis) for k in range(5)])
    y, x = np.nonzero((r >= peak) & (r > max(1e-6, 0.01 * r.max())))
    inside = (x > 2) & (y > 2) & (x < a.shape[1] - 3) & (y < a.shape[0] - 3)
    return x[inside], y[inside]


def describe(pixels: np.ndarray) -> np.ndarray:
    """Descriptors of a grey image, a row each: place, and the tests as two 64-bit halves. A place packs x and y in quarter pixels (16 bits each), the scale's number (8) and the turn in degrees (12)."""
    disc, pairs = _pattern()
    out = [np.empty((0, 3), np.int64)]
    for n, scale in enumerate(SCALES):
        a = _scaled(pixels.astype(float), scale)
        all_x, all_y = corners(a)
        if not len(all_x):
            continue
        smooth, pad = np.pad(_blur(a, 2), 2 * RADIUS, mode="edge"), 2 * RADIUS
        for k in range(0, len(all_x), BLOCK):
            x, y = all_x[k : k + BLOCK], all_y[k : k + BLOCK]
            near = smooth[y[:, None] + disc[:, 1] + pad, x[:, None] + disc[:, 0] + pad]
            turn = np.arctan2(near @ disc[:, 1], near @ disc[:, 0])
            c, s = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
            px = np.rint(c * pairs[None, :, :, 0] - s * pairs[None, :, :, 1]).astype(int) + x[:, None, None] + pad
            py = np.rint(s * pairs[None, :, :, 0] + c * pairs[None, :, :, 1]).astype(int) + y[:, None, None] + pad
            v = smooth[py, px]
            bits = np.packbits(v[:, :, 0] < v[:, :, 1], axis=1).view(">i8").astype(np.int64)
            quarter = [np.minimum(np.rint(4 * z / scale).astype(np.int64), 65535) for z in (x, y)]
            place = quarter[0] << 36 | quarter[1] << 20 | n << 12 | np.rint(np.degrees(turn)).astype(np.int64) % 360
            out.append(np.column_stack([place, bits]))
    return np.concatenate(out)


POINTS = ("place", "d0", "d1")
_POINTS = T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in POINTS])


def described(width: Column, pixels: Column) -> Column:
    """Column of the descriptors of grey images given by width and bytes, as three arrays; none for null, empty or ragged ones."""

    @F.pandas_udf(_POINTS)
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for widths, images in batches:
            found = []
            for w, p in zip(widths, images, strict=True):
                fine = p is not None and w == w and w and len(p) and len(p) % int(w) == 0
                found.append(describe(np.frombuffer(p, np.uint8).reshape(-1, int(w))) if fine else np.empty((0, 3), np.int64))
            yield pd.DataFrame({n: [x[:, i] for x in found] for i, n in enumerate(POINTS)})

    return of(width, pixels)


def _bits(place: np.ndarray, low: int, bits: int) -> np.ndarray:
    return place >> low & (1 << bits) - 1


def agree(a: list[np.ndarray], b: list[np.ndarray]) -> bool:
    """Whether INLIERS corners of one image (places and test halves) agree with the other on one geometry. A corner is matched with the one it is nearest to, if that is so both ways."""
    if min(len(a[0]), len(b[0])) < INLIERS:
        return False
    nearest, least, of = np.zeros(len(a[0]), int), np.full(len(b[0]), 999, np.int16), np.zeros(len(b[0]), int)
    for k in range(0, len(a[0]), 512):
        far = sum(np.bitwise_count(x[k : k + 512, None] ^ y[None, :]).astype(np.int16) for x, y in zip(a[1:], b[1:], strict=True))
        nearest[k : k + 512] = far.argmin(axis=1)
        better = far.min(axis=0) < least
        least[better], of[better] = far.min(axis=0)[better], far.argmin(axis=0)[better] + k
    j = np.flatnonzero((least <= DISTANCE) & (nearest[of] == np.arange(len(of))))
    if len(j) < INLIERS:
        return False
    p, q = a[0][of[j]], b[0][j]
    octave = np.log2(np.array(SCALES))
    zoom = np.rint(2 * (octave[_bits(q, 12, 8)] - octave[_bits(p, 12, 8)])).astype(int)
    turn = np.rint((_bits(q, 0, 12) - _bits(p, 0, 12)) % 360 * TURN_BINS / 360).astype(int) % TURN_BINS
    angle, size = turn * 2 * np.pi / TURN_BINS, 2.0 ** (-zoom / 2)
    x, y = _bits(p, 36, 16) / 4, _bits(p, 20, 16) / 4
    dx = _bits(q, 36, 16) / 4 - size * (np.cos(angle) * x - np.sin(angle) * y)
    dy = _bits(q, 20, 16) / 4 - size * (np.sin(angle) * x + np.cos(angle) * y)
    for half in (0.0, 0.5):  # two grids, so that a cluster on a border of one is whole in the other
        cells = np.column_stack([zoom, turn, np.floor(dx / SHIFT_BIN + half), np.floor(dy / SHIFT_BIN + half), _bits(q, 36, 16) // 32, _bits(q, 20, 16) // 32])
        cells = np.unique(cells.astype(np.int64), axis=0)[:, :4]  # a spot of 8 pixels counts once, at whatever scales
        if np.unique(cells, axis=0, return_counts=True)[1].max() >= INLIERS:
            return True
    return False


@F.pandas_udf(T.BooleanType())
def _agree(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for columns in batches:
        yield pd.Series([agree(list(x[:3]), list(x[3:])) for x in zip(*columns, strict=True)], dtype=bool)


def _bands() -> list[Column]:
    """The descriptor's bands, of 43, 43 and 42 bits."""
    d0, d1 = F.col("d0"), F.col("d1")
    middle = F.shiftrightunsigned(d0, 43).bitwiseOR(F.shiftleft(d1.bitwiseAND((1 << 22) - 1), 21))
    return [d0.bitwiseAND((1 << 43) - 1), middle, F.shiftrightunsigned(d1, 22)]


def _tag(band: int) -> Column:
    return F.xxhash64(F.lit(band), _bands()[band])


def _exploded(single: DataFrame) -> DataFrame:
    return single.select("node", F.explode(F.arrays_zip(*POINTS)).alias("it")).select("node", "it.place", "it.d0", "it.d1")


def _shared(entries: DataFrame) -> DataFrame:
    """Entries (tag, node, …) whose tag several nodes have. Tags are counted by their last 31 bits, which may keep a few more."""
    short = F.col("tag").bitwiseAND(0x7FFFFFFF).cast("int")
    seen = entries.groupBy(short.alias("short")).agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("short")
    return entries.withColumn("short", short).join(seen, "short", "left_semi").drop("short")


def _voted(pairs: DataFrame) -> DataFrame:
    """(src, dst, n): pairs of images with n >= VOTES corners of dst that vote for one turn and zoom, for pairs of entries (src, dst, p, q), p and q being places."""
    part = lambda c, low, bits: F.shiftright(c, low).bitwiseAND((1 << bits) - 1)
    turn = F.pmod(F.round(F.pmod(part("q", 0, 12) - part("p", 0, 12), F.lit(360)) * TURN_BINS / 360), F.lit(TURN_BINS)).cast("int")
    octave = F.array(*[F.lit(float(np.log2(s))) for s in SCALES])
    zoom = F.round((F.get(octave, part("q", 12, 8).cast("int")) - F.get(octave, part("p", 12, 8).cast("int"))) * 2).cast("int")
    # One long holds the corner and its bin. All counts are of pairs, so the rows move once, by pair.
    vote = F.shiftleft("q", 8).bitwiseOR((turn + TURN_BINS * (zoom + 2)).cast("long")).alias("vote")
    votes = pairs.select("src", "dst", vote).repartition("src", "dst").distinct().groupBy("src", "dst", F.col("vote").bitwiseAND(255).alias("bin"))
    return votes.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= VOTES).groupBy("src", "dst").agg(F.max("n").alias("n"))


def _verified(pairs: DataFrame, single: DataFrame) -> DataFrame:
    """pairs (src, dst, …) with column linked: whether the images' corners agree on a geometry."""
    side = lambda s, id_: single.select(F.col("node").alias(id_), *[F.col(n).alias(f"{s}_{n}") for n in POINTS])
    both = pairs.join(side("a", "src"), "src").join(side("b", "dst"), "dst")
    return both.select(*pairs.columns, _agree(*[f"{s}_{n}" for s in "ab" for n in POINTS]).alias("linked"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (node, …) with class."""
    return rows.join(labels, "node", "left").withColumn("class", F.coalesce("class", "node"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, class) after the classes that links (src, dst) name are joined."""
    found = connected_components(links).withColumnRenamed("component", "now")
    moved = labels.join(found.withColumnRenamed("node", "class"), "class", "left").select("node", F.coalesce("now", "class").alias("class"))
    fresh = found.join(labels, "node", "left_anti").select("node", F.col("now").alias("class"))
    return stage(moved.unionByName(fresh), "labels")


def _class_links(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst): the classes of linked nodes (src, dst)."""
    sides = _labelled(found.select(F.col("src").alias("node"), "dst"), labels).select(F.col("class").alias("a"), F.col("dst").alias("node"))
    return _labelled(sides, labels).select(F.col("a").alias("src"), F.col("class").alias("dst"))


def _many(entries: DataFrame) -> bool:
    """Whether entries (tag, class, …) of one tag stand in over PAIRS pairs of different classes an entry."""
    n = F.col("n").cast("double")
    sums = entries.groupBy("tag", "class").agg(F.count(F.lit(1)).alias("n")).groupBy("tag").agg(F.sum(n).alias("n"), F.sum(n * n).alias("squares"))
    return sums.agg(F.sum(n * n - F.col("squares")) / 2 > PAIRS * F.sum("n")).first()[0] or False


class _Block:
    """Images of a block (node, class as a number) and their entries, image by image: number of the image, tag and place."""

    def __init__(self, rows: pa.Table, classes: np.ndarray) -> None:
        tags, places = rows["tags"].combine_chunks(), rows["places"].combine_chunks()
        self.node = rows["node"].combine_chunks()
        self.image = np.repeat(np.arange(len(rows)), tags.value_lengths().to_numpy())
        self.tag, self.place, self.cls = tags.flatten().to_numpy(), places.flatten().to_numpy(), classes[self.image]


def _voting(a: _Block, b: _Block, classes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of images of a and b, the first of the smaller class, with VOTES votes for one turn and zoom: those that _voted finds."""
    bins = 5 * TURN_BINS
    tags, known = np.unique(b.tag, return_inverse=True)
    keys = known * classes + b.cls
    order = np.argsort(keys)
    keys = keys[order]
    # A corner of b has a number, as its bands vote once; numbers rise with the image.
    sorted_ = np.lexsort((b.place, b.image))
    fresh = np.diff(b.image[sorted_], prepend=-1).astype(bool) | np.diff(b.place[sorted_], prepend=-1).astype(bool)
    corner, of = np.empty(len(sorted_), np.int64), b.image[sorted_][fresh]
    corner[sorted_] = np.cumsum(fresh) - 1
    # The mates of an entry are those of its tag behind its own class.
    at = np.searchsorted(tags, a.tag)
    mine = np.flatnonzero(tags[np.minimum(at, len(tags) - 1)] == a.tag) if len(tags) else np.empty(0, np.int64)
    low, high = np.searchsorted(keys, at[mine] * classes + a.cls[mine], "right"), np.searchsorted(keys, (at[mine] + 1) * classes)
    mine, low, n = mine[high > low], low[high > low], (high - low)[high > low]
    ends, k, open_ = np.cumsum(n), 0, np.empty(0, np.int64)
    octave = np.log2(np.array(SCALES))
    while k < len(mine):
        before = ends[k] - n[k]
        stop = max(k + 1, int(np.searchsorted(ends, before + MEETINGS, "right")))
        i = np.repeat(mine[k:stop], n[k:stop])
        j = order[np.arange(len(i)) + np.repeat(low[k:stop] - (ends[k:stop] - n[k:stop] - before), n[k:stop])]
        p, q = a.place[i], b.place[j]
        turn = np.floor((_bits(q, 0, 12) - _bits(p, 0, 12)) % 360 * TURN_BINS / 360 + 0.5).astype(np.int64) % TURN_BINS
        zoom = np.rint(2 * (octave[_bits(q, 12, 8)] - octave[_bits(p, 12, 8)])).astype(np.int64) + 2
        votes = np.unique(np.concatenate([open_, (a.image[i] * len(of) + corner[j]) * bins + zoom * TURN_BINS + turn]))
        # The last image may have more pairs to come.
        last = len(votes) if stop == len(mine) else int(np.searchsorted(votes, a.image[mine[stop]] * len(of) * bins))
        votes, open_, k = votes[:last], votes[last:], stop
        src, rest = np.divmod(votes, len(of) * bins)
        kinds, counts = np.unique((src * len(b.node) + of[rest // bins]) * bins + rest % bins, return_counts=True)
        yield np.divmod(np.unique(kinds[counts >= VOTES] // bins), len(b.node))


def _candidates(entries: DataFrame) -> DataFrame:
    """(src, dst): pairs of images with VOTES votes for one turn and zoom among all pairs of entries (tag, class, node, place) of one tag and different classes; src has the smaller class.

    Each pair of blocks is a group. An image is in as many groups as there are blocks, with those of its entries whose tag the other block has.
    """
    blocks = max(BLOCKS, -(-entries.count() // ENTRIES))
    dealt = entries.select("tag", "class", "node", "place", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"))
    met = dealt.groupBy("tag").agg(F.expr("bit_or(shiftleft(1L, block % 63))").alias("within"), F.min("class").alias("a"), F.max("class").alias("b")).where("a < b")
    images = dealt.join(met.select("tag", "within"), "tag").groupBy("node", "class", "block").agg(F.collect_list(F.struct("tag", "place", "within")).alias("has"))
    sent = images.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("has", F.expr("filter(has, x -> shiftright(x.within, other % 63) & 1 = 1)"))
    i, j = F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    sent = sent.where(F.size("has") > 0).select(i, j, "block", "node", "class", F.col("has.tag").alias("tags"), F.col("has.place").alias("places"))

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        names, classes = np.unique(rows["class"].to_pandas().to_numpy(), return_inverse=True)
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        block = rows["block"].to_numpy()
        one, two = (_Block(rows.filter(pa.array(block == x)), classes[block == x]) for x in (i, j))
        for a, b in [(one, two), (two, one)][: 1 if i == j else 2]:
            for src, dst in _voting(a, b, len(names)):
                yield pa.RecordBatch.from_arrays([a.node.take(pa.array(src)), b.node.take(pa.array(dst))], ["src", "dst"])

    kind = entries.schema["node"].dataType
    return sent.groupBy("i", "j").applyInArrow(cell, T.StructType([T.StructField("src", kind), T.StructField("dst", kind)]))


def links(single: DataFrame) -> DataFrame:
    """(node, class) of images (node, place, d0, d1) that are linked with others, class being the smallest node of the class."""
    spark = single.sparkSession
    tags = F.array(*[_tag(i) for i in range(3)])
    entries = stage(_shared(_exploded(single).select(F.explode(tags).alias("tag"), "node", "place")), "entries")
    labels = spark.createDataFrame([], T.StructType([T.StructField("node", single.schema["node"].dataType), T.StructField("class", single.schema["node"].dataType)]))
    tested = labels.select(F.col("node").alias("src"), F.col("class").alias("dst"))
    first = 0
    while True:  # gather: the pairs that this leaves are all looked at below
        here = stage(_labelled(entries, labels), "round")
        centres = here.groupBy("tag").agg(F.min(F.struct("class", "node", "place")).alias("c"), F.max("class").alias("most")).where("c.class < most").select("tag", "c")
        mates = here.join(centres, "tag").where(F.col("class") != F.col("c.class"))
        votes = _voted(mates.select(F.col("c.node").alias("src"), F.col("node").alias("dst"), F.col("c.place").alias("p"), F.col("place").alias("q")))
        votes = _labelled(votes.join(tested, ["src", "dst"], "left_anti").withColumnRenamed("dst", "node"), labels)
        best = votes.groupBy("class").agg(F.max(F.struct("n", "src", F.col("node").alias("dst"))).alias("x")).select("x.src", "x.dst")
        results = stage(_verified(stage(best, "best"), single), "verified")
        tested = tested.unionByName(results.select("src", "dst"))
        found = results.where("linked")
        n = found.count()
        if n:
            labels = _joined(labels, _class_links(found, labels))
        drop_staged(here)
        first = first or n
        if n * 100 <= first or n * 10 <= first and not _many(_labelled(entries, labels)):
            break
    classes = stage(_labelled(entries, labels), "classes")
    drop_staged(entries)
    candidates = _candidates(classes).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    known = tested.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    found = stage(_verified(stage(candidates.join(known, ["src", "dst"], "left_anti"), "candidates"), single), "verified").where("linked")
    return _joined(labels, _class_links(found, labels))


def copies(images: DataFrame) -> DataFrame:
    """(image_id, n_corners, component_id, kept), a row for each row of images (image_id, width, pixels).

    component_id is the smallest image_id of the images it is linked with, directly or not, itself included.
    Images that can't be read have no corners and link only with equal ones; null pixels link with nothing. Rows
    without an id stand alone and are not kept. Repeated rows stay repeated; an empty table gives no rows. Pixels
    are read in one pass and never shuffled.
    """
    small_batches(images.sparkSession)
    key = F.sha2(F.concat(F.coalesce(F.col("width").cast("string"), F.lit("")), F.lit(":"), F.hex("pixels")).cast("binary"), 256)
    rows = images.select("image_id", key.alias("key"), described(F.col("width"), F.col("pixels")).alias("points"))
    rows = stage(rows.select("image_id", "key", *[f"points.{n}" for n in POINTS]), "points")
    good = rows.where("image_id IS NOT NULL AND key IS NOT NULL")
    # Equal images share one row in the tables; rows of one id are one node.
    firsts = stage(good.groupBy("key").agg(F.min("image_id").alias("node")), "firsts")
    single = stage(good.join(firsts, [good["key"] == firsts["key"], good["image_id"] == firsts["node"]], "left_semi").dropDuplicates(["image_id", "key"]).select(F.col("image_id").alias("node"), *POINTS), "single")
    # What is left to do needs no descriptors of rows, so their table makes room.
    brief = stage(rows.select("image_id", "key", F.size("place").cast("long").alias("n_corners")), "brief")
    drop_staged(rows)
    good = brief.where("image_id IS NOT NULL AND key IS NOT NULL")
    same = good.join(firsts, "key").where("image_id <> node").select(F.col("image_id").alias("src"), F.col("node").alias("dst"))
    labels = links(single)
    classes = connected_components(same.unionByName(labels.select(F.col("node").alias("src"), F.col("class").alias("dst"))))
    known = good.select("image_id", "n_corners").join(classes.withColumnRenamed("node", "image_id"), "image_id", "left")
    known = known.select("image_id", "n_corners", F.coalesce("component", "image_id").alias("component_id"))
    alone = brief.where("image_id IS NULL OR key IS NULL").select("image_id", "n_corners", F.col("image_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.coalesce(F.col("image_id") == F.col("component_id"), F.lit(False)))


def rendered(vectors: DataFrame, tile: int = 8) -> DataFrame:
    """(image_id, width, pixels): each vector of embeddings as a grey mosaic, a tile for each component; the tables hold no other images."""

    @F.pandas_udf(T.BinaryType())
    def draw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vs in batches:
            out = []
            for v in vs:
                if v is None or not len(v):
                    out.append(None)
                    continue
                x = np.nan_to_num(np.asarray(v, float))
                side = int(np.ceil(len(x) ** 0.5))
                grey = np.full(side * side, 128.0)
                grey[: len(x)] += 300 * x
                out.append(np.kron(np.clip(grey, 0, 255).astype(np.uint8).reshape(side, side), np.ones((tile, tile), np.uint8)).tobytes())
            yield pd.Series(out)

    width = F.ceil(F.sqrt(F.size("embedding").cast("double"))) * tile
    return vectors.select(F.col("vec_id").alias("image_id"), width.cast("int").alias("width"), draw(F.col("embedding")).alias("pixels"))


def op3_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors are dealt out evenly first: an image is some thousand times the work of reading its vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return copies(rendered(vectors.repartition(4 * spark.sparkContext.defaultParallelism)))
