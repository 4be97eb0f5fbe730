"""Benchmark decontamination: a positional inverted index over whole texts, searched for phrases and near phrases.

The index is made of segments, runs of documents of bounded size, each written by the task that reads them: a row a
(segment, term) with all places of the term in the segment's stream of words. Places are gaps of 7-bit bytes, so a
posting takes a byte or two. The empty term, which no text has, holds where the segment's documents begin.
A search takes each phrase's rarest term, meets the segments that hold it, and intersects the lists of the other terms
there, each moved by its offset in the phrase, from rare to frequent. All groups are one segment and one bounded block of phrases.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, small_batches, stage, table

#: Words and documents at which a segment is closed, bytes of a text split at once, phrases in a block.
SEGMENT, SEGMENT_DOCS, PIECE, BLOCK = 1 << 21, 1 << 16, 1 << 20, 4096
#: Words in a window of a benchmark item; places by which a near phrase's words may be off.
WINDOW, SLACK = 10, 2
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes as words have them: A-Z lower-cased, all other ASCII but digits and a-z a blank.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of unsigned numbers, 7 bits a byte with the low ones first and the high bit set on all but the last; and where each number ends."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        size += values >= 1 << bits
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for j in range(int(size.max(initial=0))):
        some = size > j
        out[ends[some] - size[some] + j] = (values[some] >> 7 * j & 127) | (size[some] > j + 1) << 7
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    """The places that a list of gaps stands for."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size, out = ends - starts + 1, np.zeros(len(ends), np.int64)
    for j in range(int(size.max(initial=0))):
        some = size > j
        out[some] |= (raw[starts[some] + j].astype(np.int64) & 127) << 7 * j
    return np.cumsum(out)


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """Runs of the words of a text, a long one in pieces cut between words."""
    data = (text or b"").translate(_WORDS)
    at = 0
    while at < len(data):
        cut = data.find(b" ", at + PIECE)
        cut = len(data) if cut < 0 else cut
        yield data[at:cut].split()
        at = cut


class _Segment:
    """Documents gathered until they are enough for a segment."""

    def __init__(self) -> None:
        self.of: dict[bytes, int] = defaultdict(count().__next__)
        self.parts: list[np.ndarray] = []
        self.starts = [0]
        self.ids: list[pa.Array] = []

    def add(self, doc_id: pa.Array, text: bytes | None) -> None:
        n = 0
        for words in words_of(text):
            self.parts.append(np.fromiter(map(self.of.__getitem__, words), np.int32, len(words)))
            n += len(words)
        self.starts.append(self.starts[-1] + n)
        self.ids.append(doc_id)

    @property
    def full(self) -> bool:
        return self.starts[-1] >= SEGMENT or len(self.ids) >= SEGMENT_DOCS

    def rows(self, segment: int) -> Iterator[pa.RecordBatch]:
        each = pa.StructArray.from_arrays([pa.concat_arrays(self.ids), pa.array(np.diff(self.starts))], names=["id", "n_words"])
        stream = np.concatenate([np.empty(0, np.int32), *self.parts])
        places = np.argsort(stream, kind="stable")
        n = np.bincount(stream, minlength=len(self.of)).astype(np.int64)
        first = np.cumsum(n) - n
        gaps = np.diff(places, prepend=0)
        gaps[first] = places[first]
        lists = [(np.diff(self.starts, prepend=0), np.array([len(self.starts)]), pa.array([b""])), (gaps, n, pa.array(list(self.of), pa.binary()))]
        for k, (values, lengths, terms) in enumerate(lists):
            data, ends = packed(values)
            offsets = np.concatenate([[0], ends[np.cumsum(lengths) - 1]]).astype(np.int32) if len(lengths) else np.zeros(1, np.int32)
            postings = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            ids = pa.nulls(len(lengths), pa.list_(each.type)) if k else pa.ListArray.from_arrays(pa.array([0, len(each)], pa.int32()), each)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lengths), segment)), terms.cast(pa.string()), pa.array(lengths), postings, ids], names=["segment", "term", "n", "postings", "docs"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(segment, term, n, postings, docs): all words of all texts, in one pass without a shuffle, written once in the shared folder.

    Null, empty and wordless texts are documents without words. The row of the empty term has the segment's documents in
    order, (id, n_words), with ids of any type, null and repeated ones too. A long text is a segment of its own. An empty table gives no rows; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("postings", T.BinaryType()), T.StructField("docs", T.ArrayType(T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("postings", lambda: None)  # lets go of an earlier operator's model
        numbers, held = count(TaskContext.get().partitionId() << 32), _Segment()
        for b in batches:
            for i, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                held.add(b.column(0).slice(i, 1), text)
                if held.full:
                    yield from held.rows(next(numbers))
                    held = _Segment()
        if held.ids:
            yield from held.rows(next(numbers))

    return stage(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema), "index")


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, phrase): each run of size words of an item; an item of fewer, but not none, is one run. The item is its id as text, a null one the empty text."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(lowered, F.lit(f"({WORD})"), 1).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return words.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), size).alias("phrase")).distinct()


def occurrences(post: Callable[[str], np.ndarray], bounds: np.ndarray, plan: list[tuple[int, str]], slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, is it exact): where each (offset, term) of plan has a place within slack of the start plus its offset, in the same document.

    The start is that of the first term's place. Lists are intersected in the order of plan, from rare to frequent.
    """
    offset, term = plan[0]
    at = post(term)
    start, doc = at - offset, np.searchsorted(bounds, at, "right") - 1
    low, high = bounds[doc], bounds[doc + 1]
    exact = (start >= low) & (start + len(plan) <= high)
    for offset, term in plan[1:]:
        there, want = post(term), start + offset
        k = np.searchsorted(there, np.maximum(want - slack, low))
        near = there[np.minimum(k, len(there) - 1)]
        ok = (k < len(there)) & (near <= np.minimum(want + slack, high - 1))
        exact &= there[np.minimum(np.searchsorted(there, want), len(there) - 1)] == want
        start, doc, low, high, exact = start[ok], doc[ok], low[ok], high[ok], exact[ok]
        if not len(start):
            break
    return doc, start - low, exact


_MATCHES = "segment long, ix int, matches array<struct<phrase:long,start:int,length:int,exact:boolean>>, spans array<struct<start:int,end:int>>"


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray, ix: np.ndarray) -> pa.Array:
    """For each document of ix, its intervals joined where they touch; doc and ix rise, start rises within a document."""
    begun = start + (doc << 32)  # documents apart from each other
    last = np.maximum.accumulate(end + (doc << 32)) if len(doc) else begun
    fresh = np.ones(len(doc), bool)
    fresh[1:] = begun[1:] > last[:-1]
    first = np.flatnonzero(fresh)
    final = last[np.append(first[1:], len(doc)) - 1] & 0xFFFFFFFF if len(first) else first
    each = pa.StructArray.from_arrays([pa.array(start[first], pa.int32()), pa.array(final, pa.int32())], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(doc[first], ix), len(first)), pa.int32()), each)


def _search(slack: int):
    def run(lists: pa.Table, plans: pa.Table) -> pa.Table:
        rows = dict(zip(lists["term"].to_pylist(), lists["postings"].to_pylist(), strict=True))
        ready: dict[str, np.ndarray] = {}

        def post(term: str) -> np.ndarray:
            if term not in ready:
                ready[term] = unpacked(rows[term])
            return ready[term]

        parts = []
        for phrase, plan in zip(plans["phrase_id"].to_pylist(), plans["plan"].to_pylist(), strict=True):
            if all(t["term"] in rows for t in plan):
                doc, start, exact = occurrences(post, post(""), [(t["offset"], t["term"]) for t in plan], slack)
                if len(doc):
                    parts.append((doc, np.full(len(doc), phrase), start, np.full(len(doc), len(plan)), exact))
        columns = [np.concatenate([np.empty(0, np.int64), *[p[k] for p in parts]]) for k in range(5)]
        by = np.lexsort((columns[2], columns[0]))
        doc, phrase, start, length, exact = (c[by] for c in columns)
        ix, first = np.unique(doc, return_index=True)
        found = pa.StructArray.from_arrays([pa.array(phrase, pa.int64()), pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(exact.astype(bool))], names=["phrase", "start", "length", "exact"])
        segment = lists["segment"][0].as_py() if len(lists) else 0
        matches, exact = pa.ListArray.from_arrays(pa.array([*first, len(doc)], pa.int32()), found), exact.astype(bool)
        spans = _spans(doc[exact], start[exact], start[exact] + length[exact], ix)
        return pa.table({"segment": pa.array(np.full(len(ix), segment), pa.int64()), "ix": pa.array(ix, pa.int32()), "matches": matches, "spans": spans})

    return run


def search(index: DataFrame, phrases: DataFrame, slack: int = SLACK) -> DataFrame:
    """(segment, ix, matches, spans): for documents of the index, where phrases (phrase_id long, phrase array of words) stand, and the runs of words in exact ones.

    A match is exact, or near: each word within slack places of where the rarest one's place puts it. A document may have
    a row a block of phrases. Phrases of words that no text has, and empty ones, match nothing.
    """
    n = phrases.count()
    block = F.pmod(F.xxhash64("phrase_id"), F.lit(max(1, -(-n // BLOCK)))).cast("int")
    terms = phrases.select("phrase_id", block.alias("block"), F.size("phrase").alias("size"), F.posexplode("phrase").alias("offset", "term"))
    some = stage(terms.select("term").distinct(), "terms")  # written first, so that Spark knows its size and need not move the index if it is small
    known = index.select("term", "n").join(some, "term").groupBy("term").agg(F.sum("n").alias("n"))
    plans = terms.join(known, "term").groupBy("phrase_id", "block").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("plan"), F.first("size").alias("size")).where(F.size("plan") == F.col("size"))
    plans = stage(plans.select("phrase_id", "block", "plan"), "plans")
    wanted = plans.select("block", F.explode("plan.term").alias("term")).distinct()
    wanted = stage(wanted.unionByName(plans.select("block", F.lit("").alias("term")).distinct()), "wanted")
    lists = stage(index.select("segment", "term", "postings").join(wanted, "term"), "lists")
    rarest = plans.select("phrase_id", "block", "plan", F.col("plan")[0]["term"].alias("term"))
    routed = lists.select("segment", "block", "term").join(rarest, ["block", "term"]).select(F.col("segment").alias("of"), F.col("block").alias("part"), "phrase_id", "plan")
    return lists.groupBy("segment", "block").cogroup(routed.groupBy("of", "part")).applyInArrow(_search(slack), _MATCHES)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """(id, n_words, n_hit, items, near_items, spans), a row for each row of docs.

    items are the ids, sorted as texts, of the items with a window in the document; near_items those of which one is there with
    words up to slack places off (the former included). A word is hit if it is in any exact occurrence; spans are the (start, end) of the runs of
    hit words. Null and wordless texts have no words and hit nothing; items without words occur nowhere. Rows of items of one id count as one item.
    """
    index = build_index(docs, id_col, text_col)
    of_items = stage(windows(items, size=size), "windows")
    phrases = stage(of_items.select("phrase").distinct().withColumn("phrase_id", F.monotonically_increasing_id()), "phrases")
    matches = stage(search(index, phrases, slack), "matches")
    owners = of_items.join(phrases, "phrase").select(F.col("phrase_id").alias("phrase"), "item")
    each = matches.select("segment", "ix", F.explode(F.array_distinct(F.transform("matches", lambda m: F.struct(m["phrase"].alias("phrase"), m["exact"].alias("exact"))))).alias("m"))
    named = each.select("segment", "ix", "m.phrase", "m.exact").join(owners, "phrase").groupBy("segment", "ix")
    named = named.agg(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item")))).alias("items"), F.array_sort(F.collect_set("item")).alias("near_items"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def joined(spans: Column, x: Column) -> Column:
        last, rest = F.try_element_at(spans, F.lit(-1)), F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0)))
        grown = F.concat(rest, F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(last["end"] >= x["start"], grown).otherwise(F.concat(spans, F.array(x)))

    spans = matches.groupBy("segment", "ix").agg(F.collect_list("spans").alias("found"))
    spans = spans.select("segment", "ix", F.when(F.size("found") == 1, F.col("found")[0]).otherwise(F.aggregate(F.array_sort(F.flatten("found")), none, joined)).alias("spans"))
    marked = index.where("term = ''").select("segment", F.posexplode("docs").alias("ix", "d")).select("segment", "ix", "d.id", "d.n_words")
    out = marked.join(named, ["segment", "ix"], "left").join(spans, ["segment", "ix"], "left")
    n_hit = F.aggregate(F.coalesce("spans", none), F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    empty = F.array().cast("array<string>")
    return out.select("id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", empty).alias("items"), F.coalesce("near_items", empty).alias("near_items"), F.coalesce("spans", none).alias("spans"))


def op12_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


#: All windows of all texts against those of the items.
OP12_SQL = r"""
WITH item_words AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
wanted AS (
    SELECT DISTINCT item, array_to_string(list_slice(words, pos, pos + least(10, len(words)) - 1), ' ') AS phrase, least(10, len(words)) AS size
    FROM (SELECT item, words, unnest(generate_series(1, greatest(len(words) - 9, 1))) AS pos FROM item_words WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM wanted),
texts AS (
    SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
runs AS (
    SELECT doc, pos, size, array_to_string(list_slice(words, pos, pos + size - 1), ' ') AS phrase
    FROM (SELECT doc, words, size, unnest(generate_series(1, len(words) - size + 1)) AS pos FROM texts, sizes WHERE len(words) >= size)),
found AS (SELECT doc, pos, r.size, item FROM runs r JOIN wanted w ON r.phrase = w.phrase AND r.size = w.size),
hit AS (SELECT doc, count(DISTINCT place) AS n FROM (SELECT doc, unnest(generate_series(pos, pos + size - 1)) AS place FROM found) GROUP BY doc),
items AS (SELECT doc, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc, item FROM found) GROUP BY doc)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
    sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM texts t LEFT JOIN hit h USING (doc) LEFT JOIN items i USING (doc)
"""
