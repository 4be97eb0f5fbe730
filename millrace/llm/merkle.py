"""Merkle fixity audit of WARC files: written, read back record by record, and compared replica with replica.

Files are written by Spark's text writer and cut into records again from their bytes; trees and audit are DataFrame functions. A record's leaf is the SHA-256 of its bytes. Inner nodes are ordered offset ranges of a file: the lowest cover
RANGE bytes each, every level above FANOUT ranges of the one below, and the root the whole file. A node's hash
covers the positions and hashes of its children, so moved, missing and extra records show. Ranges go by offset,
not by counting records, so each level is a plain grouping by (file, range) with bounded groups. Two replicas
are compared at their roots first; each level below is joined only under ranges that mismatched. The defaults suit
files of some 200 KB; for larger ones give audit more levels.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, small_batches, stage, table

RANGE, FANOUT, LEVELS = 1 << 13, 4, 3
#: Pages whose ids share id div PER_FILE go to one file, and on to further ones past FILE_BYTES.
PER_FILE, FILE_BYTES = 64, 1 << 26
#: Fixed values of the format: what starts a record, and what ends its header and its block.
_MARK, _END = b"WARC/1.1\r\n", b"\r\n\r\n"
_LENGTH, _ID = re.compile(rb"\r\nContent-Length: (\d{1,15})\r\n"), re.compile(rb"\r\nWARC-Record-ID: <urn:page:(-?\d{1,19})>\r\n")


def warc_record(pages: DataFrame) -> Column:
    """A page as a WARC/1.1 response record; null urls and pages count as empty, line ends in urls are percent-encoded."""
    text = lambda c: F.coalesce(pages[c], F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(pages["page_id"].cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.replace(F.replace(text("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))
    return F.concat(head, F.lit("\r\nContent-Length: "), F.octet_length(text("html")).cast("string"), F.lit("\r\n\r\n"), text("html"), F.lit("\r\n\r\n"))


def leaf_hash(record: Column) -> Column:
    return F.sha2(F.coalesce(record, F.lit("")).cast("binary"), 256)


def laid_out(rows: DataFrame) -> DataFrame:
    """rows (page_id, length, hash, …) with file and offset: records one after another in files of up to PER_FILE ids, by page_id and hash.

    Rows without an id are spread over files by their hash. A file ends with the record that reaches FILE_BYTES; the next one has a number behind its name.
    """
    base = F.concat(F.lit("pages-"), F.coalesce(F.expr(f"page_id div {PER_FILE}").cast("string"), F.concat(F.lit("none-"), F.substring("hash", 1, 2))))
    order = Window.partitionBy("file").orderBy("page_id", "hash").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("file", base).withColumn("offset", F.sum("length").over(order) - F.col("length")).withColumn("__part", F.expr(f"offset div {FILE_BYTES}"))
    placed = placed.withColumn("offset", F.col("offset") - F.min("offset").over(Window.partitionBy("file", "__part")))
    return placed.withColumn("file", F.when(F.col("__part") > 0, F.concat_ws("-", "file", "__part")).otherwise(F.col("file"))).drop("__part")


def write_warc(rows: DataFrame, path: str) -> None:
    """Gzipped WARC files path/replica=…/file=…/ of rows (replica, file, offset, record), record being text without the two line ends that close it.

    A file is written by one task, records by offset; level 4 of gzip takes a third of the time of its default for 4 % more bytes. Rows are brought together by file, unless laid_out has just done so.
    """
    rows.sortWithinPartitions("replica", "file", "offset").select("replica", "file", F.col("record").alias("value")).write.partitionBy("replica", "file").option("zlib.compress.level", "FOUR").text(path, compression="gzip", lineSep=_END.decode())


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the whole records of a file. One whose length doesn't lead to its end is skipped, up to the next that does."""
    at = 0
    while (at := data.find(_MARK, at)) >= 0:
        head = data.find(_END, at)
        size = _LENGTH.search(data, at, head + 2) if head >= 0 else None
        end = head + int(size[1]) + 8 if size else 0
        if end and data[end - 4 : end] == _END:
            yield at, data[at:end]
            at = end
        else:
            at += len(_MARK)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, page_id, hash) of the records in the files of one replica, each hash made of the bytes read. Of a gzip stream that breaks off, what comes before is read; no files give no rows."""
    kind = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("hash", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in kind]
            for file, content in zip(batch["file"], batch["content"], strict=True):
                name, content = file.as_py(), content.as_py()
                try:
                    data = gzip.decompress(content)
                except (OSError, EOFError, zlib.error):
                    data = _readable(content)
                for at, record in records(data):
                    page = _ID.search(record, 0, record.index(_END) + 2)
                    for column, v in zip(out, (name, at, len(record), int(page[1]) if page else None, hashlib.sha256(record).hexdigest()), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k.type) for v, k in zip(out, kind, strict=True)], schema=kind)

    small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.regexp_extract("path", "/file=([^/]+)/", 1).alias("file"), "content").mapInArrow(parse, "file string, offset long, length long, page_id long, hash string")


def _readable(content: bytes) -> bytes:
    """What can be read of a damaged gzip stream."""
    out, stream = bytearray(), zlib.decompressobj(31)
    for k in range(0, len(content), 1 << 12):
        try:
            out += stream.decompress(content[k : k + (1 << 12)])
        except zlib.error:
            break
    return bytes(out)


def archive(pages: DataFrame) -> DataFrame:
    """(file, offset, length, page_id, hash) of pages as WARC records."""
    record = warc_record(pages)
    return laid_out(pages.select("page_id", F.octet_length(record).cast("long").alias("length"), leaf_hash(record).alias("hash")))


def _parents(nodes: DataFrame, width: int) -> DataFrame:
    children = F.sort_array(F.collect_list(F.concat(F.lpad(F.col("start").cast("string"), 20, "0"), F.lit(":"), F.col("hash"))))
    return nodes.groupBy("file", F.expr(f"start - start % {width}").alias("start")).agg(F.sha2(F.array_join(children, "|").cast("binary"), 256).alias("hash"))


def tree(leaf: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Nodes (file, start, hash) by level: 1 to levels are ranges, the last item is the files' roots (start 0)."""
    nodes, out = leaf.select("file", F.col("offset").alias("start"), "hash"), []
    for k in range(levels):
        nodes = stage(_parents(nodes, RANGE * FANOUT**k), f"level{k + 1}")
        out.append(nodes)
    children = F.sort_array(F.collect_list(F.concat(F.lpad(F.col("start").cast("string"), 20, "0"), F.lit(":"), F.col("hash"))))
    return [*out, stage(nodes.groupBy("file").agg(F.lit(0).cast("long").alias("start"), F.sha2(F.array_join(children, "|").cast("binary"), 256).alias("hash")), "roots")]


def _compared(a: DataFrame, b: DataFrame, level: int, keys: list[str]) -> DataFrame:
    both = a.withColumnRenamed("hash", "primary_hash").join(b.withColumnRenamed("hash", "replica_hash"), keys, "full")
    status = F.when(F.col("replica_hash").isNull(), "missing").when(F.col("primary_hash").isNull(), "extra").when(F.col("primary_hash") == F.col("replica_hash"), "same").otherwise("changed")
    return both.withColumns({"level": F.lit(level), "status": status})


def audit(primary: DataFrame, replica: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(level, file, start, page_id, primary_hash, replica_hash, status) for two replicas' records (file, offset, page_id, hash), hash being leaf_hash of a record.

    All roots (level `levels` + 1) are returned; below them only nodes under a parent that mismatched, down to level 0,
    the records, where start is the offset. status is same, changed, missing (from the replica) or extra. Records
    that share a file and an offset are compared as one; rows with a null file, offset or hash are left out. Two empty
    tables give no rows.
    """
    sides = []
    for records in (primary, replica):
        leaf = records.select("file", F.col("offset").cast("long").alias("offset"), "page_id", "hash").where("file IS NOT NULL AND offset IS NOT NULL AND hash IS NOT NULL")
        leaf = leaf.groupBy("file", "offset").agg(F.min("page_id").alias("page_id"), F.array_join(F.sort_array(F.collect_list("hash")), "").alias("hash"))
        leaf = stage(leaf, "leaves")
        sides.append((leaf, tree(leaf, levels)))
    (leaf_a, tree_a), (leaf_b, tree_b) = sides
    columns = ["level", "file", "start", "page_id", "primary_hash", "replica_hash", "status"]
    none = F.lit(None).cast("long")
    found = stage(_compared(tree_a[-1], tree_b[-1], levels + 1, ["file", "start"]).withColumn("page_id", none).select(columns), "audit")
    out, under = found, found.where("status <> 'same'").select("file", F.col("start").alias("p"))
    for k in range(levels, -1, -1):
        # The parents' ranges: the whole file for the highest level.
        width = RANGE * FANOUT**k if k < levels else None
        parent = F.lit(0).cast("long") if width is None else F.expr(f"start - start % {width}")
        if k:
            nodes = [t[k - 1].withColumn("p", parent).join(under, ["file", "p"], "left_semi").drop("p") for t in (tree_a, tree_b)]
            found = _compared(*nodes, k, ["file", "start"]).withColumn("page_id", none)
        else:
            nodes = [x.withColumnRenamed("offset", "start").withColumn("p", parent).join(under, ["file", "p"], "left_semi").drop("p") for x in (leaf_a, leaf_b)]
            found = _compared(nodes[0].withColumnRenamed("page_id", "i"), nodes[1].withColumnRenamed("page_id", "j"), 0, ["file", "start"]).withColumn("page_id", F.coalesce("i", "j"))
        found = stage(found.select(columns), "audit")
        out, under = out.unionByName(found), found.where("status <> 'same'").select("file", F.col("start").alias("p"))
    return out


def op1_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of the table as WARC files are written, read and compared. One has known damage, which SQL works out too.

    Records of ids 7 past a multiple of 401 have a wrong letter in their header, and those 150 past a multiple of 403 are zeros.
    """
    body = F.col("r").substr(F.lit(1), F.length("r") - 4)
    pages = table(spark, sf_dir, "pages")
    rows = pages.select("page_id", warc_record(pages).alias("r")).select("page_id", F.octet_length("r").cast("long").alias("length"), leaf_hash(F.col("r")).alias("hash"), body.alias("record"))
    wrong = F.concat(F.lit("WARC/1.1\r\nWARC-Type: respons?"), F.col("record").substr(F.lit(30), F.length("record")))
    hurt = F.when(F.col("page_id") % 401 == 7, wrong).when(F.col("page_id") % 403 == 150, F.expr("repeat('\\0', cast(length - 4 as int))")).otherwise(F.col("record"))
    both = laid_out(rows).select("file", "offset", F.inline(F.array(F.struct(F.lit("a").alias("replica"), F.col("record").alias("record")), F.struct(F.lit("b").alias("replica"), hurt.alias("record")))))
    path = new_path(spark, "warc")
    write_warc(both, path)
    return audit(read_warc(spark, f"{path}/replica=a"), read_warc(spark, f"{path}/replica=b"))


def _sql() -> str:
    width = [RANGE * FANOUT**k for k in range(LEVELS)]
    steps = []
    for s in "ab":
        steps.append(f"{s}0 AS (SELECT file, start, min(page_id) AS page_id, string_agg(h, '' ORDER BY h) AS h FROM {s} GROUP BY file, start)")
        for k, w in enumerate(width, 1):
            steps.append(f"{s}{k} AS (SELECT file, start - start % {w} AS start, sha256(string_agg(lpad(start::VARCHAR, 20, '0') || ':' || h, '|' ORDER BY start)) AS h FROM {s}{k - 1} GROUP BY ALL)")
        steps.append(f"{s}{LEVELS + 1} AS (SELECT file, 0::BIGINT AS start, sha256(string_agg(lpad(start::VARCHAR, 20, '0') || ':' || h, '|' ORDER BY start)) AS h FROM {s}{LEVELS} GROUP BY file)")
    for k in range(LEVELS + 1, -1, -1):
        page = "coalesce(a.page_id, b.page_id)" if k == 0 else "NULL::BIGINT"
        parent = "0" if k == LEVELS else f"start - start % {RANGE * FANOUT**k}"
        source = lambda s: f"{s}{k}" if k > LEVELS else f"(SELECT * FROM {s}{k} WHERE (file, {parent}) IN (SELECT (file, start) FROM f{k + 1} WHERE status <> 'same'))"  # noqa: B023, E731
        steps.append(
            f"f{k} AS (SELECT {k} AS level, coalesce(a.file, b.file) AS file, coalesce(a.start, b.start) AS start, {page} AS page_id, a.h AS primary_hash, b.h AS replica_hash, "
            f"CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'extra' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS status "
            f"FROM {source('a')} a FULL JOIN {source('b')} b ON a.file = b.file AND a.start = b.start)"
        )
    crlf = "chr(13) || chr(10)"
    record = (
        f"'WARC/1.1' || {crlf} || 'WARC-Type: response' || {crlf} || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || {crlf} || 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') "
        f"|| {crlf} || 'Content-Length: ' || strlen(coalesce(html, '')) || {crlf} || {crlf} || coalesce(html, '') || {crlf} || {crlf}"
    )
    return (
        f"WITH r AS (SELECT page_id, 'pages-' || coalesce((page_id // {PER_FILE})::VARCHAR, 'none-' || left(sha256({record}), 2)) AS file, {record} AS record FROM pages), "
        "p AS (SELECT *, (sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, sha256(record) ROWS UNBOUNDED PRECEDING) - strlen(record))::BIGINT AS spot FROM r), "
        f"o AS (SELECT page_id, record, file || CASE WHEN spot >= {FILE_BYTES} THEN '-' || (spot // {FILE_BYTES}) ELSE '' END AS file, spot - min(spot) OVER (PARTITION BY file, spot // {FILE_BYTES}) AS start FROM p), "
        "a AS (SELECT file, start, page_id, sha256(record) AS h FROM o), "
        "b AS (SELECT file, start, page_id, sha256(CASE WHEN page_id % 401 = 7 THEN replace(left(record, 29), 'response', 'respons?') || substr(record, 30) ELSE record END) AS h FROM o WHERE NOT coalesce(page_id % 403 = 150, false)), "
        + ", ".join(steps)
        + " "
        + " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(LEVELS + 2))
    )


OP1_SQL = _sql()
