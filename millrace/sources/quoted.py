"""Delimited text with line breaks inside quotes, each file read by as many tasks as it has ranges.

Spark reads plain lines. A line is a map from the state before it (outside or inside quotes) to the state after it, and such maps compose: the task that
reads a range composes its lines, a table of one row for each range composes the ranges of a file, and in a second reading every range knows the state it
starts in. Lines never move, but for those of records that go over the end of a range. A file at whose end a quote is still open is read as if it had no quotes.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.staging import stage
from millrace.operators.frame import Frame, unique_names

_START, _TEXT, _INSIDE, _CLOSED = 3, 0, 1, 2


def _after(line: Column, delimiter: str, start: int) -> Column:
    """Whether quotes are open after a line, from the state at its start. A quote opens a field at its very start; a doubled one inside is text, as is one after a field's closing one."""
    pieces = F.split(line, '"', -1)
    before = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # what precedes each quote

    def step(state: Column, piece: Column) -> Column:
        opens = F.endswith(piece, F.lit(delimiter))
        return (
            F.when(state == _INSIDE, F.lit(_CLOSED))
            .when(opens | ((piece == "") & state.isin(_START, _CLOSED)), F.lit(_INSIDE))
            .otherwise(F.lit(_TEXT))
        )

    return (F.aggregate(before, F.lit(start), step) == _INSIDE).cast("int")


def _states(batch: pa.RecordBatch, k: int, n: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """States before and after n lines of a batch from the k-th on, from the state before them."""
    o, i = (batch[c].slice(k, n).to_numpy(zero_copy_only=False) for c in ("o", "i"))
    turned = np.cumsum(o > i) & 1
    last = np.maximum.accumulate(np.where(o == i, np.arange(n), -1))
    after = np.where(last >= 0, (o ^ turned)[last], start) ^ turned
    return np.concatenate([[start], after[:-1]]), after


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """((file, block), first, count) of the lines of one range after another."""
    if not batch.num_rows:
        return
    file, block = batch["__file"], batch["__block"]
    other = pc.or_(pc.not_equal(file.slice(1), file.slice(0, len(file) - 1)), pc.not_equal(block.slice(1), block.slice(0, len(block) - 1)))
    at = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
    for k, end in zip(at, at[1:], strict=False):
        yield (file[k].as_py(), block[k].as_py()), k, end - k


#: Of a range, started outside (0) or inside quotes (1): the state at its end, how many records start, the first line of the one left open; how many lines
#: aren't empty, the last line of a record that goes on from before, and the places in the range of its first record's lines, if that starts it.
_SUMMARY = "__file string, __block long, e0 int, e1 int, n0 long, n1 long, t0 long, t1 long, full long, head long, p0 long, p1 long"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SUMMARY.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 8]
    out = lambda r: pa.RecordBatch.from_arrays([pa.array([r[n]], k) for n, k in zip(names, kinds, strict=True)], names)
    now, seen = None, 0
    for batch in batches:
        for key, k, n in _runs(batch):
            if now is None or key != (now["__file"], now["__block"]):
                if now is not None:
                    yield out(now)
                now, seen = {"__file": key[0], "__block": key[1], "e0": 0, "e1": 1, "n0": 0, "n1": 0, "t0": None, "t1": None, "full": 0, "head": None, "p0": None, "p1": None}, 0
            line, full = batch["__line"].slice(k, n), batch["full"].slice(k, n).to_numpy(zero_copy_only=False)
            now["full"] += int(full.sum())
            if now["p0"] is None and full.any():
                now["p0"] = seen + int(full.argmax())
            for s in (0, 1):
                before, after = _states(batch, k, n, now[f"e{s}"])
                starts, shut = np.flatnonzero(before == 0), np.flatnonzero(after == 0)
                now[f"e{s}"] = int(after[-1])
                now[f"n{s}"] += int(full[starts].sum())
                if not after[-1]:
                    now[f"t{s}"] = None
                elif len(starts):
                    now[f"t{s}"] = line[int(starts[-1])].as_py()
                if s and now["head"] is None and len(shut):
                    now["head"] = line[int(shut[0])].as_py()
                if not s and now["p1"] is None and now["p0"] is not None:
                    shut = shut[shut + seen >= now["p0"]]
                    now["p1"] = seen + int(shut[0]) if len(shut) else None
            seen += n
    if now is not None:
        yield out(now)


_RECORD = "__file string, __block long, __line long, record string, quoted boolean, first boolean"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that lie whole in a range, out of lines with the range's state."""
    now = state = held = fresh = None
    for batch in batches:
        for key, k, n in _runs(batch):
            if key != now:
                now, state, held, fresh = key, batch["at"][k].as_py(), None, batch["top"][k].as_py()
            value, line, is_quoted = batch["value"].slice(k, n), batch["__line"].slice(k, n), batch["quoted"][k].as_py()
            before, after = _states(batch, k, n, state) if is_quoted else (np.zeros(n, int), np.zeros(n, int))
            starts = np.flatnonzero(before == 0)
            m = int(starts[0]) if len(starts) else n
            texts, lines = [], []
            if m and held is not None:  # lines before are of a record that an earlier range has begun
                held[1].append(value.slice(0, m))
            if held is not None and (m < n or not after[-1]):
                texts.append(pa.array(["\n".join(v for part in held[1] for v in part.to_pylist())]))
                lines.append(pa.array([held[0]], pa.int64()))
                held = None
            if len(starts) and after[-1]:
                held = (line[int(starts[-1])].as_py(), [value.slice(int(starts[-1]))])
                ends = starts
            else:
                ends = np.append(starts, n)
            if len(ends) > 1:
                texts.append(value.slice(m, int(ends[-1]) - m) if len(ends) - 1 == ends[-1] - m else pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), value), "\n"))
                lines.append(line.take(pa.array(ends[:-1])))
            state = int(after[-1])
            if not texts:
                continue
            text, at = pa.concat_arrays(texts), pa.concat_arrays(lines)
            some = pc.not_equal(text, "")
            text, at = text.filter(some), at.filter(some)
            if not len(text):
                continue
            first = np.zeros(len(text), bool)
            first[0], fresh = fresh, False
            same = lambda v, kind: pa.array([v], kind).take(pa.array(np.zeros(len(text), int)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([same(key[0], pa.string()), same(key[1], pa.int64()), at, text, same(is_quoted, pa.bool_()), pa.array(first)], [c.split()[0] for c in _RECORD.split(", ")])


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line"))


def _mapped(read: DataFrame, delimiter: str) -> DataFrame:
    """Lines with the state after them from outside quotes (o) and from inside (i)."""
    has = F.col("value").contains('"')
    return read.withColumns({"o": F.when(has, _after(F.col("value"), delimiter, _START)).otherwise(0), "i": F.when(has, _after(F.col("value"), delimiter, _INSIDE)).otherwise(1)})


def _ranges(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """A row for each range of a file: the state before it (at), whether the file's quotes close (quoted), whether the first record starts in it (top), the lines of records that it shares with others; staged."""
    slim = _mapped(_read(spark, path), delimiter).select("__file", "__block", "__line", "o", "i", (F.col("value") != "").alias("full"))
    rows = slim.mapInArrow(_summed, _SUMMARY)
    order = Window.partitionBy("__file").orderBy("__block")
    through, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A state is the last one that a range fixes, turned over by each flip since: fixed values are kept turned by all flips before them.
    flips = F.sum((F.col("e0") > F.col("e1")).cast("int"))
    rows = rows.withColumn("c", (flips.over(through) % 2).cast("int")).withColumn("b", F.coalesce(F.lag("c").over(order), F.lit(0)))
    rows = rows.withColumn("v", F.when(F.col("e0") == F.col("e1"), F.col("e0").bitwiseXOR(F.col("c"))))
    state = lambda over, turned: F.coalesce(F.last("v", ignorenulls=True).over(over), F.lit(0)).bitwiseXOR(F.col(turned))
    rows = rows.withColumns({"at": state(earlier, "b"), "end": state(through, "c")}).withColumn("quoted", F.last("end").over(whole) == 0)
    by_state = lambda a: F.when(F.col("at") == 0, F.col(f"{a}0")).otherwise(F.col(f"{a}1"))
    rows = rows.withColumn("n", F.when(F.col("quoted"), by_state("n")).otherwise(F.col("full"))).withColumn("tail", F.when(F.col("quoted"), by_state("t")))
    has = F.when(F.col("n") > 0, F.col("__block"))
    rows = rows.withColumns({"open": F.last(has, ignorenulls=True).over(earlier), "top": F.coalesce(F.col("__block") == F.min(has).over(whole), F.lit(False))})
    return stage(rows.select("__file", "__block", "at", "quoted", "top", "n", "open", "head", "tail", "p0", "p1"), "ranges")


def _records(read: DataFrame, ranges: DataFrame, delimiter: str) -> DataFrame:
    told = F.broadcast(ranges.select("__file", "__block", "at", "quoted", "top"))  # a row for each range
    single = _mapped(read, delimiter).join(told, ["__file", "__block"]).select("__file", "__block", "__line", "value", "o", "i", "at", "quoted", "top").mapInArrow(_whole, _RECORD)
    shared = F.broadcast(ranges.where("quoted AND (at = 1 OR tail IS NOT NULL)").select("__file", "__block", "at", "head", "tail", "open", (F.col("top") & (F.col("n") == 1)).alias("first")))
    ahead = (F.col("at") == 1) & (F.col("head").isNull() | (F.col("__line") <= F.col("head")))
    lines = read.join(shared, ["__file", "__block"]).withColumn("ahead", ahead).where(F.col("ahead") | (F.col("__line") >= F.col("tail")))
    of = F.when(F.col("ahead"), F.col("open")).otherwise(F.col("__block"))
    parts = lines.groupBy("__file", of.alias("of")).agg(F.sort_array(F.collect_list(F.struct("__block", "__line", "value"))).alias("p"), F.max(F.col("first") & ~F.col("ahead")).alias("first"))
    several = parts.select("__file", F.col("p")[0]["__block"].alias("__block"), F.col("p")[0]["__line"].alias("__line"), F.array_join("p.value", "\n").alias("record"), F.lit(True).alias("quoted"), "first")
    return single.unionByName(several)


def records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(__file, __block, __line, record, quoted, first): the records of all files, in the order of the first three. `quoted` is false in files that end inside quotes, `first` marks a file's first record.

    Text is read twice, and a third time for the lines of records that go over the end of a range, which alone move. A record is held by one task. Empty lines outside of quotes are left out.
    """
    return _records(_read(spark, path), _ranges(spark, path, delimiter), delimiter)


def _top(spark: SparkSession, path: str, ranges: DataFrame, rows: DataFrame) -> tuple[str, bool] | None:
    """The first record of the first file that has one, and whether that file has quotes."""
    at = ranges.where("top").orderBy("__file").first()
    if at is None:
        return None
    if at["quoted"] and at["p1"] is None:  # goes over the end of its range
        return rows.where(F.col("first") & (F.col("__file") == at["__file"])).first()["record"], True
    here = (F.col("_metadata.file_path") == at["__file"]) & (F.col("_metadata.file_block_start") == at["__block"])
    lines = spark.read.text(path).where(here).select("value").take((at["p1"] if at["quoted"] else at["p0"]) + 1)
    return "\n".join(r["value"] for r in lines[at["p0"] :]), at["quoted"]


def delimited_ranges(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True) -> tuple[Frame, list[str]]:
    """The table as readers.delimited gives it, and the files that were read without quotes since one never closes.

    The first record of the first file that has one gives the number of columns and, with a header, their names; then each file's first record is a header. Line ends inside quotes become \\n. No text at all: no columns.
    """
    if len(delimiter) != 1 or delimiter in '"\r\n':
        raise ValueError(f"not a delimiter: {delimiter!r}")
    ranges = _ranges(spark, path, delimiter)
    rows = _records(_read(spark, path), ranges, delimiter)
    top = _top(spark, path, ranges, rows)
    if top is None:
        return Frame(rows.select("__file", "__block", "__line"), ("__file", "__block", "__line")), []
    rows = rows.withColumn("record", F.when(F.col("first"), F.regexp_replace("record", "^\ufeff", "")).otherwise(F.col("record")))
    record, has_quotes = top[0].removeprefix("\ufeff"), top[1]
    cells = next(csv.reader(io.StringIO(record, newline=""), delimiter=delimiter), [""]) if has_quotes else record.split(delimiter)
    names = unique_names(cells if header else [""] * len(cells))
    n = range(len(names))
    parsed = F.from_csv("record", F.lit(", ".join(f"c{i} string" for i in n)), {"sep": delimiter, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    plain = F.split("record", f"\\Q{delimiter}\\E", -1)
    body = rows.where("NOT first") if header else rows
    both = body.withColumns({"__csv": F.when(F.col("quoted"), parsed), "__raw": F.when(~F.col("quoted"), plain)})
    out = both.select(*[F.coalesce(F.col("__csv")[f"c{i}"], F.get("__raw", F.lit(i)), F.lit("")).alias(names[i]) for i in n], "__file", "__block", "__line")
    unclosed = [r[0] for r in ranges.where("top AND NOT quoted").select("__file").orderBy("__file").collect()]
    return Frame(out, ("__file", "__block", "__line")), unclosed
