"""Token ids as binary files of independent zstandard frames with a trailing seek table.

File: one frame per document, holding its ids as little-endian unsigned 32-bit integers; then a skippable
frame (magic 0x184D2A5D) with the documents' ids, a signed 64-bit integer and a presence byte each; then the
seek table of the zstandard seekable format: a skippable frame (magic 0x184D2A5E) with compressed size,
decompressed size and the low 32 bits of the XXH64 of the contents for each frame, closed by the number of
frames, a descriptor byte with the checksum flag, and the magic 0x8F92EAB1. Any zstandard decoder reads the
whole file; a reader with the seek table decompresses only the documents it was asked for.

Documents are range-partitioned by id and written in id order by the tasks that encode them, each file under a
name of its own; a manifest lists the files of the tasks that succeeded, so what a lost or repeated attempt
left behind is never read. Texts are encoded by the tokenizers library; since its normaliser and
pre-tokenizer never join across blanks, a bounded cache of blank-separated pieces gives the same ids; letters
are kept apart from the signs after them, and small where the normaliser makes them so.
"""

from __future__ import annotations

import string
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, new_path, small_batches, stage, table

END_ID = 2
SEEK_MAGIC, SEEKABLE_MAGIC, IDS_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A5D
LEVEL = 1
#: A file is closed after so many bytes; pieces kept in each half of the encoder's cache.
FILE_BYTES, CACHE = 256 << 20, 300_000


def _letters(piece: str) -> bool:
    """Letters only, before and after the normaliser: a letter that it takes apart ends in a mark, which joins a stop after it in one pre-token."""
    return piece.isalpha() and (piece.isascii() or ((low := piece.lower()).isalpha() and unicodedata.is_normalized("NFC", low)))


def _gathered(parts: list[bytes], codes: np.ndarray, counts: list[int], block: int = 1 << 17) -> list[bytes]:
    """For each count, the parts (whole ids of four bytes) named by so many of the codes, joined; the work is bounded by block codes at a time."""
    flat, sizes = np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    starts, out, at = np.cumsum(sizes) - sizes, [], 0
    for n in counts:
        runs = []
        for k in range(at, at + n, block):
            own = codes[k : min(k + block, at + n)]
            size = sizes[own]
            ends = np.cumsum(size)
            runs.append(flat[np.repeat(starts[own] - ends + size, size) + np.arange(ends[-1])].tobytes())
        out.append(b"".join(runs))
        at += n
    return out


class Encoder:
    """Ids of texts as bytes. Pieces are kept in two generations of at most `size` entries each."""

    def __init__(self, path: str, size: int = CACHE):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib, self.size, self.new, self.old = Tokenizer.from_file(path), size, {"": b""}, {}
        n = self.lib.get_vocab_size(with_added_tokens=True)
        self.lowers = self.lib.normalizer is not None and self.lib.normalizer.normalize_str(string.ascii_uppercase) == string.ascii_lowercase
        self.ends = np.array([str(self.lib.id_to_token(i)).endswith("</w>") for i in range(n)])

    def _ids(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        """Pieces of letters only are one pre-token each, whose last id ends a word, so many can go in one text; it needs no offsets."""
        words, rest = [], []
        for p in pieces:
            (words if _letters(p) else rest).append(p)
        if words:
            ids = np.frombuffer(self._ids([" ".join(words)])[0], "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(words):
                raw, at = ids.tobytes(), [0, *(4 * cut).tolist()]
                self.new.update(zip(words, [raw[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))
            else:
                self.new.update(zip(words, self._ids(words), strict=True))
        self.new.update(zip(rest, self._ids(rest), strict=True))

    def _parts(self, piece: str) -> tuple[str, str]:
        """The piece whose ids it has, in small letters where the normaliser makes them so, and the signs that follow its letters, a pre-token of their own."""
        if self.lowers and piece.isascii() and "<|" not in piece and (low := piece.lower()) != piece:  # an added token is looked for before the normaliser
            piece = low
        stem = piece.rstrip(string.punctuation)
        return (stem, piece[len(stem) :]) if _letters(stem) else (piece, "")

    def encode_batch(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Texts are split and their pieces numbered by Arrow, so that Python sees a piece of a batch once."""
        if len(self.new) > self.size:
            self.old, self.new = self.new, {"": b""}
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        split = pc.ascii_split_whitespace(texts)
        numbered = split.flatten().dictionary_encode()
        if not (n := len(numbered.dictionary)):
            return [b""] * len(texts)
        # No piece holds a line break; one long string is turned into Python's faster than many short ones.
        pieces = pc.binary_join(type(split).from_arrays([0, n], numbered.dictionary), "\n")[0].as_py().split("\n")
        new, old = self.new, self.old
        ids = list(map(new.get, pieces))
        places, stems, tails, unseen = [], [], [], set()
        for k in [k for k, x in enumerate(ids) if x is None]:
            p = pieces[k]
            if (x := old.get(p)) is not None:
                new[p] = ids[k] = x
                continue
            stem, tail = self._parts(p)
            places.append(k), stems.append(stem), tails.append(tail)
            for c in (stem, tail) if tail else (stem,):
                if c is p or c not in new and c not in old:
                    unseen.add(c)
        if unseen:
            self._learn(unseen)
        for k, stem, tail in zip(places, stems, tails, strict=True):
            x = new[stem] if stem in new else old[stem]
            ids[k] = new[pieces[k]] = x + (new[tail] if tail in new else old[tail]) if tail else x
        return _gathered(ids, numbered.indices.to_numpy(), pc.list_value_length(split).to_pylist())

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]


def encoder(path: str) -> Encoder:
    return kept(("tokens", path), lambda: Encoder(path))


class Writer:
    """One seekable file."""

    def __init__(self, path: str):
        self.path, (fs, at) = path, pa.fs.FileSystem.from_uri(path)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.out, self.table, self.ids, self.bytes = fs.open_output_stream(at, compression=None), [], [], 0
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, raw: bytes) -> None:
        frame = self.zip.compress(raw)
        self.out.write(frame)
        self.table.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(struct.pack("<qB", doc_id or 0, doc_id is not None))
        self.bytes += len(frame)

    def close(self) -> None:
        ids, seek = b"".join(self.ids), b"".join(self.table)
        self.out.write(struct.pack("<II", IDS_MAGIC, len(ids)) + ids)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(seek) + 9) + seek + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE_MAGIC))
        self.out.close()


class Reader:
    """Random access to one seekable file; every frame's checksum is checked on reading."""

    def __init__(self, path: str):
        fs, at = pa.fs.FileSystem.from_uri(path)
        self.file, size = fs.open_input_file(at), fs.get_file_info(at).size
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags != 0x80:
            raise ValueError(f"{path}: no seek table")
        start = size - 9 - 12 * n - 8
        raw = self.file.read_at(12 * n + 8, start)
        if struct.unpack("<II", raw[:8]) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError(f"{path}: the seek table is broken")
        self.table = np.frombuffer(raw, "<u4", offset=8).reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        ids = self.file.read_at(9 * n, start - 9 * n)
        marked = np.frombuffer(ids, np.dtype([("id", "<i8"), ("there", "u1")]))
        self.ids = [int(i) if t else None for i, t in zip(marked["id"], marked["there"], strict=True)]
        self.zip = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.table)

    def frame(self, k: int, data: bytes | None = None) -> bytes:
        size, raw_size, check = (int(x) for x in self.table[k])
        raw = self.zip.decompress(self.file.read_at(size, int(self.at[k])) if data is None else data, max_output_size=max(1, raw_size))
        if len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} fails its checksum")
        return raw

    def frames(self) -> Iterator[bytes]:
        """All frames in order, read in runs of about 8 MB."""
        k = 0
        while k < len(self):
            stop = max(k + 1, int(np.searchsorted(self.at, self.at[k] + (8 << 20))))
            stop = min(stop, len(self))
            data = self.file.read_at(int(self.at[stop] - self.at[k]), int(self.at[k]))
            for i in range(k, stop):
                yield self.frame(i, data[int(self.at[i] - self.at[k]) : int(self.at[i + 1] - self.at[k])])
            k = stop


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs and write seekable files to folder in ascending id order; returns the manifest (part, seq, path, docs, tokens), staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part, seq, w, docs_, tokens = encoder(tokenizer), struct.pack("<I", end_id), TaskContext.get().partitionId(), 0, None, 0, 0

        def closed() -> pa.RecordBatch:
            w.close()
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": w.path, "docs": docs_, "tokens": tokens}], schema=MANIFEST)

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_batch(b.column(1)), strict=True):
                if w is None:
                    w, docs_, tokens = Writer(f"{folder}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tok.zst"), 0, 0
                raw = ids + end
                w.add(doc_id, raw)
                docs_, tokens = docs_ + 1, tokens + len(raw) // 4
                if w.bytes >= FILE_BYTES:
                    yield closed()
                    w, seq = None, seq + 1
        if w is not None:
            yield closed()

    # Ranges go by the head of the text, too, so that rows of one id, or without one, aren't a single task.
    small_batches(docs.sparkSession, 1024)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stage(rows.mapInArrow(run, "part int, seq int, path string, docs long, tokens long"), "manifest")


MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the manifest's files; start counts the ids of all documents before it."""
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(order), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r, rows = Reader(path), []
                for doc_id, raw in zip(r.ids, r.frames(), strict=True):
                    rows.append({"doc_id": doc_id, "start": base, "n_tokens": len(raw) // 4, "ids_crc32": zlib.crc32(raw)})
                    base += len(raw) // 4
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=DIGEST)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=DIGEST)

    files = max(1, manifest.count())
    return placed.select("path", "base").repartition(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, wanted: list[int]) -> DataFrame:
    """(doc_id, ids) of the wanted documents; only their frames are decompressed."""
    ids = frozenset(wanted)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                r = Reader(path)
                rows = [{"doc_id": d, "ids": np.frombuffer(r.frame(k), "<u4").tolist()} for k, d in enumerate(r.ids) if d in ids]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)

    return manifest.select("path").mapInArrow(run, "doc_id long, ids array<bigint>")


def op2_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text is an empty one: it has the end id alone. Rows sharing an id follow each other, by text; a null id comes first. No documents, no files, no rows."""
    import public_tokenizers

    manifest = write_tokens(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return read_digests(manifest)
