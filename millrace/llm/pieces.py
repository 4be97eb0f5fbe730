"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi.

The automaton reads a text once. At each position the output links of its state name all pieces that end
there, longest first, and each relaxes the best score of the position; ties keep the longer piece. The
encoding is the segmentation of the highest total score. A model file of merges holds their ranks in place of scores; a sum of ranks says
nothing, so a piece of rank r scores -log(r + 2), its log probability by Zipf's law up to a constant. A character that no piece covers costs more than any
piece and becomes byte pieces, so every text decodes to itself. Blanks become U+2581, with one put in front;
a literal U+2581 in a text is kept by byte pieces.

If no piece holds U+2581 after another character, the best segmentation of a text is the best ones of its
blank-led words put together, so words are encoded once and kept in a bounded cache. Words of the common
characters go through the automaton together, a column of characters at a time; others one by one.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, small_batches, table

BLANK, DENSE_BELOW, CACHE = "▁", 0x100, 120_000
#: Words that go through the automaton together: so many, and so many cells of words by width; longer words than LONG go one by one.
BLOCK, CELLS, LONG = 4096, 1_000_000, 4096


def ranked(scores: list[float], last: float = -1e8) -> bool:
    """Whether a model's scores are the ranks of merges (0, -1, -2, …; under `last` of pieces that no merge makes) and not logarithms of probabilities."""
    merged = [s for s in scores if s > last]
    return len(merged) > 1 and all(s <= 0 and s == int(s) for s in merged) and len(set(merged)) == len(merged)


class Pieces:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str, cache: int = CACHE):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.words = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if ranked([s for _, s in self.words.values()]):
            self.words = {p: (i, -math.log(2.0 + min(-s, n))) for p, (i, s) in self.words.items()}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = min(s for _, s in self.words.values()) - 10.0
        self.raw = [sp.id_to_piece(i).replace(BLANK, " ").encode() if sp.id_to_piece(i) in self.words else b"" for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([b])
        self.splits = not any(BLANK in p.lstrip(BLANK) for p in self.words)
        self.lines = not any("\n" in p for p in self.words)
        self.all = ahocorasick.Automaton()
        for p, (i, s) in self.words.items():
            self.all.add_word(p, (len(p), s, i))
        self.all.make_automaton()
        self._dense()
        self.size, self.new, self.old = cache, {}, {}

    def _dense(self) -> None:
        """Full transition table over the common characters, for the pieces made of them only."""
        common = [p for p in self.words if all(ord(c) < DENSE_BELOW or c == BLANK for c in p)]
        chars = sorted({c for p in common for c in p})
        self.cls = np.zeros(0x110000, np.uint8 if len(chars) < 255 else np.uint16)
        for k, c in enumerate(chars, 1):
            self.cls[ord(c)] = k
        self.common = np.zeros(0x110000, bool)
        self.common[:DENSE_BELOW] = True
        self.common[ord(BLANK)] = True
        kids, ends = [{}], [-1]
        for p in common:
            at = 0
            for c in p:
                k = int(self.cls[ord(c)])
                if k not in kids[at]:
                    kids[at][k] = len(kids)
                    kids.append({})
                    ends.append(-1)
                at = kids[at][k]
            ends[at] = self.words[p][0]
        step = np.zeros((len(kids), len(chars) + 1), np.int32)
        fail, longest, shorter = [0] * len(kids), [0] * len(kids), [0] * len(kids)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            if at:
                step[at] = step[fail[at]]
                shorter[at] = longest[fail[at]]
                longest[at] = at if ends[at] >= 0 else shorter[at]
            for k, kid in kids[at].items():
                fail[kid] = int(step[fail[at], k]) if at else 0
                queue.append(kid)
            for k, kid in kids[at].items():
                step[at, k] = kid
        self.step, self.longest, self.shorter = step, np.array(longest), np.array(shorter)
        by_id = {i: (len(p), s) for p, (i, s) in self.words.items()}
        self.end_id = np.array(ends)
        self.end_len = np.array([by_id[i][0] if i >= 0 else 0 for i in ends])
        self.end_score = np.array([by_id[i][1] if i >= 0 else 0.0 for i in ends])

    def _bytes(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]

    def segment_one(self, word: str, literal: frozenset[int] = frozenset()) -> list[int]:
        """Best ids of a normalised word; positions in literal are characters that only bytes may cover."""
        best, size_at, id_at = array("d", [0.0]), array("i", [0]), array("i", [-1])
        found = self.all.iter(word)
        hit = next(found, None)
        for end in range(len(word)):
            top, back, hits = best[end] + self.unknown, (1, -1), []
            while hit is not None and hit[0] == end:
                hits.append(hit[1])
                hit = next(found, None)
            for size, score, i in sorted(hits, reverse=True):
                if best[end + 1 - size] + score > top and not literal.intersection(range(end + 1 - size, end + 1)):
                    top, back = best[end + 1 - size] + score, (size, i)
            best.append(top)
            size_at.append(back[0])
            id_at.append(back[1])
        ids, at = array("i"), len(word)
        while at:
            ids.extend([id_at[at]] if id_at[at] >= 0 else reversed(self._bytes(word[at - 1])))
            at -= size_at[at]
        ids.reverse()
        return ids.tolist()

    def segment(self, words: list[str]) -> list[bytes]:
        """Best ids of many normalised words of common characters without literal blanks, as little-endian 32-bit integers."""
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        out: list[bytes] = [b""] * len(words)
        b = 0
        while b < len(order):
            a, b = b, b + 1
            while b < len(order) and b - a < BLOCK and (b + 1 - a) * len(words[order[b]]) <= CELLS:
                b += 1
            some = order[a:b]
            lens = np.array([len(words[k]) for k in some])
            width = int(lens[-1])
            if width == 0:
                continue
            codes = np.frombuffer("".join(words[k] for k in some).encode("utf-32-le"), "<u4")
            at = np.arange(width)[None, :] < lens[:, None]
            cls = np.zeros((len(some), width), self.cls.dtype)
            cls[at] = self.cls[codes]
            best = np.full((len(some), width + 1), -np.inf)
            best[:, 0] = 0.0
            size, piece = np.ones((len(some), width + 1), np.int16), np.full((len(some), width + 1), -1, np.int32)
            state = np.zeros(len(some), np.int64)
            for t in range(width):
                first = int(np.searchsorted(lens, t, side="right"))
                state[first:] = self.step[state[first:], cls[first:, t]]
                best[first:, t + 1] = best[first:, t] + self.unknown
                out_state = self.longest[state[first:]]
                rows = np.flatnonzero(out_state) + first
                link = out_state[rows - first]
                while len(rows):
                    score = best[rows, t + 1 - self.end_len[link]] + self.end_score[link]
                    more = score > best[rows, t + 1]
                    r, e = rows[more], link[more]
                    best[r, t + 1], size[r, t + 1], piece[r, t + 1] = score[more], self.end_len[e], self.end_id[e]
                    link = self.shorter[link]
                    rows, link = rows[link > 0], link[link > 0]
            ids, pos, n = np.zeros((len(some), width), "<i4"), lens.copy(), np.zeros(len(some), np.int64)
            rows = np.flatnonzero(lens)
            bad = np.zeros(len(some), bool)
            while len(rows):
                got = piece[rows, pos[rows]]
                bad[rows] |= got < 0
                ids[rows, width - 1 - n[rows]] = got
                n[rows] += 1
                pos[rows] -= size[rows, pos[rows]]
                rows = rows[pos[rows] > 0]
            raw = ids.tobytes()
            for k, (w, c) in enumerate(zip(some, n.tolist(), strict=True)):
                out[w] = raw[4 * ((k + 1) * width - c) : 4 * (k + 1) * width]
                if bad[k]:
                    out[w] = self._with_bytes(words[w], out[w])
        return out

    def _with_bytes(self, word: str, raw: bytes) -> bytes:
        """Put byte pieces in the place of the -1 that stand for single characters."""
        ids, at = [], 0
        for i in np.frombuffer(raw, "<i4").tolist():
            if i < 0:
                ids += self._bytes(word[at])
                at += 1
            else:
                ids.append(i)
                at += len(self.raw[i].decode())
        return np.array(ids, "<i4").tobytes()

    def _learn(self, keys: set[str]) -> None:
        """Keys: a word led by one blank, without it; NUL and a word without blank; or a run of blanks and a word."""
        plain, texts = [], []
        for k in keys:
            body = k[1:] if k[:1] == "\0" else k if k[:1] == " " else " " + k
            if BLANK in body or len(body) > LONG:
                literal = frozenset(i for i, c in enumerate(body) if c == BLANK)
                self.new[k] = np.array(self.segment_one(body.replace(" ", BLANK), literal), "<i4").tobytes()
            elif body.isascii() or self.common[np.frombuffer(body.encode("utf-32-le", "surrogatepass"), "<u4")].all():
                plain.append(k)
                texts.append(body.replace(" ", BLANK))
            else:
                self.new[k] = np.array(self.segment_one(body.replace(" ", BLANK)), "<i4").tobytes()
        self.new.update(zip(plain, self.segment(texts), strict=True))

    def _words(self, text: str) -> list[str]:
        if "  " not in text and text[0] != " ":
            return text.split(" ")
        words: list[str] = []
        for w in text.split(" "):  # an empty piece is a blank more for the next word
            if words and not words[-1].strip(" "):
                words[-1] = (words[-1] or " ") + " " + w
            else:
                words.append(w)
        return words

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; none for null or empty."""
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
        out: list = [b""] * len(texts)
        todo, missing = [], set()
        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.splits or "\0" in text:
                body = " " + text
                literal = frozenset(i for i, c in enumerate(body) if c == BLANK)
                out[k] = np.array(self.segment_one(body.replace(" ", BLANK), literal), "<i4").tobytes()
                continue
            todo.append((k, words := self._words(text)))
            missing.update(words)
        missing.difference_update(self.new)
        known = {w: self.old[w] for w in missing if w in self.old} if self.old else {}
        self.new.update(known)
        missing.difference_update(known)
        if missing:
            lines = {w: [x if k == 0 else "\0" + x for k, x in enumerate(w.split("\n"))] for w in missing if "\n" in w} if self.lines else {}
            self._learn({x for w in missing for x in lines.get(w, (w,)) if x not in self.new})
            end = np.array(self._bytes("\n"), "<i4").tobytes()
            self.new.update({w: end.join(map(self.new.__getitem__, parts)) for w, parts in lines.items()})
        for k, words in todo:
            out[k] = b"".join(map(self.new.__getitem__, words))
        return out

    def encode_bytes(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def pieces(path: str) -> Pieces:
    return kept(("pieces", path), lambda: Pieces(path))


def encoded(text: Column, model: str) -> Column:
    """Column of array<int>: the ids of a text; empty for null or empty texts."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = pieces(model)
        for texts in batches:
            yield pd.Series([np.frombuffer(r, "<i4") for r in p.encode_batch(texts.tolist())])

    return of(text)


def decoded(ids: Column, model: str) -> Column:
    """Column of strings: the text of ids; null for null."""

    @F.pandas_udf(T.StringType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = pieces(model)
        for lists in batches:
            yield pd.Series([None if x is None else p.decode(list(x)) for x in lists])

    return of(ids)


def checked(text: Column, model: str) -> Column:
    """struct(ids, exact): a text's ids, and whether they decode to it; one pass, so one model to a task. Null counts as empty."""
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])

    @F.pandas_udf(kind)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = pieces(model)
        for texts in batches:
            ids = [np.frombuffer(r, "<i4") for r in p.encode_batch(texts.tolist())]
            yield pd.DataFrame({"ids": ids, "exact": [p.decode(i.tolist()) == (t or "") for i, t in zip(ids, texts, strict=True)]})

    return of(text)


def digested(text: Column, model: str) -> Column:
    """struct(n_pieces, ids_crc32, exact): the encoding's length and unsigned crc32, and whether decoding it gives the text back."""
    kind = T.StructType([T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("exact", T.BooleanType())])

    @F.pandas_udf(kind)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = pieces(model)
        for texts in batches:
            raw = p.encode_batch(texts.tolist())
            back = [p.decode(np.frombuffer(r, "<i4").tolist()) == (t or "") for r, t in zip(raw, texts, strict=True)]
            yield pd.DataFrame({"n_pieces": [len(r) // 4 for r in raw], "ids_crc32": [zlib.crc32(r) for r in raw], "exact": back})

    return of(text)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, repeated ones too; null and empty texts have no pieces and are exact."""
    import public_tokenizers

    small_batches(spark)
    found = digested(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("d")).select("doc_id", "d.*")
