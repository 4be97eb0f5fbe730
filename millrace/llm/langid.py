"""Language ID with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram binds its letters: the elementwise product of the first
letter's vector permuted twice (rolled by two), the second's permuted once and the third's as it is. A text is the bundle (sum) of
its trigrams, a language the bundle of its training texts, and the prediction is the language whose prototype
has the highest cosine with the text. Letters other than a-z share 37 further vectors by code point; what is
not a letter is a blank, and runs of blanks are one. Whole texts count, however long.
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

from .common import fold, groups, kept, small_batches, table

DIM, SEED, SYMBOLS = 1024, 7, 64
#: Bound of the training sample: texts a language.
PER_LANG = 4000
#: Cosines under this are those of unrelated vectors of DIM signs: three standard deviations.
CHANCE = 3 / DIM**0.5
UNKNOWN = "und"


@lru_cache(1)
def symbols() -> np.ndarray:
    """Code point -> symbol: 0 for no letter, 1-26 for a-z, 27-63 for other letters."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + c % 37
    return out


@lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter vectors permuted twice, once and not."""
    v = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIM))
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram, count): distinct trigrams of each text, a trigram being three symbols in base 64."""
    joined = [" " + t.lower() + " " if t else "  " for t in texts]
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), "<u4")
    s = symbols()[codes].astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in joined])
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0) | (doc[1:] != doc[:-1])
    s, doc = s[keep], doc[keep]
    gram = s[:-2] * 4096 + s[1:-1] * 64 + s[2:]
    same = (doc[:-2] == doc[2:]) & (gram > 0)
    key, n = np.unique(doc[:-2][same] << 18 | gram[same], return_counts=True)
    return key >> 18, key & (1 << 18) - 1, n


def bound(grams: np.ndarray) -> np.ndarray:
    a, b, c = letters()
    return (a[grams >> 12] * b[grams >> 6 & 63] * c[grams & 63]).astype(np.float32)


def bundles(texts: list[str | None]) -> np.ndarray:
    doc, gram, n = trigrams(texts)
    used, at = np.unique(gram, return_inverse=True)
    out = np.zeros((len(texts), DIM), np.float32)
    for k in range(0, len(used), 4096):  # bounded memory for many scripts
        here = (at >= k) & (at < k + 4096)
        counts = np.zeros((len(texts), min(4096, len(used) - k)), np.float32)
        counts[doc[here], at[here] - k] = n[here]
        out += counts @ bound(used[k : k + 4096])
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) from up to about PER_LANG texts of each language; without labels, no languages. A row a language comes to the driver."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("l IS NOT NULL AND t IS NOT NULL")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy("l").collect()}
    if not sizes:
        return [], np.zeros((0, DIM), np.float32)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, PER_LANG / n))])[F.col("l")]
    drawn = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(1 << 24)) < share * (1 << 24)).select("t", "l")
    out = pa.schema([("l", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b.column(1).to_pylist(), b.column(0).to_pylist()
            for start, stop in groups(texts):
                names = sorted(set(langs[start:stop]))
                doc, gram, n = trigrams(texts[start:stop])
                code = np.array([names.index(x) for x in langs[start:stop]], np.int64)[doc]
                key, at = np.unique(code << 18 | gram, return_inverse=True)
                total = np.bincount(at, n, len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in (key >> 18).tolist()]), pa.array((key & (1 << 18) - 1).astype(np.int32)), pa.array(total)], schema=out)

    found = drawn.mapInArrow(run, "l string, gram int, n long").groupBy("l", "gram").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["l"].unique())
    protos = np.zeros((len(names), DIM), np.float32)
    for k, name in enumerate(names):
        part = found[found["l"] == name]
        for i in range(0, len(part), 4096):
            protos[k] += part["n"].to_numpy(np.float32)[i : i + 4096] @ bound(part["gram"].to_numpy(np.int64)[i : i + 4096])
        protos[k] /= max(1.0, float(np.linalg.norm(protos[k])))
    return names, protos


def identified(text: Column, model: tuple[list[str], np.ndarray]) -> Column:
    """struct(lang_pred, score): the nearest language and its cosine, cut at 0; `und` and 0 for null, letterless texts, or without languages. Of languages at one cosine the first by name."""
    names, protos = model
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kept("langid", lambda: None)  # lets go of an earlier operator's model
        for texts in batches:
            part = []
            whole = texts.tolist()
            for start, stop in groups(whole):
                v = bundles(whole[start:stop])
                norm = np.linalg.norm(v, axis=1)
                if not names:
                    part.append(pd.DataFrame({"lang_pred": [UNKNOWN] * len(v), "score": 0.0}))
                    continue
                cos = v @ protos.T / np.maximum(norm, 1e-9)[:, None]
                best = cos.argmax(axis=1)
                pred = [names[i] if x > 0 else UNKNOWN for i, x in zip(best, norm, strict=True)]
                part.append(pd.DataFrame({"lang_pred": pred, "score": np.where(norm > 0, np.clip(cos.max(axis=1), 0, 1), 0).astype(float)}))
            yield pd.concat(part) if part else pd.DataFrame({"lang_pred": [], "score": []})

    return of(text)


def lettered(text: Column) -> Column:
    """Column of booleans: whether a text has a letter, and so a trigram; false for null and empty texts."""

    @F.pandas_udf(T.BooleanType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([any(map(str.isalpha, t)) if t else False for t in texts], dtype=bool)

    return of(text)


def model_of(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Trained on the documents outside the held-out fold."""
    return train(docs.where(fold(F.col("doc_id"), 3) != 1))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, repeated ones too; a null doc_id is never trained on and not held out."""
    docs = table(spark, sf_dir, "documents")
    found = identified(F.col("text"), model_of(docs))
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), found.alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
