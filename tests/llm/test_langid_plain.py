"""Language predictions against the definition in plain loops: bind three permuted letter vectors, bundle, add up prototypes, take cosines."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import langid

SF = "/root/testdata/sf0.001"


def symbol(ch):
    return 0 if not ch.isalpha() else ord(ch) - 96 if "a" <= ch <= "z" else 27 + ord(ch) % 37


@lru_cache(None)
def gram(a, b, c):
    v = langid.letters()[2].astype(np.int64)
    out = np.empty(langid.DIM, np.int64)
    for i in range(langid.DIM):
        out[i] = v[a, (i - 2) % langid.DIM] * v[b, (i - 1) % langid.DIM] * v[c, i]
    return out


def bundle(text):
    seen = []
    for ch in f" {(text or '').lower()} ":
        s = symbol(ch)
        if s or not seen or seen[-1]:
            seen.append(s)
    counts = {}
    for t in zip(seen, seen[1:], seen[2:], strict=False):
        if any(t):
            counts[t] = counts.get(t, 0) + 1
    return sum((n * gram(*t) for t, n in counts.items()), np.zeros(langid.DIM, np.int64))


def test_predictions_by_definition(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    long = " ".join(r[1] for r in rows if r[2] == rows[0][2]) * 3
    odd = [(10_000, None, "en"), (10_001, "", "en"), (10_002, "12 ... !", "en"), (10_003, long, None), (10_004, rows[0][1], rows[0][2]), (10_004, rows[0][1], rows[0][2]), (None, rows[1][1], "zz"), (10_005, "a", None), (10_006, "Ωμέγα", None), (10_007, rows[2][1], "twin1")]
    docs = spark.createDataFrame([(*r, "x", 0.0) for r in rows + odd], "doc_id long, text string, lang string, p string, score double")
    protos = {}
    for i, text, lang in rows + odd:
        if i is not None and lang is not None and text is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            protos[lang] = protos.get(lang, 0) + bundle(text)
    protos = {k: v / np.linalg.norm(v) for k, v in sorted(protos.items()) if np.linalg.norm(v) > 0}
    names, found = langid.model_of(docs)
    assert [n for n, p in zip(names, found, strict=True) if p.any()] == list(protos)
    assert all(np.allclose(found[names.index(k)], v, atol=1e-4) for k, v in protos.items())
    got = docs.select("doc_id", "text", langid.identified(F.col("text"), (names, found)).alias("q")).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        v = bundle(r["text"])
        n = np.linalg.norm(v)
        cos = {k: float(v @ p / n) if n else 0.0 for k, p in protos.items()}
        best = max(cos.values())
        assert abs(r["q"]["score"] - max(0.0, best)) < 1e-4
        assert (r["q"]["lang_pred"] == langid.UNKNOWN) if not n else cos[r["q"]["lang_pred"]] > best - 1e-4
