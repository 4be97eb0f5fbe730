"""Toxicity scores against counts, features, weights and scores worked out in plain loops; repeated ids and labels, nulls and extra columns."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np

from millrace.llm import toxicity


def plain_counts(texts):
    place = lambda c: 27 if ord(c) > 127 else ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalnum() else 0
    out = np.zeros(28**3, np.int64)
    for t in texts:
        s = [0, 0, *map(place, (t or "").lower()), 0]
        for x, y, z in zip(s, s[1:], s[2:], strict=False):
            out[((0 if y == 0 else x) * 28 + y) * 28 + z] += 1
    return out


def test_scores(spark):
    r = random.Random(8)
    mild, rude = [f"{a}{b}" for a in ("garden", "river", "table") for b in "aeiou"], ["vilerat", "dolt", "scumbag"]
    rows, marks = [], []
    for k in range(400):
        toxic = k % 2
        said = [r.choice(mild) for _ in range(8)] + ([r.choice(rude)] if toxic or r.random() < 0.1 else [])
        rows.append((k, " ".join(r.sample(said, len(said)))))
        marks.append((k, toxic))
    rows += [(5, "aa dolt"), (None, "dolt"), (900, None), (901, ""), (902, "d0lt"), (903, "é" * 3000 + " vilerat")]
    marks += [(4, 1), (4, 0), (7, 1), (7, None), (None, 1), (8000, 1)]
    docs = spark.createDataFrame([(*x, 1, 2.0, "f") for x in rows], "doc_id long, text string, y int, score double, f string")
    labels = spark.createDataFrame([(*x, "t") for x in marks], "doc_id long, toxic int, text string")

    counts = plain_counts([t for _, t in rows])
    assert (toxicity.trigram_counts(docs)[1:] == counts[1:]).all()  # but for edges alone, which joined texts have more of
    index, w, b = toxicity.fit(docs, labels, counts)

    label = {}
    for i, y in marks:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            label[i] = max(y, label.get(i, 0))
    drawn = {}
    for i, t in rows:
        if i in label:
            drawn[i] = min(t, drawn.get(i, t))
    scorer = toxicity.Scorer(counts)
    has = {i: scorer.features(t) for i, t in drawn.items()}
    pos, neg = (sum(label[i] == y for i in drawn) for y in (1, 0))
    assert pos >= neg  # so that features are tried on all rows
    value = {}
    for f in set().union(*has.values()):
        p, n = sum(f in x and label[i] for i, x in has.items()), sum(f in x for x in has.values())
        odds = math.log((p + 0.5) / (pos + 1) / ((n - p + 0.5) / (neg + 1)))
        if p >= toxicity.LEAST and odds > 0.7:
            value[f] = odds / math.sqrt(1 / (p + 0.5) + 1 / (n - p + 0.5))
    want = sorted(value, key=lambda f: (-round(value[f], 9), f))
    assert {"=vilerat", "=dolt", "=scumbag"} <= set(want) and sorted(index, key=index.get) == want

    ids = sorted(drawn)
    x = np.array([[f in has[i] for f in want] + [True] for i in ids], float)
    y, ridge, u = np.array([label[i] for i in ids], float), np.diag([0.5] * len(want) + [0.0]), np.zeros(len(want) + 1)
    for _ in range(50):
        s = 1 / (1 + np.exp(-x @ u))
        u -= np.linalg.solve(x.T @ (x * (s * (1 - s))[:, None]) + ridge, x.T @ (s - y) + ridge @ u)
    assert np.abs(np.append(w, b) - u).max() < 2e-3

    got = docs.select("doc_id", "text", toxicity.scored(docs["text"], counts, (index, w, b)).alias("s")).collect()
    assert len(got) == len(rows)
    for g in got:
        z = b + sum(w[index[f]] for f in scorer.features(g["text"]) if f in index)
        assert abs(g["s"] - 1 / (1 + math.exp(-z))) < 1e-12
    by = {g["doc_id"]: g["s"] for g in got}
    assert by[900] == by[901] == 1 / (1 + math.exp(-b)) and by[902] > 0.5 and by[903] > 0.5
