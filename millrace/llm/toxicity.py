"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over all texts. A word that may be disguised (look-alike digits and
signs between letters, runs of three or more of a letter, single letters set apart by blanks or marks) becomes
a lattice: what each sign may stand for, one or two letters for a run, joined or apart at each gap. Viterbi
finds the path of the best channel and language score, and the restored words take the place of the
disguised ones. Other words have one path only and stay. Presence of restored words and of their beginnings
feeds a logistic regression, fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, groups, kept, small_batches, stage, table

#: What a sign may stand for besides itself.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "#": "h", "*": "aeiou",
}
SIGN_COST, KEEP_COST, RUN_COST, GAP_COST = -1.0, -6.0, -1.0, -1.0
#: Bounds of the fit: labelled rows drawn, features tried and kept, rows of label 1 a feature must be in.
LABELLED, TRIED, FEATURES, LEAST = 10_000, 20_000, 3_000, 3
#: Words kept by a scorer; a tenth while features are names.
PREFIXES, CACHE = (2, 3, 4, 5, 6, 7), 120_000

_MARKS = "".join(re.escape(c) for c in LOOKALIKES)
_CORE = re.compile(r"[^\W_]+")
_SIGNS = re.compile(rf"[{_MARKS}]")
_RUN = re.compile(r"([^\W\d_])\1\1")
_DOTTED = re.compile(r"(?:[^\W_][._\-*~]+){2,}[^\W_]")
_EDGES = ".,;:?\"'`)]}<>/\\&%~=^{["


def symbol(c: str) -> int:
    """0 for a word's edge, 1-26 for a-z, 27 for anything else."""
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27


class Channel:
    """Restores words under a trigram model given as 28 x 28 x 28 counts."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(28, 28, 28).astype(float)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1.sum() + 28)
        p2 = (c2 + 20 * p1) / (c2.sum(axis=1, keepdims=True) + 20)
        p3 = (c3 + 20 * p2) / (c3.sum(axis=2, keepdims=True) + 20)
        self.log = np.log(p3).tolist()

    def best(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The best path through a lattice, whose places list (letters, channel cost); blanks in it are word edges."""
        paths: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}  # score and last step; a step is (letters, the step before)
        for place in [*lattice, [(" ", 0.0)]]:
            after: dict[tuple[int, int], tuple] = {}
            for (a, b), (score, step) in paths.items():
                for letters, cost in place:
                    x, y, s = a, b, score + cost
                    for c in letters:
                        z = symbol(c)
                        s += self.log[x][y][z]
                        x, y = (0, 0) if z == 0 else (y, z)
                    if (x, y) not in after or s > after[x, y][0]:
                        after[x, y] = (s, (letters, step))
            paths = after
        out, step = [], max(paths.values(), key=lambda p: p[0])[1]
        while step:
            out.append(step[0])
            step = step[1]
        return "".join(reversed(out))[:-1]

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        out, k = [], 0
        while k < len(word):
            c, run = word[k], 1
            while k + run < len(word) and word[k + run] == c:
                run += 1
            stands = [(x, SIGN_COST) for x in LOOKALIKES.get(c, "")]
            if c.isalpha():
                out += [[(c, 0.0), (c + c, RUN_COST)]] if run > 2 else [[(c, 0.0)]] * run
            else:
                out += [[*stands, (c, KEEP_COST)]] * min(run, 2 if run > 2 else run)
            k += run
        return out

    def restore(self, word: str) -> list[str]:
        """The words that one blank-separated, lower-case piece stands for."""
        core = word.lstrip(_EDGES).rstrip(_EDGES + "!")
        run = _RUN.search(core)
        if not run and core.isalpha():
            return [core]
        if _DOTTED.fullmatch(core):
            return self.spaced(_CORE.findall(core) if "*" not in core else [c for c in core if c not in "._-~*"])
        if (run or _SIGNS.search(core)) and any(map(str.isalpha, core)):
            return _CORE.findall(self.best(self.lattice(core)))
        return _CORE.findall(core)

    def spaced(self, letters: list[str]) -> list[str]:
        """The words that single letters set apart stand for."""
        lattice: list = []
        for k, c in enumerate(letters):
            gap = [[("", 0.0), (" ", GAP_COST)]] if k else []
            lattice += [*gap, *self.lattice(c)]
        return self.best(lattice).split()


def single_runs(words: list[str]) -> tuple[list[str], list[list[str]]]:
    """words without the runs of three or more single characters, and those runs, however long."""
    if sum(len(w) == 1 for w in words) < 3:
        return words, []
    rest, runs, run = [], [], []
    for w in [*words, ""]:
        if len(w) == 1 and (w.isalnum() or w in LOOKALIKES):
            run.append(w)
            continue
        if len(run) > 2:
            runs.append(run)
        else:
            rest += run
        run = []
        if w:
            rest.append(w)
    return rest, runs


def features_of(word: str) -> list[str]:
    return ["=" + word, *[word[:k] for k in PREFIXES if k < len(word)]]


class Scorer:
    """Features of texts by word, kept for each distinct word in a bounded cache."""

    def __init__(self, counts: np.ndarray, index: dict[str, int] | None = None):
        self.channel, self.index, self.kept = Channel(counts), index, {}

    def _of(self, words: list[str]) -> tuple:
        found = [f for w in words for f in features_of(w)]
        return tuple(found if self.index is None else [self.index[f] for f in found if f in self.index])

    def features(self, text: str | None) -> set:
        """Features of a text, or the indices of those that the index has."""
        words, runs = single_runs(text.lower().split() if text else [])
        words = set(words)
        if len(self.kept) > (CACHE // 10 if self.index is None else CACHE):
            self.kept = {}
        for w in words.difference(self.kept):
            self.kept[w] = self._of(self.channel.restore(w))
        out = set().union(*map(self.kept.__getitem__, words))
        for run in runs:
            out.update(self._of(self.channel.spaced(run)))
        return out


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character trigrams over all texts; no more than 28^3 rows leave the tasks together."""
    small_batches(docs.sparkSession)
    out = pa.schema([("gram", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.full(0x110000, 27, np.uint8)
        table_[:128] = [0 if not chr(c).isalnum() else symbol(chr(c)) for c in range(128)]
        total = np.zeros(28**3, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for start, stop in groups(texts):
                text = "  ".join(t.lower() for t in texts[start:stop] if t)
                s = table_[np.frombuffer(f"  {text} ".encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int32)
                first = np.where(s[1:-1] == 0, 0, s[:-2])  # a word's first letter follows two edges
                total += np.bincount((first * 28 + s[1:-1]) * 28 + s[2:], minlength=28**3)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], schema=out)

    found = docs.select(text_col).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(28**3, np.int64)
    counts[found["gram"].to_numpy()] = found["n"].to_numpy()
    return counts


def regression(rows: list[np.ndarray], y: np.ndarray, n: int, penalty: float = 0.5, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression on sparse 0/1 rows, by accelerated gradient steps."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([np.empty(0, np.int64), *rows])
    w, v = np.zeros(n + 1), np.zeros(n + 1)
    hess = 0.25 * np.bincount(col, minlength=n) + penalty
    scale = np.concatenate([1.0 / hess, [1.0 / max(1.0, 0.25 * len(rows))]])
    for k in range(steps):
        u = w + k / (k + 3) * (w - v) if k else w
        z = np.bincount(at, u[col], len(rows)) + u[n]
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.concatenate([np.bincount(col, g[at], n) + penalty * u[:n], [g.sum()]])
        w, v = u - 0.25 * scale * grad, w
    return w[:n], float(w[n])


def fit(docs: DataFrame, labels: DataFrame, counts: np.ndarray) -> tuple[dict[str, int], np.ndarray, float]:
    """(feature -> index, weights, intercept) from up to about LABELLED labelled ids outside the held-out fold; without both labels, no features.

    An id labelled both 0 and 1 counts as 1; of an id's texts the least counts.
    """
    known = labels.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("y")).where("i IS NOT NULL AND y IN (0, 1)").where(fold(F.col("i"), 5) != 0)
    known = known.groupBy("i").agg(F.max("y").alias("y"))
    share = min(1.0, LABELLED / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("i"), F.lit(1 << 24)) < share * (1 << 24))
    rows = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t")).join(known, "i")

    def featured(index: dict[str, int] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(counts, index)
            for b in batches:
                found = [sorted(scorer.features(t)) for t in b.column("t").to_pylist()]
                kind = pa.list_(pa.string() if index is None else pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(found, kind)], names=["y", "f"])

        return run

    def ranked(found: DataFrame, pos: int, neg: int, most: int) -> list:
        """The features most typical of label 1 in rows (y, f), by the z value of their log odds."""
        found = found.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).where(F.col("p") >= LEAST)
        p, q = (F.col("p") + 0.5) / (pos + 1), (F.col("n") - F.col("p") + 0.5) / (neg + 1)
        var = 1 / (F.col("p") + 0.5) + 1 / (F.col("n") - F.col("p") + 0.5)
        best = found.withColumn("z", F.log(p / q) / F.sqrt(var)).where(F.log(p / q) > 0.7).orderBy(F.desc("z"), "f").limit(most)
        return [r["f"] for r in best.collect()]

    # One text an id, the least: a repeated id doesn't swell the sample.
    drawn = stage(rows.groupBy("i", "y").agg(F.min("t").alias("t")), "labelled")
    sizes = {r["y"]: r["n"] for r in drawn.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return {}, np.zeros(0), -5.0 if not pos else 5.0
    # Features are first tried on as many rows of label 0 as of label 1, then counted on all that were drawn.
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    even = min(1.0, pos / neg)
    few = drawn.where((F.col("y") == 1) | (F.pmod(F.xxhash64("i", F.lit(1)), F.lit(1 << 24)) < even * (1 << 24)))
    tried = ranked(few.select("t", "y").repartition(tasks).mapInArrow(featured(None), "y int, f array<string>"), pos, max(1, round(even * neg)), TRIED)
    full = stage(drawn.select("t", "y").repartition(tasks).mapInArrow(featured({f: k for k, f in enumerate(tried)}), "y int, f array<bigint>"), "features")
    kept = {k: i for i, k in enumerate(ranked(full, pos, neg, FEATURES))}
    wanted = F.array(*map(F.lit, kept)) if kept else F.array().cast("array<int>")
    part = full.select("y", F.array_intersect("f", wanted.cast("array<bigint>")).alias("f")).toPandas()
    w, b = regression([np.array([kept[k] for k in f], np.int64) for f in part["f"]], part["y"].to_numpy(float), len(kept))
    return {tried[k]: i for k, i in kept.items()}, w, b


def scored(text: Column, counts: np.ndarray, model: tuple[dict[str, int], np.ndarray, float]) -> Column:
    """Column of scores from 0 to 1; texts without features, null and empty ones get the intercept's."""
    index, w, b = model
    name = uuid.uuid4().hex

    @F.pandas_udf(T.DoubleType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer, weight = kept(("toxicity", name), lambda: Scorer(counts, index)), w.tolist()
        for texts in batches:
            z = [max(-500.0, b + math.fsum(weight[k] for k in scorer.features(t))) for t in texts]
            yield pd.Series([1 / (1 + math.exp(-x)) for x in z], dtype="float64")

    return of(text)


def score_column(docs: DataFrame, labels: DataFrame) -> Column:
    """Train on docs and labels and return the score of docs.text as a column."""
    counts = trigram_counts(docs)
    return scored(F.col("text"), counts, fit(docs, labels, counts))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, repeated ones too; a null doc_id is never trained on and not held out."""
    docs = table(spark, sf_dir, "documents")
    score = score_column(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
