"""The corpus pipeline against its stages done by hand, and the queries' SQL."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from millrace.llm import catalog, langid, mixing, simhash

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"taken": F.lit(1), "__kept": F.lit(2)})
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns, d, seen = docs.columns, docs, {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        d = spark.createDataFrame(f(spark, d, SF).toPandas(), docs.schema)
        assert d.columns == columns
        seen[name] = Counter(r["doc_id"] for r in d.collect())
        if name == "language_id":
            langs = {r["doc_id"]: r["lang"] for r in d.collect()}
    # Documents that one of the first two stages drops are toxic, or no nearer to a language than chance.
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(texts) - set(seen["toxicity"])
    assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(texts)
    names, protos = langid.model_of(docs.where(F.col("doc_id").isin(list(seen["toxicity"]))))
    for i in seen["toxicity"]:
        v = langid.bundles([texts[i]])[0]
        cos = v @ protos.T / max(1e-9, float(np.linalg.norm(v)))
        assert (i in seen["language_id"]) == (cos.max() >= langid.CHANCE)
        assert i not in seen["language_id"] or langs[i] == names[int(cos.argmax())]
    # One document of each group of near copies stays.
    fps = {i: simhash.simhash(texts[i]) for i in seen["language_id"]}
    low = {i: i for i in fps}
    for _ in fps:
        after = {i: min(low[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 2) for i in fps}
        if after == low:
            break
        low = after
    assert set(seen["simhash"]) == set(low.values()) and set(seen["simhash"].values()) == {1}
    # The mix takes each document as often as the operator says.
    kept = docs.where(F.col("doc_id").isin(list(seen["simhash"])))
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(kept).collect() if r["taken"]}
    assert seen["mixing"] == Counter(times)
    last = corpus_pipeline.STAGES[-1][1](spark, d, SF).collect()
    assert Counter(r["doc_id"] for r in last) == seen["mixing"] and all(r["exact"] and r["n_pieces"] == len(r["ids"]) for r in last)
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == seen["mixing"]


def test_pipeline_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, SF).count() == 0


def test_language_stage(spark):
    """Text in no learned language goes, and a document's own lang neither keeps nor drops it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10**6 + k, t, lang, "s", 0) for k, (t, lang) in enumerate([("Ωμέγα ξψζ ωωξ ψψχ " * 9, "en"), ("123 ... !!", "en"), ("xqzj kvvw zzxq jjkq wvxz qqjx", "de"), (None, "en")])]
    clean = docs.where("length(text) > 200").limit(1).collect()[0]
    odd += [(2 * 10**6 + k, clean["text"], lang, "s", 0) for k, lang in enumerate([None, "de", "xx"])]
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.keep_languages(spark, docs.unionByName(spark.createDataFrame(odd, docs.schema)), SF).collect()}
    assert not set(got) & {x[0] for x in odd[:4]}
    assert len({got[x[0]] for x in odd[4:]}) == 1 and clean["doc_id"] in got
    assert len(got) >= 0.98 * docs.count()


@pytest.mark.parametrize("column, value", [("lang", None), ("doc_id", None), ("lang", "und")])
def test_languages_unknown(spark, column, value):
    """Where no language can be learned, or one has the name of none, all documents with a letter stay."""
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(["a text", "日本", "Ünï 1", "12 !?", "", None, " \n"] * 4)], "doc_id long, text string, lang string, source string")
    got = corpus_pipeline.keep_languages(spark, docs.withColumn(column, F.lit(value).cast(docs.schema[column].dataType)), SF).collect()
    assert Counter(r["text"] for r in got) == {"a text": 4, "日本": 4, "Ünï 1": 4}


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    shown = lambda df: Counter(tuple("" if v is None or str(v) in ("nan", "<NA>", "NaT") else f"{float(v):.6f}" if isinstance(v, int | float | np.number) and not isinstance(v, bool) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert shown(got) == shown(want)


def test_registered():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
