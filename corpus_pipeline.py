"""A corpus pipeline out of five of the operators: toxicity, language ID, SimHash near-dedup, mixing, SentencePiece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, mixing, pieces, simhash, toxicity
from millrace.llm.common import small_batches, stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5. Null and empty texts have the score of no feature; repeated rows are judged alike, and all columns stay."""
    return docs.where(toxicity.score_column(docs, table(spark, sf_dir, "labels")) < 0.5)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are text in some learned language, with the predicted language in lang.

    Documents go that have no letter, null and empty texts included, or whose cosine with every language is under
    langid.CHANCE, as that of unrelated text is. The table's own lang is learned from outside the held-out fold and never read for a decision.
    Where no language can be learned, all documents with a letter stay as they are.
    """
    model = langid.model_of(docs)
    if not model[0]:
        return docs.where(langid.lettered(F.col("text")))
    name = "__predicted"
    while name in docs.columns:
        name += "_"
    found = docs.withColumn(name, langid.identified(F.col("text"), model)).where(F.col(name)["score"] >= langid.CHANCE)
    return found.withColumn("lang", F.col(name)["lang_pred"]).select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them, all columns with them. Documents without words are never taken; null is a source of its own."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, ids, exact): each document's piece ids, and whether they decode to its text. Null and empty texts have no pieces; a row for each row."""
    import public_tokenizers

    small_batches(spark)
    found = pieces.checked(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    return docs.select("doc_id", "lang", "source", found.alias("p")).select("doc_id", "lang", "source", F.size("p.ids").cast("long").alias("n_pieces"), "p.ids", "p.exact")


STAGES = [("toxicity", drop_toxic), ("language_id", keep_languages), ("simhash", dedup), ("mixing", mix), ("sentencepiece", encode)]

#: Trained models and Viterbi segmentation can't be told in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
