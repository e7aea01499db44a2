"""A training corpus from the table documents: good documents, without repeated lines, near copies and secrets, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import beside, cut, restored, table
from corpusloom.llm.linededup import dedup_lines
from corpusloom.llm.ngramjoin import ngram_components
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.quality import quality_scores, train
from corpusloom.llm.secrets import mask_secrets


#: Near copies, apart from op6's contract: two documents link when this share of their shingles of so many words is common.
NEAR_WORDS, NEAR_PER_CENT = 5, 80


def apart(docs: DataFrame) -> DataFrame:
    """doc_id and text beside one struct of all other columns, so that a stage leaves every column of docs alone."""
    return docs.select("doc_id", "text", beside(docs, "doc_id", "text"))


def back(docs: DataFrame, done: DataFrame) -> DataFrame:
    """The rows of done with the columns of docs; n_chars, where there is one, follows the text."""
    own = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return done.select(*restored(docs, doc_id=F.col("doc_id"), text=F.col("text"), **own))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on docs with the table labels. No labels reject nothing.

    A null or empty text is scored as an empty line; null and repeated ids are judged by their own text each; no rows
    give none.
    """
    scored = quality_scores(apart(docs), train(docs, table(spark, sf_dir, "labels"))).where("predicted = 1")
    return scored.select(*restored(docs, doc_id=F.col("doc_id"), text=F.col("text")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which no line is left; those that had no text before stay as they are.

    Rows that repeat doc_id and text count as one document; rows of one id, or of none, with different texts as several;
    see dedup_lines. No rows give none.
    """
    return back(docs, dedup_lines(apart(docs)).where("n_removed < n_lines or n_removed = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; documents without an id or without words stay.

    What goes is rows, told apart by doc_id and text: of an id with two texts only the one that is a copy goes. Rows that
    repeat both are one document, as are near copies with the same id; they stay or go together. No rows give none.
    """
    others = ngram_components(docs, words=NEAR_WORDS, per_cent=NEAR_PER_CENT).where("component_id < doc_id").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    rows = apart(docs).withColumn("text_hash", F.xxhash64("text"))
    rows = rows.join(others, (F.col("doc_id") == F.col("id")) & (F.col("text_hash") == F.col("hash")), "left_anti")
    return rows.select(*restored(docs, doc_id=F.col("doc_id"), text=F.col("text")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; every row stays, also without id or text and where rows repeat; no rows give none."""
    return back(docs, mask_secrets(apart(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences; see pack_documents for null and repeated ids and empty texts."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: Fitting, joining on whole sets and tokenizing are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each on what the one before kept; no documents give no sequences."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
