"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_stats(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count("*").alias("chunks"), F.countDistinct("chapter").alias("chapters"), F.countDistinct("subject").alias("subjects"))


def chapter_stats(corpus: DataFrame) -> DataFrame:
    """Per chapter: rows, the lengths of its least and greatest text in binary order, its true extremes, and mean words rounded down."""
    return corpus.groupBy("chapter").agg(
        F.count("*").alias("n"), F.length(F.min("content")).cast("long").alias("first_len"), F.length(F.max("content")).cast("long").alias("last_len"),
        F.min(F.length("content")).cast("long").alias("min_len"), F.max(F.length("content")).cast("long").alias("max_len"),
        F.expr("sum(regexp_count(content, '[^ \\n\\t]+')) div greatest(count(*), 1)").cast("long").alias("mean_words"),
    )


def distinct_chapters(corpus: DataFrame, limit: int = 30, subject: str | None = None, grade: str | None = None) -> DataFrame:
    """Names that are neither null nor empty, in order; at most 100, as the report allows."""
    rows = corpus.where("chapter is not null and chapter <> ''")
    rows = rows.where(F.col("subject") == subject) if subject else rows
    rows = rows.where(F.col("grade") == grade) if grade else rows
    return rows.select("chapter").distinct().orderBy(F.asc_nulls_last("chapter")).limit(min(limit, 100))


def ingestion_summary(chunks: DataFrame) -> DataFrame:
    """For chunks(chapter, ok): uploaded, failed and status per chapter."""
    out = chunks.groupBy("chapter").agg(F.count_if(F.col("ok")).alias("uploaded"), F.count_if(~F.col("ok")).alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") == 0, "OK").otherwise("WARN"))


def ingestion_totals(chunks: DataFrame) -> DataFrame:
    """For chunks(subject, grade, chapter, ok): files, chunks, uploaded, failed and status of a run, by subject and grade, by
    subject (grade null) and in all (both null)."""
    out = chunks.rollup("subject", "grade").agg(F.count_distinct("chapter").alias("files"), F.count("*").alias("chunks"), F.count_if(F.col("ok")).alias("uploaded"), F.count_if(~F.col("ok")).alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") == 0, "OK").otherwise("WARN"))


def request_counters(requests: DataFrame) -> DataFrame:
    """requests(kind, ok): count, successes and the success rate as text with one decimal, per kind."""
    out = requests.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("ok")).alias("good"))
    return out.withColumn("rate", F.concat(F.round(F.col("good") * F.lit(100.0) / F.greatest("n", F.lit(1)), 1).cast("string"), F.lit("%")))


def relevance_summary(hits: DataFrame) -> DataFrame:
    """Per qid of hits(qid, pos, similarity): hits, mean similarity to 3 decimals, mean of the first three."""
    return hits.groupBy("qid").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 3).alias("mean"), F.round(F.avg(F.when(F.col("pos") <= 3, F.col("similarity"))), 6).alias("top"))
