"""Shards by proportional stratified interleaving, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def seeded(column: str, seed: int) -> Column:
    """60 bits from md5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 17, buckets: int = 1024) -> DataFrame:
    """Each row of docs(doc_id, text, source) with its shard and slot; law `rows`: shard sizes are at most one apart.

    The rows of a source are shuffled by a seeded hash and ranked; the r-th of n stands at (r - 1/2) / n. All rows are
    sorted by that fraction and cut into n_shards equal runs, so each run holds every source in its share of the whole.
    Ranks come from counts of hash buckets plus a rank within a bucket, so no source and no range of fractions has to
    fit one task, however many rows one source holds. Only ids, sizes and checksums are shuffled, never texts.

    Result: doc_id, size, text_crc32, law, shard, slot, grown_shard, source. A null text has no bytes (size 1, crc 0);
    null sources are one source; null ids sort first; rows that repeat an id each get a place of their own; an empty
    table gives no rows; other columns of docs are ignored.
    """
    slim = docs.select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), seeded("doc_id", seed).alias("h")
    ).withColumn("bucket", F.floor(F.col("h") / F.lit((1 << 60) // buckets)).cast("int"))
    slim = cut(slim)
    counts = slim.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    within = Window.partitionBy("source")
    offsets = counts.select(
        F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), (F.sum("n").over(within.orderBy("bucket")) - F.col("n")).alias("before"), F.sum("n").over(within).alias("of_source")
    )
    ranked = slim.withColumn("r", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "text_crc32")))
    ranked = ranked.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
    ranked = ranked.select(
        "doc_id", "source", "size", "text_crc32", "h", ((2 * (F.col("before") + F.col("r")) - 1).cast("double") / (2 * F.col("of_source")).cast("double")).alias("at")
    ).withColumn("part", F.least(F.floor(F.col("at") * buckets), F.lit(buckets - 1)).cast("int"))
    ranked = cut(ranked)
    parts = ranked.groupBy("part").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # one row for each of the buckets, at most
    starts = parts.select("part", (F.sum("n").over(every.orderBy("part")) - F.col("n")).alias("first"), F.sum("n").over(every).alias("total"))
    place = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy("at", F.col("source").asc_nulls_first(), "h", "doc_id", "size", "text_crc32")) - 1
    placed = ranked.join(F.broadcast(starts), "part").withColumn("place", place).withColumn("shard", F.expr(f"(place * {n_shards}) div total").cast("int"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.expr(f"place - (shard * total + {n_shards - 1}) div {n_shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source"
    )
