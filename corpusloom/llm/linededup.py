"""Removes lines that stand in a window of three lines seen before, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, cut, restored


def lines_of(text: str = "text"):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def hash_of(text: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def repeated_windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_hash, pos) of every window of width lines whose text also starts at a smaller such place.

    Windows are named by two 64-bit hashes. A name's first place comes from an aggregation with partial results, so a
    window that very many documents share arrives as one row a task; the join back is between two plain shuffles, which
    adaptive execution can split where one name is frequent.
    """
    place = ["doc_id", "text_hash", "pos"]
    lines = docs.select("doc_id", hash_of().alias("text_hash"), lines_of().alias("lines"))
    at = F.transform(
        F.sequence(F.lit(0), F.size("lines") - width),
        lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("lines", i + 1, width), "\n").alias("s")),
    )
    windows = lines.where(F.size("lines") >= width).select("doc_id", "text_hash", F.inline(at)).where(F.trim(F.translate("s", "\n\r\t", "   ")) != "")
    windows = cut(windows.select(*place, F.xxhash64(F.lit(1), "s").alias("h1"), F.xxhash64(F.lit(2), "s").alias("h2")))  # read twice
    seen = windows.groupBy("h1", "h2").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = seen.select(F.col("h1").bitwiseXOR(F.col("h2")).alias("x"), "h2", "first")
    windows = windows.select(*place, F.col("h1").bitwiseXOR(F.col("h2")).alias("x"), "h2")
    return windows.join(seen, ["x", "h2"]).where(F.struct(*place) > F.col("first")).select(*place)


def dedup_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs with text replaced by what is left, plus n_lines, n_removed and n_spans.

    Every run of width consecutive lines is a window; a window that occurs again at a larger (doc_id, text hash,
    position) is removed there. Windows overlap, so the covered positions of a document are merged into spans of lines first. Each
    line that goes also stands at a smaller place, hence the first copy of every line's text stays.

    Lines end at a line feed and are compared exactly. Windows of blank lines only are left alone, as are documents of
    fewer than width lines; a null text stays null with n_lines 0 and an empty one has one empty line; rows that repeat
    doc_id and text count as the same document, and rows of one doc_id (or of none) with different texts as different
    ones in the order of their texts' hashes; a null doc_id sorts first. Other columns pass through; columns named n_lines,
    n_removed or n_spans are replaced.
    """
    later = repeated_windows(docs, width).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("ps"))
    later = later.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "ps")
    out = docs.drop("n_lines", "n_removed", "n_spans")
    rows = out.select("doc_id", "text", hash_of().alias("text_hash"), beside(out, "doc_id", "text"))
    rows = rows.join(later, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    before = F.filter("ps", lambda p, i: (i == 0) | (F.get("ps", i - 1) + width < p))
    after = F.filter("ps", lambda p, i: (i == F.size("ps") - 1) | (F.get("ps", i + 1) > p + width))
    rows = rows.withColumn("lines", F.when(F.col("text").isNotNull(), lines_of())).withColumns({"starts": before, "ends": F.transform(after, lambda p: p + width)})
    gaps = F.arrays_zip(F.concat(F.array(F.lit(0)), "ends").alias("s"), F.concat("starts", F.array(F.size("lines"))).alias("e"))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice("lines", g["s"] + 1, g["e"] - g["s"])))
    rows = rows.withColumn("kept", F.when(F.col("ps").isNotNull(), kept).otherwise(F.col("lines")))
    n = F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("long")
    text = F.when(F.col("ps").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("text"))
    return rows.select(
        *restored(out, doc_id=F.col("doc_id"), text=text),
        n.alias("n_lines"),
        F.coalesce(n - F.when(F.col("kept").isNotNull(), F.size("kept")), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.when(F.col("starts").isNotNull(), F.size("starts")), F.lit(0)).cast("long").alias("n_spans"),
    )
