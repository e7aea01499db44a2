"""Overlapping word windows over texts with paragraphs."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def spans_of(counts: Iterable[int], size: int, overlap: int, least: int) -> list[dict[str, int]]:
    """The chunks of a text whose paragraphs have so many words each, as places and lengths among all its words.

    What is gathered always lies together in the text, so a first and a last place are all there is to keep.
    """
    out, first, last = [], 0, 0
    for n in counts:
        if first < last and last - first + n > size:
            if last - first >= least:
                out.append({"at": first, "n": last - first})
            first = last - overlap if last - first > overlap else last
        last += n
        while last - first > size:
            out.append({"at": first, "n": size})
            first += size - overlap
    return [*out, {"at": first, "n": last - first}] if last - first >= least and last > first else out


def chunks(text: Column, size: int = 500, overlap: int = 75, least: int = 50) -> Column:
    """The chunks of a text as an array of strings, in one pass over the word counts of its paragraphs.

    Paragraphs end at blank lines. If the next one would make the buffer longer than size, the buffer is a chunk (from
    `least` words on) and keeps its last `overlap` words if it has more, else nothing. Whatever grows beyond size is cut
    into chunks of size words, each beginning size - overlap words after the one before; the rest is a chunk from
    `least` words on. Only counts go through Python; words are cut by place. A null or empty text has none.
    """

    @F.arrow_udf("array<struct<at:int,n:int>>")
    def spans(counts: pa.Array) -> pa.Array:
        return pa.array([spans_of(c.as_py() or (), size, overlap, least) for c in counts], SPANS)

    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), words_of), lambda p: F.size(p) > 0)
    both = F.array(F.struct(F.flatten(paragraphs).alias("words"), spans(F.transform(paragraphs, lambda p: F.size(p))).alias("spans")))
    cut = F.transform(both, lambda b: F.transform(b["spans"], lambda s: F.array_join(F.slice(b["words"], s["at"] + 1, s["n"]), " ")))
    return F.get(cut, F.lit(0))


def chunk_rows(docs: DataFrame, size: int = 500, overlap: int = 75, least: int = 50) -> DataFrame:
    """id, k, chunk for docs(id, text); k counts from 0."""
    return docs.select("id", chunks(F.col("text"), size, overlap, least).alias("chunks")).select("id", F.posexplode("chunks").alias("k", "chunk"))
