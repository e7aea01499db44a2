"""Duplicates among the items of a request: pairs, ordered elimination, and first texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Items of a group that are compared with as many others at once, and rows that a task hands on at once.
TILE, ROWS = 1024, 10_000


def gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of many small batches in batches of about ROWS: each costs Spark as much as many rows."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n >= ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def runs(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[pa.Table]:
    """Rows in batches as tables of equal keys, which stand together; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = list(zip(*(batch[c].to_pylist() for c in key), strict=True))
        begin = 0
        for i, k in enumerate(keys):
            if k != last and (held or i > begin):
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                yield pa.Table.from_batches(held)
                held, begin = [], i
            last = k
        if batch.num_rows > begin:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def scored_pairs(items: DataFrame, threshold: float) -> DataFrame:
    """grp, i, j, similarity, si, sj for items(grp, idx, score, embedding): pairs i < j of a group with similarity >= threshold.

    A group of more than TILE items is dealt into tiles by a hash, and each two tiles meet in one task, which compares
    them by one product of matrices; smaller groups are one tile, and a task takes many of them. Cosines count as rounded to
    six digits. Null and zero vectors are similar to nothing, nor are vectors of different lengths; repeated idx are not
    compared with each other.
    """
    tiles = F.ceil(F.count("*").over(Window.partitionBy("grp")) / TILE).cast("int")
    rows = items.select("grp", F.col("idx").cast("long").alias("idx"), F.col("score").cast("double").alias("score"), F.col("embedding").cast("array<double>").alias("embedding"), tiles.alias("tiles"))
    own = F.pmod(F.xxhash64("idx"), "tiles").cast("int")
    meetings = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, own).alias("a"), F.greatest(t, own).alias("b")))
    met = rows.select("grp", "idx", "score", "embedding", own.alias("tile"), F.inline(meetings)).repartition("grp", "a", "b").sortWithinPartitions("grp", "a", "b")
    kind = T.StructType([items.schema["grp"], *T._parse_datatype_string("i long, j long, similarity double, si double, sj double").fields])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, "grp", "a", "b"):
            run = run.combine_chunks()
            idx, score, tile = (run[c].to_numpy() for c in ("idx", "score", "tile"))
            lists = run["embedding"].chunk(0)
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.values.to_numpy(zero_copy_only=False)  # null components are NaN
            if lists.null_count or lists.values.null_count:
                sizes = np.where([v.is_valid and not any(x is None for x in v.as_py()) for v in lists], sizes, 0)
            begins = lists.offsets.to_numpy()[:-1]
            a, b = run["a"][0].as_py(), run["b"][0].as_py()
            for d in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == d)
                v = values[begins[at][:, None] + np.arange(d)]
                length = np.sqrt((v * v).sum(1))
                at, v = at[length > 0], v[length > 0] / length[length > 0][:, None]
                left, right = (np.flatnonzero(tile[at] == t) for t in (a, b))
                for begin in range(0, len(left), TILE):
                    some = left[begin : begin + TILE]
                    s = np.round(v[some] @ v[right].T, 6)
                    p, q = np.nonzero(s >= threshold)
                    x, y = at[some[p]], at[right[q]]
                    go = idx[x] < idx[y] if a == b else idx[x] != idx[y]
                    x, y, s = x[go], y[go], s[p[go], q[go]]
                    x, y = np.where(idx[x] < idx[y], x, y), np.where(idx[x] < idx[y], y, x)
                    if len(x):
                        columns = [run["grp"].take(pa.array(x)).combine_chunks(), *map(pa.array, (idx[x], idx[y], s, score[x], score[y]))]
                        yield pa.RecordBatch.from_arrays(columns, kind.names)

    return met.mapInArrow(lambda batches: gathered(compare(batches)), kind)


def similar_pairs(items: DataFrame, threshold: float = 0.82) -> DataFrame:
    """grp, i, j, similarity for items(grp, idx, embedding): pairs i < j of a request with similarity >= threshold; see scored_pairs."""
    return scored_pairs(items.withColumn("score", F.lit(0.0)), threshold).select("grp", "i", "j", "similarity")


def item_score(text: Column, explanation: Column, options: Column, answer: Column, bloom: Column, topic: Column, form: Column) -> Column:
    """How much an item is worth keeping: length up to 2, explanation 2, four options 1, answer 1, level and topic 0.5 each, and
    1.5 for an assertion with options."""
    some = lambda c, n: F.coalesce(F.length(c) > n, F.lit(False))
    sized = F.coalesce(F.size(options), F.lit(0))
    add = lambda cond, x: F.when(cond, x).otherwise(0.0)
    return (
        F.least(F.length(text) / 200, F.lit(1.0)) * 2
        + add(some(explanation, 20), 2.0) + add(sized == 4, 1.0) + add(some(answer, 2), 1.0) + add(some(bloom, 0), 0.5)
        + add(some(topic, 0), 0.5) + add((form == "assertion_reason") & (sized > 0), 1.5)
    )


def greedy_dedup(items: DataFrame, threshold: float = 0.82) -> DataFrame:
    """items(grp, idx, score, embedding) that an ordered elimination keeps: grp, idx.

    Items are visited in order; a live item i drops its live similar later items up to the first with a higher score, and
    goes itself if there is one. The order matters, so the similar pairs of a group come to one task sorted, which reads
    them one after the other and remembers only the items that are gone; groups are independent of each other. An item without
    a similar one stays.
    """
    pairs = scored_pairs(items, threshold).drop("similarity").repartition("grp").sortWithinPartitions("grp", "i", "j")
    kind = T.StructType([items.schema["grp"], T.StructField("idx", T.LongType())])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, gone = None, set()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([grp] * len(gone), group), pa.array(sorted(gone), pa.int64())], ["grp", "idx"])

        for batch in batches:
            group = batch.schema.field("grp").type
            for g, i, j, si, sj in zip(*(batch[c].to_pylist() for c in ("grp", "i", "j", "si", "sj")), strict=True):
                if g != grp:
                    if gone:
                        yield told()
                    grp, gone = g, set()
                if i not in gone and j not in gone:
                    gone.add(i if si is not None and sj is not None and sj > si else j)
        if gone:
            yield told()

    gone = pairs.mapInArrow(lambda batches: gathered(visit(batches)), kind)
    return items.select("grp", F.col("idx").cast("long").alias("idx")).join(gone, ["grp", "idx"], "left_anti")


def first_texts(rows: DataFrame, key: Column) -> DataFrame:
    """The least id of each key and how many rows share it. Partial aggregation: a key in very many rows is one row a task."""
    return rows.select("id", key.alias("_key")).groupBy("_key").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "copies")
