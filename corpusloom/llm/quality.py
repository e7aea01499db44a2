"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..memory import giving_back
from .common import beside, restored

#: The most labelled documents that the fit sees, in the order of a hash of their ids, and the most lines in all of them and
#: in one; their lines' features go to the driver. A document of more lines is not drawn, and drawing ends at the bound.
FIT_DOCS, FIT_LINES, FIT_DOC_LINES = 4000, 200_000, 20_000
ROUNDS, RATE, RIDGE = 150, 0.1, 1e-4
KEEP = 0.3
BLOCK_BYTES = 4_000_000

#: Bytes of a line by class; features are their shares of the line.
UPPER, LOWER, DIGIT, SPACE, STOP, BAR, MARK, HIGH = range(8)
OF_BYTE = np.full(256, MARK, np.uint8)
OF_BYTE[128:] = HIGH
OF_BYTE[65:91], OF_BYTE[97:123], OF_BYTE[48:58] = UPPER, LOWER, DIGIT
OF_BYTE[[9, 10, 11, 12, 13, 32]] = SPACE
OF_BYTE[[ord(c) for c in ".,;:'\"-()?"]] = STOP
OF_BYTE[ord("|")] = BAR
RANDOM = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def line_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row for each line data[start:end] of a block; lines are in order and don't overlap."""
    n = len(data)
    kinds = OF_BYTE[data]
    size = np.maximum(ends - starts, 1).astype(float)
    columns = []

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1, np.int32)
        np.cumsum(flags, out=sums[1:], dtype=np.int32)
        return (sums[ends] - sums[starts]).astype(float)

    for k in range(8):
        columns.append(total(kinds == k) / size)
    white = np.ones(n + 2, bool)
    white[1:-1] = kinds == SPACE
    edges = np.zeros(n + 1, bool)
    edges[starts] = True  # a line begins a word even where the bytes of another document precede it
    begin = np.flatnonzero(~white[1:-1] & (white[:-2] | edges[:-1])) if n else np.zeros(0, int)
    stop = np.zeros(n + 1, bool)
    stop[ends] = True
    end = np.flatnonzero(~white[1:-1] & (white[2:] | stop[1:])) + 1 if n else np.zeros(0, int)
    of = np.searchsorted(starts, begin, "right") - 1
    words = np.bincount(of, minlength=len(starts)).astype(float)
    if len(begin):
        power = np.ones(n + 1, np.uint64)
        np.multiply.accumulate(np.full(n, BASE), out=power[1:])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(RANDOM[data] * power[:-1], out=sums[1:])
        back = np.ones(n + 1, np.uint64)
        np.multiply.accumulate(np.full(n, INVERSE), out=back[1:])
        names = (sums[end] - sums[begin]) * back[begin]
        again = np.zeros(len(begin))
        again[1:] = (names[1:] == names[:-1]) & (of[1:] == of[:-1])
        same = np.bincount(of, again, len(starts))
        marked = np.bincount(of, kinds[end - 1] == MARK, len(starts))
    else:
        same = marked = np.zeros(len(starts))
    some = np.maximum(words, 1)
    columns += [same / some, marked / some, np.minimum(size / some, 30) / 30, np.minimum(np.log1p(words), 6) / 6, ends == starts]
    return np.column_stack(columns).astype(float)


WIDTH = 13


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A line's features, those of the line before and of the line after, and a constant; first marks a document's first line."""
    n = len(x)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:] = x[:-1]
    before[first] = 0
    after[:-1] = x[1:]
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    after[last] = 0
    return np.hstack([x, before, after, np.ones((n, 1))])


class Block(NamedTuple):
    """Lines of whole documents: features, lengths, and where each document's lines begin and how many it has."""

    x: np.ndarray
    size: np.ndarray
    at: np.ndarray
    count: np.ndarray


def blocks(texts: pa.Array) -> Iterator[Block]:
    """Whole documents, a few megabytes at a time. A null text is an empty one; an empty one has one empty line."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, "right")) - 1)
        hi = min(hi, len(texts))
        own, marks = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        breaks = np.flatnonzero(own == 10)
        starts = np.concatenate([marks[:-1], breaks + 1])
        doc = np.concatenate([np.arange(hi - lo), np.searchsorted(marks, breaks, "right") - 1])
        order = np.lexsort((starts, doc))
        starts, doc = starts[order], doc[order]
        count = np.bincount(doc, minlength=hi - lo)
        at = np.cumsum(count) - count
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:] - 1
        ends[at + count - 1] = marks[1:]
        first = np.zeros(len(starts), bool)
        first[at] = True
        yield Block(with_neighbours(line_features(own, starts, ends), first), ends - starts, at, count)
        lo = hi


class Chain(NamedTuple):
    """weights of a line's features for the label good against bad; moves[a, b] for label b after a."""

    weights: np.ndarray
    moves: np.ndarray


def marginals(chain: Chain, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line by forward and backward passes over all documents at once, and expected moves in sum."""
    push = np.clip(b.x @ chain.weights, -30, 30)
    node = np.column_stack([np.exp(-push / 2), np.exp(push / 2)])
    move = np.exp(chain.moves)
    order = np.argsort(-b.count, kind="stable")
    at, count = b.at[order], b.count[order]
    active = [at[: np.searchsorted(-count, -t)] + t for t in range(int(count[0]))] if len(count) else []
    forward, backward = np.zeros_like(node), np.ones_like(node)
    for t, i in enumerate(active):
        a = node[i] * (forward[i - 1] @ move) if t else node[i]
        forward[i] = a / a.sum(1, keepdims=True)
    for i in reversed(active[1:]):
        g = (node[i] * backward[i]) @ move.T
        backward[i - 1] = g / g.sum(1, keepdims=True)
    both = forward * backward
    good = both[:, 1] / both.sum(1)
    moves = np.zeros((2, 2))
    later = np.ones(len(node), bool)
    later[b.at] = False
    j = np.flatnonzero(later)
    if len(j):
        pair = forward[j - 1][:, :, None] * move * (node[j] * backward[j])[:, None, :]
        moves = (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    return good, moves


def fit(b: Block, quality: np.ndarray) -> Chain:
    """Maximum likelihood with a ridge over scaled features, by Adam; every line of a document carries its label."""
    scale = 1 / np.maximum(b.x.std(0), 1e-3)
    scale[-1] = 1
    b = b._replace(x=b.x * scale)
    y = np.repeat(quality.astype(float), b.count)
    step = np.zeros(b.x.shape[1] + 4)
    m, v = np.zeros_like(step), np.zeros_like(step)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (b.count[quality == label] - 1).sum()
    n = max(1, len(y))
    for k in range(1, ROUNDS + 1):
        good, moves = marginals(Chain(step[:-4], step[-4:].reshape(2, 2)), b)
        slope = np.concatenate([b.x.T @ (y - good), (seen - moves).ravel()]) / n - RIDGE * step
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        step = step + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Chain(step[:-4] * scale, step[-4:].reshape(2, 2))


def scores(chain: Chain, b: Block) -> np.ndarray:
    """The mean of the lines' marginals, weighted by length; lines without bytes weigh as one byte."""
    good, _ = marginals(chain, b)
    weight = np.maximum(b.size, 1)
    return np.add.reduceat(good * weight, b.at) / np.add.reduceat(weight, b.at) if len(b.at) else np.zeros(0)


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_lines: int = FIT_LINES, fit_doc_lines: int = FIT_DOC_LINES) -> Chain:
    """The chain for labels(doc_id, quality): at most fit_docs labelled documents of at most fit_lines lines, none held out.

    Only features of lines come to the driver, from that bounded sample of whole documents. Labels other than 0 and 1 and null ids are left
    out; without labels, or with one class only, the chain follows what there is (a constant).
    """
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64(F.lit("fit"), "doc_id"), "doc_id").limit(fit_docs)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for b in blocks(batch["text"]):
                n = len(b.count)
                x = [b.x[a : a + c] for a, c in zip(b.at, b.count, strict=True)]
                size = [b.size[a : a + c].astype("<i8").tobytes() for a, c in zip(b.at, b.count, strict=True)]
                own = batch.slice(done, n)
                yield pa.RecordBatch.from_arrays([own["doc_id"], own["quality"], own["lines"], pa.array([p.astype("<f4").tobytes() for p in x], pa.binary()), pa.array(size, pa.binary())], ["doc_id", "quality", "lines", "x", "size"])
                done += n

    # fit_docs rows at most, so the broadcast is bounded
    lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text", lines.cast("long").alias("lines"))
    # lines are added up before any features are made, so one task sees a row a document drawn, fit_docs at most
    drawn = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64(F.lit("fit"), "doc_id"), "doc_id")
    few = texts.where(F.col("lines") <= fit_doc_lines).select("doc_id", "lines").withColumn("upto", F.sum("lines").over(drawn)).where(F.col("upto") <= fit_lines).select("doc_id").distinct()
    used = texts.where(F.col("lines") <= fit_doc_lines).join(F.broadcast(few), "doc_id").select(*texts.columns)
    rows = used.mapInArrow(giving_back(of), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, lines long, x binary, size binary")
    rows = rows.select("quality", "x", "size").collect()
    rows.sort(key=lambda r: (r.quality, r.size, r.x))  # sums of floats don't depend on the order of arrival
    width = 3 * WIDTH + 1
    x = [np.frombuffer(r.x, "<f4").reshape(-1, width).astype(float) for r in rows]
    count = np.array([len(a) for a in x], int)
    if not len(count):
        return Chain(np.zeros(width), np.zeros((2, 2)))
    b = Block(np.vstack(x), np.concatenate([np.frombuffer(r.size, "<i8") for r in rows]), np.cumsum(count) - count, count)
    return fit(b, np.array([r.quality for r in rows]))


def quality_scores(docs: DataFrame, chain: Chain, keep: float = KEEP) -> DataFrame:
    """docs with held_out, score and predicted (1 if score >= keep) added, which replace columns of these names.

    Only the text counts. A null text scores as an empty one, one empty line; rows that repeat score alike; no rows give none.
    """
    own = docs.drop("held_out", "score", "predicted")
    rows = own.select("doc_id", "text", beside(own, "doc_id", "text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([scores(chain, b) for b in blocks(batch["text"])]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(found, 0, 1), pa.float64())], ["doc_id", "text", "row", "score"])

    scored = rows.mapInArrow(giving_back(of), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.select(*restored(own, doc_id=F.col("doc_id"), text=F.col("text")), held_out().alias("held_out"), "score", (F.col("score") >= keep).cast("int").alias("predicted"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs, where the texts themselves stay in the task that scores them."""
    chain = train(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([scores(chain, b) for b in blocks(batch["text"])]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.clip(found, 0, 1), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(giving_back(of), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
