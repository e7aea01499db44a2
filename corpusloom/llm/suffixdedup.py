"""Removes byte strings that also start in an earlier document: prefix doubling over the positions that a filter leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesfast import INVERSE, mix, power, prefix_sums, text_blocks
from .common import cut

LENGTH = 50
#: Bytes that the first rank stands for; each round about doubles them, up to the length asked for.
FIRST = 16
BLOCK_BYTES, FLUSH_RUNS = 1_000_000, 300_000
#: So many rows of one rank pair go on from a part of a task; of more, only those that say what the rank's rows are like,
#: and the rest stays open for the next round.
MOST_OF_PAIR = 64
#: Ids that several texts share, if there are at most so many; if more, every text gets a tag.
SHARED_IDS = 100_000
NONE = -(1 << 63)
#: A place: whether it is covered, whether it stays open whatever its rank, how many further strings it spans, where it begins.
COVER, OPEN, SPAN = 61, 60, 38
MOST, AT = (1 << OPEN - SPAN) - 1, (1 << SPAN) - 1


def rounds(length: int) -> list[int]:
    """The bytes a rank stands for, round by round: 16, 32 and 50 for a length of 50."""
    out = [min(FIRST, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def samples(data: np.ndarray, sums: np.ndarray, length: int, core: int) -> np.ndarray:
    """For each start of a string of `length` bytes the sampled position in it: where the smallest name of `core` bytes begins."""
    m = len(data) - core + 1
    names = mix((sums[core:] - sums[:m]) * power(INVERSE, m))
    now = (names & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    width, step = length - core + 1, 1
    while step * 2 <= width:
        now, step = np.minimum(now[:-step], now[step:]), step * 2
    if width > step:
        now = np.minimum(now[: step - width], now[width - step :])
    return (now & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Names:
    """Ranks of positions in a block of texts: at first names of bytes, then of pairs of ranks at growing offsets.

    A rank is a 64-bit name that follows from what it stands for, so equal strings have equal ranks in every task.
    """

    def __init__(self, data: np.ndarray, lengths: list[int]):
        self.sums, self.back, self.lengths = prefix_sums(data), power(INVERSE, len(data) + 1), lengths

    def bytes(self, begin: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin] ^ np.uint64(salt))

    def pair(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of round k - 1 that make the one of round k: at the position, and as far behind it as the new rank is longer."""
        if k == 0:
            return self.bytes(at, at + self.lengths[0]), np.zeros(len(at), np.uint64)
        return self.rank(at, k - 1), self.rank(at + self.lengths[k] - self.lengths[k - 1], k - 1)

    def rank(self, at: np.ndarray, k: int) -> np.ndarray:
        a, b = self.pair(at, k)
        return mix(a + mix(b + np.uint64(k))) if k else a


def groups(names: Names, starts: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring starts with one sample whose strings all hold the part that round k ranks:
    (rank, rank behind it, name of the whole run, first start, last start)."""
    length = names.lengths[-1]
    width = length - names.lengths[k] + 1
    sample = at[starts]
    part = (sample - starts) // width
    new = np.ones(len(starts), bool)
    new[1:] = (sample[1:] != sample[:-1]) | (part[1:] != part[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi = starts[first], starts[np.append(first[1:], len(starts)) - 1]
    sample, part = sample[first], part[first]
    r1, r2 = names.pair(sample - width * part, k)
    shape = mix(((hi - lo) << 20 | (sample - lo)).astype(np.uint64))
    whole = mix((names.sums[hi + length] - names.sums[lo]) * names.back[lo] ^ shape) if width > 1 else np.zeros(len(lo), np.uint64)
    return r1.view(np.int64), r2.view(np.int64), whole.view(np.int64), lo, hi


RANKS = "doc long, tag long, place long, r1 long, r2 long, whole long"


def alone(doc: np.ndarray, tag: np.ndarray, where: np.ndarray) -> np.ndarray:
    """A rank that no other row has, for rows that are decided."""
    return mix((doc * 1_000_003 + where).view(np.uint64) ^ mix(tag.view(np.uint64))).view(np.int64)


def settled(last: bool, doc: np.ndarray, tag: np.ndarray, where: np.ndarray, r1: np.ndarray, r2: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
    """Rows of a part of a task. A run whose whole an earlier document of them has is covered already; before the last round,
    of a pair of ranks that many runs have only the least and greatest document and whole go on under it, and the others
    stay open."""
    if len(doc):
        order = np.lexsort((doc, whole, r2, r1))
        doc, tag, where, r1, r2, whole = (x[order] for x in (doc, tag, where, r1, r2, whole))
        pair = np.ones(len(doc), bool)
        pair[1:] = (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])
        new = pair.copy()
        new[1:] |= whole[1:] != whole[:-1]
        later = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        where = np.where(later, where | (1 << COVER), where)
        rest = np.flatnonzero(where >> COVER & 1 == 0)
        group = np.cumsum(pair)[rest]
        many = np.bincount(group)[group] > MOST_OF_PAIR
        if many.any() and not last:
            rest, group = rest[many], group[many]
            shown = np.zeros(len(doc), bool)
            for by in (doc[rest], whole[rest]):
                at = rest[np.lexsort((by, group))]  # rest in order of group
                edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                shown[at[edge]] = shown[at[np.append(edge[1:], len(group)) - 1]] = True
            rest = rest[~shown[rest]]
            where[rest] |= 1 << OPEN
        own = np.flatnonzero(where >> OPEN)
        r1[own] = alone(doc[own], tag[own], where[own])
        r2[own] = whole[own] = 0
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, tag, where, r1, r2, whole)], [x.split()[0] for x in RANKS.split(", ")])


def ranked(k: int, length: int):
    """For mapInArrow: the runs of each text with their rank pairs of round k; after round 0 only around open places."""
    lengths = rounds(length)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            ids, tags = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
            for row, data, marks in text_blocks(batch["text"], BLOCK_BYTES):
                if len(data) < length:
                    continue
                change = np.zeros(len(data) + 1, np.int32)
                for i, (a, b) in enumerate(zip(marks[:-1], marks[1:], strict=True)):
                    if k == 0:
                        if b - a >= length:
                            change[a] += 1
                            change[b - length + 1] -= 1
                        continue
                    known = np.array(batch["places"][row + i].values.to_numpy(zero_copy_only=False), np.int64)
                    cover = known[known >> COVER & 1 == 1]
                    if len(cover):
                        lo, hi = merged(cover)
                        while len(lo):  # long spans in parts that fit a place
                            end = np.minimum(hi, lo + MOST)
                            doc, tag, where = np.full(len(lo), ids[row + i]), np.full(len(lo), tags[row + i]), (1 << COVER) | (end - lo) << SPAN | lo
                            held.append((doc, tag, where, *[np.zeros(len(lo), np.int64)] * 3))
                            go = end < hi
                            lo, hi = end[go] + 1, hi[go]
                    rest = known[known >> COVER & 1 == 0]
                    at, span = rest & AT, rest >> SPAN & MOST
                    np.add.at(change, a + at, 1)
                    np.add.at(change, a + at + span + 1, -1)
                starts = np.flatnonzero(np.cumsum(change) > 0)
                if len(starts):
                    names = Names(data, lengths)
                    at = samples(data, names.sums, length, lengths[0])
                    # a document's runs end with it, as its last start and the next one's first are not neighbours
                    r1, r2, whole, lo, hi = groups(names, starts, at, k)
                    doc = np.searchsorted(marks, lo, "right") - 1
                    held.append((ids[row + doc], tags[row + doc], (hi - lo) << SPAN | (lo - marks[doc]), r1, r2, whole))
                if sum(len(h[0]) for h in held) > FLUSH_RUNS:
                    yield settled(k == len(lengths) - 1, *map(np.concatenate, zip(*held, strict=True)))
                    held = []
        if held:
            yield settled(k == len(lengths) - 1, *map(np.concatenate, zip(*held, strict=True)))

    return of


def merged(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of places as spans (first start, last start), in order; spans that touch are one."""
    lo = places & AT
    hi = lo + (places >> SPAN & MOST)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1] + 1
    first = np.flatnonzero(new)
    return lo[first], hi[np.append(first[1:], len(lo)) - 1]


def reranked(rows: DataFrame) -> DataFrame:
    """(doc, tag, places): what a round has decided. Spark sorts the rank pairs: runs whose pair no other document has drop
    out; runs whose whole an earlier document has are covered; the others, and those that said so, stay open."""
    # by the pair alone, as both windows want the rows of a pair together
    rows = rows.repartition("r1", "r2")
    rows = rows.withColumn("first", F.min("doc").over(Window.partitionBy("r1", "r2", "whole")))
    own = Window.partitionBy("r1", "r2")
    rows = rows.withColumns({"least": F.min("doc").over(own), "most": F.max("doc").over(own), "low": F.min("whole").over(own), "high": F.max("whole").over(own)})
    has = lambda bit: F.col("place").bitwiseAND(F.lit(1 << bit)) != 0
    covered = has(COVER) | (~has(OPEN) & (F.col("doc") > F.col("first")))
    rows = rows.where(covered | has(OPEN) | ((F.col("least") < F.col("most")) & (F.col("low") < F.col("high"))))
    return rows.groupBy("doc", "tag").agg(F.collect_list(F.when(covered, F.col("place").bitwiseOR(F.lit(1 << COVER))).otherwise(F.col("place"))).alias("places"))


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def kept_parts(text: bytes, places: np.ndarray | None, length: int) -> tuple[list[bytes], int, int]:
    """What is left of a text, the bytes removed and the spans they form."""
    places = places[places >> COVER & 1 == 1] if places is not None else ()
    if not len(places):
        return [text], 0, 0
    lo, hi = merged(places)
    hi = hi + length
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    lo, hi = lo[first], hi[np.append(first[1:], len(lo)) - 1]
    ends = [0, *hi.tolist()]
    return [text[a:b] for a, b in zip(ends, [*lo.tolist(), len(text)], strict=True)], int((hi - lo).sum()), len(lo)


def tagged(docs: DataFrame, shared_ids: int) -> DataFrame:
    """(doc, tag, text): doc in the order of ids, nulls first; tag tells apart the texts of one id and is 0 where an id has one row."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc"), "text")
    found = [r.doc for r in own.where(F.col("doc") != NONE).groupBy("doc").count().where("count > 1").limit(shared_ids + 1).collect()]
    tag = F.xxhash64("text")
    if len(found) <= shared_ids:
        if found:  # at most shared_ids rows
            own = own.join(F.broadcast(docs.sparkSession.createDataFrame([(d, True) for d in found], "doc long, shared boolean")), "doc", "left")
        tag = F.when((F.col("doc") == NONE) | (F.col("shared") if found else F.lit(False)), tag).otherwise(0)
    return own.select("doc", tag.alias("tag"), "text")


def dedup_spans(docs: DataFrame, length: int = LENGTH, shared_ids: int = SHARED_IDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs(doc_id, text).

    Every byte goes that a string of `length` bytes covers which also starts in a document with a smaller doc_id;
    strings are judged on the texts as given. Prefix doubling: a position's rank stands for 16 bytes, then for 32 and for
    50, each as the pair of the ranks before at the position and 16 or 18 bytes behind it. Spark sorts the pairs, and
    positions go on to the next round until their rank is unique or stands for the whole length.

    A rank is a name of its pair, not a number, so that tasks need not be told the ranks of other positions. Not every
    position is ranked, as that would shuffle the text many times over: each string holds one sampled position, chosen by
    its own bytes, and strings around a sample share the rank of the part they all hold. A run of strings that an earlier
    document has in full is settled at once; only runs that share a rank but differ around it go to the next round.

    Rows of a task that have one text in common are settled in the task, so a passage in very many documents is
    shuffled once a task; of a rank that very many different runs of a task share, four are shuffled under it. Texts meet
    the results by doc_id in a shuffle for each round but the first; the last one also serves the report.

    A null or empty text has no bytes; texts shorter than length stay whole; rows that repeat a doc_id are the same
    document, each with its own text; null ids are one document before all others; no rows give none; other columns are ignored.
    """
    own = tagged(docs, shared_ids)
    left = None
    last = len(rounds(length)) - 1
    for k in range(last + 1):
        source = own if left is None else own.join(left, ["doc", "tag"])
        left = reranked(source.mapInArrow(ranked(k, length), RANKS))
        if k < last:
            left = cut(left)  # a round's shuffles are gone before the next one's

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, places in zip(batch["doc"].to_pylist(), batch["text"], batch["places"], strict=True):
                whole = (text.as_py() or "").encode()
                parts, gone, spans = kept_parts(whole, places.values.to_numpy(zero_copy_only=False) if places.is_valid else None, length)
                digest = hashlib.sha256()
                for p in parts:
                    digest.update(p)
                rows.append((None if doc == NONE else doc, len(whole), gone, spans, digest.hexdigest()))
            if rows:
                kinds = [*[pa.int64()] * 4, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in REPORT.split(", ")])

    return own.join(left, ["doc", "tag"], "left").select("doc", "text", "places").mapInArrow(report, REPORT)
