"""Ranked lexical search over inverted treaps: an index in shards of documents, each searched for all items at once."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, dropped, stored

TOP = 20
#: A shard of the index ends at so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 2_000_000
#: Terms of the items that are searched for in one job, as they go to every task; more items are several jobs over one index.
BLOCK_TERMS = 200_000
#: Numbers of the intervals that are open at once in a search, by terms.
CELLS = 400_000

#: Lower-casing bytes changes A-Z only, and the bytes of all letters beyond ASCII are above 127.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
INDEX = "ids array<bigint>, lengths binary, terms binary, starts binary, docs binary, tf binary, n_docs bigint, n_terms bigint"


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


class Shard:
    """Documents being gathered; row() gives their part of the index."""

    def __init__(self):
        self.ids, self.lengths, self.seen, self.tids, self.tfs = [], [], defaultdict(count().__next__), [], []
        self.postings = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        found = terms_of(text)
        if not found:
            return
        counts = Counter(found)
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.tids.append(np.fromiter(map(self.seen.__getitem__, counts), np.int64, len(counts)))
        self.tfs.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.postings += len(counts)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def row(self) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        docs = np.repeat(place, [len(t) for t in self.tids])
        tids, tfs = np.concatenate(self.tids), np.concatenate(self.tfs)
        by = np.argsort(tids * len(order) + docs)
        starts = np.concatenate([[0], np.cumsum(np.bincount(tids, minlength=len(self.seen)))])
        blobs = [np.array(self.lengths, "<i8")[order], b"\n".join(self.seen), starts.astype("<i4"), docs[by].astype("<u2"), tfs[by].astype("<i4")]
        ids = pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64()))
        sums = [pa.array([len(order)], pa.int64()), pa.array([sum(self.lengths)], pa.int64())]
        return pa.RecordBatch.from_arrays([ids, *(pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in blobs), *sums], [f.split()[0] for f in INDEX.split(", ")])


def inverted_index(docs: DataFrame) -> tuple[DataFrame, str]:
    """The index of docs(doc_id, text) as a table in spark.checkpoint.dir, and its path: a row a shard, with its documents by id
    and the postings of each of its terms by document.

    A shard holds what a task read together, up to SHARD_DOCS documents, so nothing is shuffled. Documents without terms are
    not in it; null ids come after all others; rows that repeat are documents of their own; no rows give none.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                shard.add(doc_id.as_py(), text.as_py() or b"")
                if shard.full():
                    yield shard.row()
                    shard = Shard()
        if shard.ids:
            yield shard.row()

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(of, INDEX), "index")


class Treaps:
    """One treap for each list of postings: documents in search order, impacts in heap order.

    Nodes are numbered list after list and by document, so a node is a place in the lists. Equal impacts are ordered by
    chance, which keeps trees flat. All trees grow at once from the top: the root of each part is its highest node, found by
    one pass a level.
    """

    def __init__(self, sizes: np.ndarray, docs: np.ndarray, impacts: np.ndarray):
        n = len(docs)
        ends = np.cumsum(sizes)
        self.doc, self.impact = docs.astype(np.int64), np.append(impacts, 0)  # node -1 is none, and adds nothing
        self.key = np.repeat(np.arange(len(sizes)), sizes) << 32 | self.doc
        by = np.lexsort((np.random.default_rng(n).permutation(n), impacts))
        rank = np.empty(n + 1, np.int64)
        rank[by], rank[n] = np.arange(n), 0
        child, self.root = np.full(2 * n, -1, np.int32), np.full(len(sizes), -1, np.int32)
        lo, hi, to, at = ends - sizes, ends, self.root, np.arange(len(sizes))
        while len(lo):  # parts stay in order, so that a level reads the ranks once
            top = by[np.maximum.reduceat(rank, np.stack([lo, hi], 1).ravel())[::2]]
            to[at] = top
            lo, hi, at = (np.stack(x, 1).ravel() for x in ((lo, top + 1), (top, hi), (2 * top, 2 * top + 1)))
            some = hi > lo
            lo, hi, at, to = lo[some], hi[some], at[some], child
        self.left, self.right = child[::2].copy(), child[1::2].copy()

    def split(self, nodes: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of treaps that hold the documents from lo to hi (and maybe others), the highest nodes before `at` and after it."""
        before, after = np.full(len(nodes), -1, np.int32), np.full(len(nodes), -1, np.int32)
        # a walk looks for one or both sides; at the document itself it parts
        walk, node, sides = np.arange(len(nodes)), nodes, np.full(len(nodes), 3, np.int8)
        while True:
            go = node >= 0
            walk, node, sides = walk[go], node[go], sides[go]
            if not len(walk):
                return before, after
            doc = self.doc[node]
            low, high, mid = lo[walk], hi[walk], at[walk]
            is_before = (doc < mid) & (doc >= low) & (sides & 1 > 0)
            is_after = (doc > mid) & (doc < high) & (sides & 2 > 0)
            before[walk[is_before]], after[walk[is_after]] = node[is_before], node[is_after]
            sides = sides & ~(is_before.astype(np.int8) | is_after.astype(np.int8) << 1)
            fork = np.flatnonzero((doc == mid) & (sides == 3))
            nxt = np.where((doc < mid) | (doc == mid) & (sides == 2), self.right[node], self.left[node])
            nxt[sides == 0] = -1
            other = self.right[node[fork]]
            sides[fork] = 1  # goes left for what is before; the other side goes right
            walk, node, sides = np.concatenate([walk, walk[fork]]), np.concatenate([nxt, other]), np.concatenate([sides, np.full(len(fork), 2, np.int8)])


class Best:
    """The k best (score, doc_id) of each item so far; a null id is after all others."""

    NULL = np.iinfo(np.int64).max

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.zeros((n, k), np.int64), np.full((n, k), self.NULL, np.int64)

    def take(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        own = np.unique(item)
        item = np.concatenate([np.repeat(own, self.k), item])
        score, ids = np.concatenate([self.score[own].ravel(), score]), np.concatenate([self.id[own].ravel(), ids])
        order = np.lexsort((ids, -score, item))
        item, score, ids = item[order], score[order], ids[order]
        begin = np.searchsorted(item, own)
        pick = begin[:, None] + np.arange(self.k)
        self.score[own], self.id[own] = score[pick], ids[pick]


def search(treaps: Treaps, items: np.ndarray, terms: np.ndarray, times: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Adds to best the documents of a shard for items[i], whose terms[i] (lists, -1 for none) occur times[i]; how many
    documents were scored comes back.

    An interval of documents holds for each term the highest node in it. Their impacts summed bound every score there;
    where that is below an item's last place, or as high only for later documents, the interval goes. Otherwise the document
    of the highest node is scored and the treaps are split there into the documents before and after.
    """
    width = terms.shape[1]
    chunk = max(1, CELLS // max(width, 1))
    root = np.append(treaps.root, -1)
    last = len(treaps.doc)
    stack = [(np.arange(len(items)), np.zeros(len(items), np.int64), np.full(len(items), len(ids)), root[terms])]
    scored = 0
    while stack:
        row, lo, hi, nodes = stack.pop()
        if len(row) > chunk:
            stack.append((row[chunk:], lo[chunk:], hi[chunk:], nodes[chunk:]))
            row, lo, hi, nodes = row[:chunk], lo[:chunk], hi[:chunk], nodes[:chunk]
        weight = treaps.impact[nodes] * times[row]
        bound = weight.sum(1)
        worst, worst_id = best.score[items[row], -1], best.id[items[row], -1]
        go = (bound > worst) | ((bound == worst) & (bound > 0) & (ids[np.minimum(lo, len(ids) - 1)] < worst_id))
        go &= bound > 0
        row, lo, hi, nodes, weight, bound = row[go], lo[go], hi[go], nodes[go], weight[go], bound[go]
        if not len(row):
            continue
        scored += len(row)
        at = treaps.doc[nodes[np.arange(len(row)), weight.argmax(1)]]
        want = (terms[row].astype(np.int64) << 32) | at[:, None]
        place = np.minimum(np.searchsorted(treaps.key, want), last - 1)
        hit = (treaps.key[place] == want) & (terms[row] >= 0)
        score = (np.where(hit, treaps.impact[place], 0) * times[row]).sum(1)
        good = score >= best.score[items[row], -1]
        if good.any():
            best.take(items[row[good]], score[good], ids[at[good]])
        wide = lambda x: np.repeat(x, width)
        before, after = treaps.split(nodes.ravel(), wide(lo), wide(hi), wide(at))
        both = [np.concatenate(x) for x in ((row, row), (lo, at + 1), (at, hi), (before.reshape(nodes.shape), after.reshape(nodes.shape)), (bound, bound))]
        left = np.flatnonzero((both[3] >= 0).any(1))
        left = left[np.argsort(-both[4][left], kind="stable")]
        if len(left):
            stack.append(tuple(x[left] for x in both[:4]))
    return scored


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of docs(doc_id, text) for each of items(item_id, text).

    Terms are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. The documents are indexed
    once, in shards; counts for the weights come from the index. Items go to every shard in blocks of bounded size; a task
    builds the treaps of the terms that are asked for there, searches them for all items of the block at once and carries the
    places of each item from shard to shard, so it returns `top` rows an item at most. The result is written, the index deleted.

    Null and empty texts have no terms: such documents are not counted, such items have no rows, nor have items without a match.
    Documents with equal scores come by id, null ids last; rows that repeat are documents, or items, of their own; no rows give
    none; other columns are ignored.
    """
    spark = docs.sparkSession
    result = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint"
    index, path = inverted_index(docs)
    asked = items.select("item_id", F.col("text").cast("binary").alias("text")).where("text is not null")
    sums = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0]
    blocks = -(-(size or 0) // (6 * BLOCK_TERMS)) if sums.n else 0
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    parts = [block_search(index, asked.where(block == b), int(sums.n), int(sums.l), top, result) for b in range(blocks)]
    out = cut(reduce(DataFrame.unionByName, [p for p in parts if p is not None], spark.createDataFrame([], result)))
    dropped(spark, path)
    return out


def block_search(index: DataFrame, asked: DataFrame, n_docs: int, n_terms: int, top: int, result: str) -> DataFrame | None:
    """The rows of ranked_search for some items, whose texts come to the driver."""
    rows = [(r.item_id, Counter(terms_of(bytes(r.text)))) for r in asked.collect()]
    rows = [r for r in rows if r[1]]
    if not rows:
        return None
    vocabulary = sorted({t for _, c in rows for t in c})
    number = {t: i for i, t in enumerate(vocabulary)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, starts in zip(batch["terms"], batch["starts"], strict=True):
                sizes = np.diff(np.frombuffer(starts.as_py(), "<i4"))
                for k, t in enumerate(terms.as_py().split(b"\n")):
                    if (i := number.get(t)) is not None:
                        df[i] += sizes[k]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], ["term", "df"])

    found = index.select("terms", "starts").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row a term of the items
    weight = np.zeros(len(vocabulary), np.int64)
    for r in found:
        weight[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
    # items by their number of terms, so that few cells of a group are empty.
    groups: dict[int, list[int]] = {}
    for i, (_, c) in enumerate(rows):
        groups.setdefault(len(c).bit_length(), []).append(i)
    asked_terms = {g: np.array([sorted(number[t] for t in rows[i][1]) + [-1] * ((1 << g) - len(rows[i][1])) for i in own]) for g, own in groups.items()}
    asked_times = {g: np.array([[rows[i][1][vocabulary[t]] if t >= 0 else 0 for t in ts] for i, ts in zip(own, asked_terms[g].tolist(), strict=True)], np.int64) for g, own in groups.items()}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(rows), top)
        for batch in batches:
            for r in range(batch.num_rows):
                blob = lambda c, kind: np.frombuffer(batch[c][r].as_py(), kind)  # noqa: B023, E731
                starts, docs, tf = blob("starts", "<i4"), blob("docs", "<u2"), blob("tf", "<i4").astype(np.int64)
                mine = [(k, i) for k, t in enumerate(batch["terms"][r].as_py().split(b"\n")) if (i := number.get(t)) is not None and weight[i] > 0]
                if not mine:
                    continue
                at, ours = np.array(mine).T
                sizes = starts[at + 1] - starts[at]
                take = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                docs, tf = docs[take], tf[take]
                long = np.array([75 + 25 * int(n) * n_docs // n_terms for n in blob("lengths", "<i8")], np.int64)
                impact = np.repeat(weight[ours], sizes) * (1_000_000_000 * tf // (1000 * tf + 12 * long[docs]))
                treaps = Treaps(sizes, docs, impact)
                local = np.full(len(vocabulary) + 1, -1)
                local[ours] = np.arange(len(ours))
                ids = batch["ids"][r].values.fill_null(Best.NULL).to_numpy()
                for g, own in groups.items():
                    search(treaps, np.array(own), local[asked_terms[g]], asked_times[g], ids, best)
        item, place = np.nonzero(best.score > 0)
        ids = best.id[item, place]
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, mask=ids == Best.NULL), pa.array(best.score[item, place])], ["item", "doc_id", "score"])

    hits = index.select("ids", "lengths", "terms", "starts", "docs", "tf").mapInArrow(of, "item int, doc_id long, score long")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= top)
    names = asked.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(rows)], f"{result.split(', ')[0]}, item int")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a row an item of the block
