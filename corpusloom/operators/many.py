"""Retrieval for a table of requests in one job: names resolved by indexes, texts and vectors searched for all requests in one scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_name, word_pattern
from ..memory import giving_back
from ..providers import embedded
from ..sources.tables import Workspace
from .names import best_names, name_matches
from .patterns import automaton, terms_within

#: Requests that are searched for in one scan, as they go to every task; more are several scans.
REQUESTS = 1_000
#: Texts that are matched at once, and numbers of a block of similarities or of texts by keywords.
TEXTS, CELLS = 512, 1_000_000
#: Keywords of a request, and stored names of a subject below which other names of the grade count too.
KEYWORDS, FEW = 6, 3

HITS = "n int, kind string, ord int, id long, similarity double"


def resolved_chapters(corpus: DataFrame, requests: DataFrame, work: Workspace) -> DataFrame:
    """req and its resolved chapters, for requests(req, subject, grade, chapters) on corpus(chapter, subject, grade).

    Candidates are the names of the grade whose subject contains the one asked for; with fewer than three, also names of
    the grade that hold the long words of one of the request's chapters in their order. Each chapter takes its best name, see
    names.best_names. Chapters without one go, unless no chapter of the request has any: then they stay as they are. A request
    without chapters has none.
    """
    names = work.keep(corpus.where("chapter is not null").select(F.col("grade").alias("scope"), F.lower("subject").alias("_subject"), F.col("chapter").alias("name")).distinct())
    asked = requests.select("req", F.col("grade").alias("scope"), F.lower("subject").alias("subject"), F.coalesce("chapters", F.array().cast("array<string>")).alias("chapters"))
    three = names.withColumn("rn", F.row_number().over(Window.partitionBy("scope", "_subject").orderBy("name"))).where(F.col("rn") <= FEW)
    pairs = asked.select("scope", "subject").distinct().join(three, "scope").where(F.col("_subject").contains(F.col("subject")))
    many = pairs.groupBy("scope", "subject").agg(F.count_distinct("name").alias("n")).where(F.col("n") >= FEW).select("scope", "subject", F.lit(False).alias("few"))
    patterns = F.transform("chapters", lambda c: word_pattern(normalize_name(c)))
    each = asked.join(many, ["scope", "subject"], "left").select("req", "scope", "subject", F.coalesce("few", F.lit(True)).alias("few"), patterns.alias("patterns"), F.posexplode("chapters").alias("ord", "requested"))
    each = work.keep(each.withColumn("_ask", F.struct("req", "ord")))
    found = name_matches(names.select("scope", "name"), each.select("_ask", "scope", "requested"))
    told = found.join(each.select("_ask", "scope", "subject", "few", "patterns"), "_ask").join(names, ["scope", "name"])
    own = told.where(F.col("_subject").contains(F.col("subject")) | (F.col("few") & F.expr("exists(patterns, p -> name ilike p)")))
    best = best_names(own.select("_ask", "tier", "norm", "name")).groupBy(F.col("_ask.req").alias("req")).agg(F.array_sort(F.collect_set("name")).alias("resolved"))  # the chapters of one request
    return requests.select("req", F.coalesce("chapters", F.array().cast("array<string>")).alias("chapters")).join(best, "req", "left").select("req", F.coalesce("resolved", "chapters").alias("chapters"))


def keywords_of(topics, chapters):
    """The parts of topics between commas of three characters and more, then the chapters: the first six, without those of one character."""
    parts = F.filter(F.flatten(F.transform(topics, lambda t: F.transform(F.split(t, ","), lambda p: F.trim(p)))), lambda w: F.length(w) >= 3)
    return F.filter(F.transform(F.slice(F.concat(parts, chapters), 1, KEYWORDS), lambda w: F.trim(w)), lambda w: F.length(w) >= 2)


class Block:
    """Requests that a task searches for: their filters, vectors and keywords, and the best hits so far."""

    def __init__(self, rows: list[tuple], k: int, n: int, relaxed: float):
        self.k, self.n, self.relaxed = k, n, relaxed
        self.grades = np.array([r[0] for r in rows], object)
        self.subjects = [r[1] for r in rows]
        self.any_chapter = np.array([not r[2] for r in rows], bool)
        self.by_chapter: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            for c in r[2]:
                self.by_chapter.setdefault(c, []).append(i)
        sizes = [len(r[4]) for r in rows if r[4]]
        self.dimension = sizes[0] if sizes else 0
        if any(s != self.dimension for s in sizes):
            raise ValueError("the vectors of requests must have one length")
        q = np.array([r[4] or [0.0] * self.dimension for r in rows], float).reshape(len(rows), self.dimension)
        length = np.sqrt((q * q).sum(1))
        self.vectors = q / np.where(length > 0, length, 1)[:, None]
        self.asks = length > 0
        slots = sorted((w, i, o) for i, r in enumerate(rows) for o, w in enumerate(r[3]))
        self.terms = sorted({w for w, *_ in slots})
        place = {w: t for t, w in enumerate(self.terms)}
        self.slot_term, self.slot_req, self.slot_ord = (np.array(x, np.int64) for x in (zip(*((place[w], i, o) for w, i, o in slots), strict=True) if slots else ([], [], [])))
        self.begin = np.searchsorted(self.slot_term, np.arange(len(self.terms) + 1))
        self.near = np.full((len(rows), k), -np.inf), np.full((len(rows), k), np.iinfo(np.int64).max)
        self.held = np.zeros(0, np.int64), np.zeros(0, np.int64)  # (slot, twice and one more for the wider search), id
        self.masks: dict[tuple, tuple] = {}
        self.automaton = automaton(self.terms)

    def allowed(self, grade: str, subject: str, chapter: str) -> tuple[np.ndarray, np.ndarray]:
        """Of the requests, those whose grade and subject fit, and those whose chapters do."""
        own = self.masks.get((grade, subject))
        if own is None:
            fits = np.array([subject is not None and s is not None and s in subject for s in self.subjects], bool)
            own = self.masks[grade, subject] = (self.grades == grade) & fits if grade is not None else np.zeros(len(self.subjects), bool)
        chapters = self.any_chapter.copy()
        chapters[self.by_chapter.get(chapter, [])] = True
        return own, chapters

    def add_vectors(self, ids: np.ndarray, vectors: pa.Array, go: np.ndarray) -> None:
        """go: which requests a row is for."""
        size = np.array([len(v) if v.is_valid else -1 for v in vectors])
        rows = np.flatnonzero((size == self.dimension) & go.any(1))
        if not len(rows) or not self.dimension:
            return
        v = np.array([vectors[int(r)].as_py() for r in rows], float)
        length = np.sqrt((v * v).sum(1))
        with np.errstate(invalid="ignore", divide="ignore"):
            s = np.round(v @ self.vectors.T / length[:, None], 6)
        s[~(go[rows] & self.asks) | ~(s > self.relaxed)] = -np.inf
        score, held = self.near
        floor = score[:, -1]
        if len(rows) > self.k:
            floor = np.maximum(floor, np.partition(s, len(rows) - self.k, axis=0)[len(rows) - self.k])
        at, req = np.nonzero((s >= floor) & (s > -np.inf))
        own = np.unique(req)
        who = np.concatenate([np.repeat(own, self.k), req])
        sims, found = np.concatenate([score[own].ravel(), s[at, req]]), np.concatenate([held[own].ravel(), ids[rows[at]]])
        order = np.lexsort((found, -sims, who))
        pick = order[np.searchsorted(who[order], own)[:, None] + np.arange(self.k)]
        score[own], held[own] = sims[pick], found[pick]

    def add_texts(self, ids: np.ndarray, texts: pa.Array, go: np.ndarray, chapters: np.ndarray) -> None:
        found = [sorted(t) for t in terms_within(texts, self.automaton, len(self.terms))]
        row, term = np.repeat(np.arange(len(found)), [len(t) for t in found]), np.array([x for t in found for x in t], np.int64)
        many = self.begin[term + 1] - self.begin[term]
        row, slot = np.repeat(row, many), np.repeat(self.begin[term] - np.concatenate([[0], np.cumsum(many)[:-1]]) if len(term) else many, many) + np.arange(many.sum())
        fits = go[row, self.slot_req[slot]]
        row, slot = row[fits], slot[fits]
        strict = chapters[row, self.slot_req[slot]]
        key = np.concatenate([self.held[0], 2 * slot[strict], 2 * slot + 1])
        own = np.concatenate([self.held[1], ids[row[strict]], ids[row]])
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        new = np.arange(len(key)) - np.searchsorted(key, key) < self.n
        self.held = key[new], own[new]

    def add(self, batch: pa.RecordBatch) -> None:
        combos = list(zip(*(batch[c].to_pylist() for c in ("grade", "subject", "chapter")), strict=True))
        at = {c: i for i, c in enumerate(dict.fromkeys(combos))}
        masks = [self.allowed(*c) for c in at]
        which = np.array([at[c] for c in combos], np.int64)
        ids = batch["id"].to_numpy(zero_copy_only=False)
        step = max(1, min(TEXTS, CELLS // max(1, len(self.subjects), len(self.slot_req))))
        for a in range(0, len(combos), step):
            w = which[a : a + step]
            own, chapters = np.array([masks[i][0] for i in w]), np.array([masks[i][1] for i in w])
            some = own.any(1)
            if some.any():
                take = np.flatnonzero(some)
                part = batch.slice(a, step).take(pa.array(take))
                self.add_vectors(ids[a : a + step][take], part["embedding"], own[take] & chapters[take])
                self.add_texts(ids[a : a + step][take], part["content"], own[take], chapters[take])

    def hits(self) -> pa.RecordBatch:
        score, held = self.near
        req, place = np.nonzero(score > -np.inf)
        slot = self.held[0] // 2
        n = np.concatenate([req, self.slot_req[slot]])
        kind = ["vector"] * len(req) + ["wide" if x else "strict" for x in self.held[0] % 2]
        order = np.concatenate([np.zeros(len(req), np.int64), self.slot_ord[slot]])
        ids = np.concatenate([held[req, place], self.held[1]])
        sims = np.concatenate([score[req, place], np.full(len(slot), 0.6)])
        return pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(kind, pa.string()), pa.array(order, pa.int32()), pa.array(ids, pa.int64()), pa.array(sims)], [f.split()[0] for f in HITS.split(", ")])


def fused(hits: DataFrame, k: int, n: int, threshold: float, most: int, rank_constant: int = 60) -> DataFrame:
    """n, id, rrf_score, similarity, source, pos of the hits of all tasks: for each request a vector list and a keyword list, and the
    sums of 1 / (60 + rank) of both."""
    first = lambda rows, by, order, m, name: rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= m)
    near = first(hits.where("kind = 'vector'"), ["n"], [F.desc("similarity"), "id"], k, "rn")
    near = near.withColumn("top", F.max("similarity").over(Window.partitionBy("n"))).where((F.col("top") <= threshold) | (F.col("similarity") > threshold))
    a = near.select("n", "id", (F.col("rn") - 1).alias("r1"), F.lit(None).cast("int").alias("r2"), F.col("similarity").alias("s1"), F.lit(None).cast("double").alias("s2"))
    found = first(hits.where("kind <> 'vector'"), ["n", "ord", "kind"], ["id"], n, "rn")
    found = found.withColumn("strict", F.max(F.col("kind") == "strict").over(Window.partitionBy("n", "ord"))).where((F.col("kind") == "strict") | ~F.col("strict"))
    found = found.groupBy("n", "id").agg(F.min(F.struct("ord", "rn")).alias("s"))
    found = first(found, ["n"], ["s"], n, "pos")
    b = found.select("n", "id", F.lit(None).cast("int").alias("r1"), (F.col("pos") - 1).alias("r2"), F.lit(None).cast("double").alias("s1"), F.lit(0.6).alias("s2"))
    both = a.unionByName(b).groupBy("n", "id").agg(*[F.max(c).alias(c) for c in ("r1", "r2", "s1", "s2")])
    part = lambda r: F.coalesce(F.lit(1.0) / (rank_constant + F.col(r) + 1), F.lit(0.0))
    both = both.select("n", "id", "r1", "r2", F.round(part("r1") + part("r2"), 9).alias("rrf_score"), F.coalesce("s2", "s1").alias("similarity"), F.when(F.col("r2").isNotNull(), "keyword").otherwise("vector").alias("source"))
    out = first(both, ["n"], [F.desc("rrf_score"), F.asc_nulls_last("r1"), F.asc_nulls_last("r2")], most, "pos")
    return out.select("n", "id", "rrf_score", "similarity", "source", "pos")


def retrieve_contexts(corpus: DataFrame, requests: DataFrame, work: Workspace, k: int = 8, n: int = 6, most: int = 10, threshold: float = 0.65, relaxed: float = 0.3, encode: Callable[[Sequence[str]], Sequence[Sequence[float]]] | None = None) -> DataFrame:
    """req, id, rrf_score, similarity, source, pos: the first `most` texts of corpus(id, chapter, subject, grade, content, embedding)
    for each of requests(req, subject, grade, chapters array, topics array).

    Chapters are resolved (see resolved_chapters). A vector list has the k nearest texts of the grade, subject and chapters
    above the threshold, or above the relaxed one if there are none. A keyword list has for each of up to six keywords n texts
    by id that contain it, of the grade, subject and chapters, or of all chapters if there are none; a text counts once,
    and n remain. Both are fused. A vector comes with the request (column vector), or its subject, grade, chapters and
    topics are embedded by `encode`.

    The corpus is read for its names, and once for each thousand requests: these go to every task, which compares blocks
    of vectors by one product and finds all keywords of a text by one automaton, and returns at most k + 12 * n rows a
    request. Ties go to the smaller id. Null texts and vectors match nothing; null grades and subjects never fit; no chapters
    mean all. req must be unique.
    """
    spark = corpus.sparkSession
    asked = requests.drop("chapters").join(resolved_chapters(corpus, requests, work), "req").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
    if "vector" not in requests.columns:
        text = F.concat_ws(" ", F.filter(F.concat(F.array("subject", "grade"), "chapters", "topics"), lambda p: p.isNotNull() & (p != "")))
        asked = embedded(asked.withColumn("_query", text), "_query", encode).withColumnRenamed("embedding", "vector")
    lowered = F.transform(keywords_of("topics", F.col("chapters")), F.lower)
    asked = work.keep(asked.select("req", "grade", F.lower("subject").alias("subject"), "chapters", lowered.alias("keywords"), F.col("vector").cast("array<double>").alias("vector")))
    blocks = -(-asked.count() // REQUESTS)
    rows = corpus.select(F.col("id").cast("long").alias("id"), "grade", F.lower("subject").alias("subject"), "chapter", F.lower("content").alias("content"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("req"), F.lit(blocks)) == b).orderBy("req").collect()
        if not part:
            continue

        def of(batches: Iterator[pa.RecordBatch], own=[tuple(r[1:]) for r in part]) -> Iterator[pa.RecordBatch]:
            block = Block(own, k, n, relaxed)
            for batch in batches:
                block.add(batch)
                del batch  # before the next one comes
                pa.default_memory_pool().release_unused()
            yield block.hits()

        found = fused(work.keep(rows.mapInArrow(giving_back(of), HITS)), k, n, threshold, most)  # written, as two lists are made of it
        ids = spark.createDataFrame([(i, r.req) for i, r in enumerate(part)], f"n int, req {requests.schema['req'].dataType.simpleString()}")
        found = found.join(F.broadcast(ids), "n").drop("n")  # a row a request of the block
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"req {requests.schema['req'].dataType.simpleString()}, id long, rrf_score double, similarity double, source string, pos int")
    return out.select("req", "id", "rrf_score", "similarity", "source", "pos")
