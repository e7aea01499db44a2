"""Exact top-k search by a Voronoi join, and near-duplicate vectors by PCA-ordered tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, cut, parts_of

#: Pivots are about the square root of all vectors, chosen by a hash of their ids, in these bounds; they steer the work,
#: not the result, and come to the driver.
PIVOTS, MOST_PIVOTS = 64, 2048
PACK, QUERY_PACK = 4096, 512
#: A query travels once to each bin of neighbouring groups that it needs; there are about so many bins, some more as groups
#: fill them unevenly, so copies grow with the queries.
BINS = 128
#: Results that a task gathers before it keeps the best of each query.
HELD = 1_000_000
#: The rotation is fitted on so many vectors at most, chosen by a hash of their ids; it orders the work, not the result.
PCA_ROWS = 4096
TILE, THRESHOLD = 1024, 0.93
#: Numbers of the vectors of surviving pairs that are gathered at once, on either side.
SLICE = 2_000_000
#: Numbers of the vectors of one tile, at most, beyond TILE vectors.
TILE_NUMBERS = 4_000_000


def fixed(pack: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pack, "<f8").reshape(n, -1)


def best(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, data row, score) of the k best of each query; equal scores go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    data, ids = data[order], ids[order]
    n = len(ids)
    top = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * queries.shape[1]
    if (top + 1) * 2 * n < 2**53:
        score = queries @ data.T  # sums of whole numbers this small are exact
        key = score * n
        key += np.arange(n - 1, -1, -1)
        low, high = np.searchsorted(ids, query_ids), np.searchsorted(ids, query_ids, "right")
        for r in np.flatnonzero(high > low):  # a query is not its own neighbour
            key[r, low[r] : high[r]] = -np.inf
        k = min(k, n)
        at = np.argpartition(key, n - k, axis=1)[:, n - k :]
        row, col = np.repeat(np.arange(len(queries)), k), at.ravel()
        ok = np.isfinite(key[row, col])
        return row[ok], order[col[ok]], score[row[ok], col[ok]].astype(np.int64)
    found = []
    whole = [[int(x) for x in v] for v in data]
    for r, q in enumerate(queries):
        q = [int(x) for x in q]
        near = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), c) for c, v in enumerate(whole) if ids[c] != query_ids[r])[:k]
        found += [(r, int(order[c]), -s) for s, c in near]
    row, col, score = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    return row, col, score


def leading(query_ids: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query id, best first; a repeated id counts once with its best score, equal scores go to the smaller id."""

    def begins(*keys: np.ndarray) -> np.ndarray:
        """Whether a row differs from the one before in some key."""
        return np.concatenate([[True], np.any([x[1:] != x[:-1] for x in keys], axis=0)]) if len(keys[0]) else np.zeros(0, bool)

    order = np.lexsort((-score, ids, query_ids))
    order = order[begins(query_ids[order], ids[order])]
    order = order[np.lexsort((ids[order], -score[order], query_ids[order]))]
    new = begins(query_ids[order])
    rank = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    order = order[rank < k]
    return query_ids[order], ids[order], score[order]


def neighbourhoods(p: np.ndarray, weight: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the pivots p in lists of neighbours that weigh `most` at most together, or hold one pivot: halves across the widest axis."""
    todo, found = [np.arange(len(p))] if len(p) else [], []
    while todo:
        at = todo.pop()
        total = np.cumsum(weight[at])
        if len(at) == 1 or total[-1] <= most:
            found.append(at)
            continue
        at = at[np.argsort(p[at, p[at].var(0).argmax()], kind="stable")]
        half = np.clip(np.searchsorted(np.cumsum(weight[at]), total[-1] / 2) + 1, 1, len(at) - 1)
        todo += [at[half:], at[:half]]
    return found


def voronoi_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, n_pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query's vector with all other vectors.

    Components become floor(scale * x), so scores are whole numbers and exact. Every vector joins the group of its
    nearest pivot. From a group's summary (distinct ids, radius) follow bounds of what its members can score with a query: those
    of the best groups give a score that k vectors reach for sure, and groups that cannot reach it get no copy of the
    query. Neighbouring groups share a bin, and a large group has several. Queries and data travel in packs of bounded size, a query
    once to each bin with a group that it needs, and each pair of packs there is solved by one product of matrices; of the results
    of a task only k a query go on.

    Vectors that are null or hold null or non-finite components, and null ids, take no part, nor do vectors with a component
    so large that d squares of it, once scaled, pass 2**62, as scores must fit a long; vectors of different lengths
    don't meet, and lengths without a pivot are groups of their own; fewer than k others give all; a repeated (query_id, vec_id) counts once with its best
    score; ties go to the smaller vec_id; no rows give none; other columns are ignored.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("is_query"))
    sound = ~F.array_contains("embedding", F.lit(float("nan")))  # null, so not true, if a component is null
    farthest = F.greatest(F.array_max("embedding"), -F.array_min("embedding"))  # null without components
    most = F.sqrt(F.lit(2.0**62) / F.size("embedding")) - 1
    rows = rows.where(sound).where(farthest < float("inf")).where(farthest * abs(scale) <= most)
    if n_pivots is None:
        n_pivots = min(MOST_PIVOTS, max(PIVOTS, int(rows.count() ** 0.5)))
    chosen = [np.floor(scale * np.array(r.embedding)) for r in rows.orderBy(F.xxhash64(F.lit("pivot"), "vec_id"), "vec_id").limit(n_pivots).collect()]
    result = "query_id long, rank int, vec_id long, score long"
    if not chosen:
        return vectors.sparkSession.createDataFrame([], result)
    # pivots by length; a cell is the place of its pivot among all, or minus a length that has none
    pivots = {d: (np.array([i for i, p in enumerate(chosen) if len(p) == d]), np.array([p for p in chosen if len(p) == d])) for d in {len(p) for p in chosen}}

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch["embedding"].offsets.to_numpy())
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                v = np.floor(scale * part["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                own, far = np.full(len(v), -d), np.zeros(len(v))
                if d in pivots:
                    at, p = pivots[d]
                    all_far = np.maximum((v**2).sum(1)[:, None] - 2 * v @ p.T + (p**2).sum(1), 0)
                    near = all_far.argmin(1)
                    own, far = at[near], np.sqrt(all_far[np.arange(len(v)), near])
                yield pa.RecordBatch.from_arrays(
                    [part["vec_id"], part["is_query"], pa.array(own, pa.int32()), pa.array(far, pa.float64()), pa.array([x.tobytes() for x in v.astype("<f8")], pa.binary())],
                    ["vec_id", "is_query", "cell", "far", "v"],
                )

    placed = cut(rows.mapInArrow(assigned, "vec_id long, is_query boolean, cell int, far double, v binary"))  # read four times
    sums = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.sum(F.col("is_query").cast("int")).alias("q")).collect()}  # one row a pivot or length
    cells = sorted(sums)
    # a repeated vec_id is one vector, counted in one of its groups
    ids = {r.cell: r.n for r in placed.groupBy("vec_id").agg(F.min("cell").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    groups = {}
    for d, (at, p) in pivots.items():
        own = np.array([c for c in cells if c in set(at.tolist())], int)
        groups[d] = own, p[np.searchsorted(at, own)], np.array([ids.get(c, 0) for c in own]), np.array([sums[c].radius for c in own]) * (1 + 1e-9) + 1e-6

    def binned(counts: dict[int, int], most: int) -> tuple[dict[int, int], dict[int, int]]:
        """By cell its first bin and how many it has. A bin gets about `most` of what counts has, from cells that are neighbours or from one."""
        first, several, n = {}, {}, 0
        lists = [own[x] for own, p, _, _ in groups.values() for x in neighbourhoods(p, np.array([counts[c] for c in own]), most)]
        for some in [*lists, *([c] for c in cells if c < 0)]:
            parts = max(1, -(-sum(counts[c] for c in some) // most))
            for c in some:
                first[int(c)], several[int(c)] = n, parts
            n += parts
        return first, several

    def bin_of(bins: tuple[dict[int, int], dict[int, int]], salt: str) -> Column:
        first, several = (F.create_map(*[F.lit(x) for at in of.items() for x in at])[F.col("cell")] for of in bins)
        return (first + F.pmod(F.xxhash64(F.lit(salt), "vec_id"), several)).cast("int")

    most = max(PACK, -(-sum(r.n for r in sums.values()) // BINS))
    slots = -(-most // PACK)
    first, several = binned({c: sums[c].n for c in cells}, most)

    def needed(v: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Bins that some of these queries need, and which of them."""
        d = v.shape[1]
        if d not in groups:
            return [(first[-d] + x, np.arange(len(v))) for x in range(several[-d])]
        own, p, size, radius = groups[d]
        middle, spread = v @ p.T, np.sqrt((v**2).sum(1))[:, None] * radius
        low, high = middle - spread, middle + spread
        order = np.argsort(-low, axis=1)
        sure = np.cumsum(size[order], axis=1) >= k + 1  # one of them may be the query itself
        at = np.where(sure.any(1), sure.argmax(1), len(own) - 1)
        floor = low[np.arange(len(v)), order[np.arange(len(v)), at]]
        floor = np.where(sure.any(1), floor, -np.inf)
        needs = high >= floor[:, None] - 1e-6
        begins = np.array([first[int(c)] for c in own])
        to = [(int(b), np.flatnonzero(needs[:, begins == b].any(1))) for b in np.unique(begins)]
        parts = {first[int(c)]: several[int(c)] for c in own}
        return [(b + x, rows) for b, rows in to if len(rows) for x in range(parts[b])]

    def pack(key, part):  # frames of pandas, which only tasks import
        import pandas as pd

        part = part.sort_values(["vec_id", "v"], kind="stable").drop_duplicates(["vec_id", "v"])
        return pd.DataFrame({"bin": [key[0]], "ids": [part["vec_id"].to_numpy("<i8").tobytes()], "vs": [b"".join(part["v"])]})

    def pack_queries(key, part):
        import pandas as pd

        one = pack(key, part)
        ids = np.frombuffer(one["ids"][0], "<i8")
        v = fixed(one["vs"][0], len(ids))
        to = needed(v)
        return pd.DataFrame({"bin": [b for b, _ in to], "q_ids": [ids[rows].tobytes() for _, rows in to], "qs": [v[rows].tobytes() for _, rows in to]})

    # both by the places of their cells: a pack of queries from neighbouring cells needs much the same bins
    data = placed.withColumn("bin", bin_of((first, several), "bin")).groupBy("bin", F.pmod(F.xxhash64(F.lit("slot"), "vec_id"), F.lit(slots)).alias("slot")).applyInPandas(pack, "bin int, ids binary, vs binary")
    asking = {c: sums[c].q or 0 for c in cells}
    queries = placed.where("is_query").withColumn("bin", bin_of(binned(asking, QUERY_PACK), "queries"))
    # by number, as Spark would deal so few rows to one task, which writes all their copies
    asked = queries.repartition(parts_of(sum(asking.values()), 4 * QUERY_PACK), "bin").groupBy("bin").applyInPandas(pack_queries, "bin int, q_ids binary, qs binary")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, n = ["query_id", "vec_id", "score"], [], 0
        for batch in batches:
            for q_ids, qs, ids, vs in zip(*(batch[c] for c in ("q_ids", "qs", "ids", "vs")), strict=True):
                a, b = np.frombuffer(q_ids.as_py(), "<i8"), np.frombuffer(ids.as_py(), "<i8")
                most = int(np.unique(b, return_counts=True)[1].max())  # so many rows can be one vec_id
                row, col, score = best(fixed(qs.as_py(), len(a)), a, fixed(vs.as_py(), len(b)), b, k * most)
                held.append((a[row], b[col], score))
                n += len(row)
                if n > HELD:
                    held = [leading(*map(np.concatenate, zip(*held, strict=True)), k)]
                    n = len(held[0][0])
                    if 2 * n > HELD:  # so many queries that little falls away
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names)
                        held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in leading(*map(np.concatenate, zip(*held, strict=True)), k)], names)

    # Spark takes the copies of the queries for as small as the queries are and would broadcast them; the hint forbids that
    pairs = asked.hint("merge").join(data, "bin").select("q_ids", "qs", "ids", "vs")
    found = pairs.mapInArrow(solve, "query_id long, vec_id long, score long").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(v: np.ndarray) -> np.ndarray:
    """A vector times the power of two that brings its largest component to about 1, so that squares neither vanish nor overflow."""
    return np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))


def rotation(vectors: DataFrame) -> np.ndarray:
    """Principal axes, the widest first, of a bounded sample of unit vectors; without vectors an empty matrix."""
    sample = [scaled(np.array(r.embedding)) for r in vectors.orderBy(F.xxhash64(F.lit("pca"), "vec_id"), "vec_id").select("embedding").limit(PCA_ROWS).collect()]
    if not sample:
        return np.zeros((0, 0))
    x = np.array([v / np.linalg.norm(v) for v in sample if len(v) == len(sample[0])])
    values, axes = np.linalg.eigh(x.T @ x)  # about the origin, as cosines are
    return axes[:, np.argsort(-values)]


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, steps: tuple[int, ...] = (8, 24)) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of a and j of b whose cosine is at least threshold.

    Products over the leading axes come first; what the other axes can add is bounded by the product of the norms that
    are left there. Pairs that cannot reach the threshold stop; the rest get their cosine from the vectors as given, some at a time.
    """
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ra, rb = a / na[:, None], b / nb[:, None]
    if len(axes) == a.shape[1]:
        ra, rb = ra @ axes, rb @ axes
    steps = [s for s in steps if s < a.shape[1]] or [a.shape[1]]
    rest = {(k, s): np.sqrt(np.maximum((r[:, s:] ** 2).sum(1), 0)) for k, r in enumerate((ra, rb)) for s in steps}
    s = steps[0]
    part = ra[:, :s] @ rb[:, :s].T
    i, j = np.nonzero(part + np.outer(rest[0, s], rest[1, s]) >= threshold - 1e-9)
    part = part[i, j]
    found_i, found_j = [], []
    for at in range(0, len(i), slice_ := max(256, SLICE // a.shape[1])):  # pairs whose vectors are gathered at once
        p, q, x = i[at : at + slice_], j[at : at + slice_], part[at : at + slice_]
        for s, t in zip(steps, steps[1:], strict=False):
            x = x + np.einsum("nd,nd->n", ra[p, s:t], rb[q, s:t])
            go = x + rest[0, t][p] * rest[1, t][q] >= threshold - 1e-9
            p, q, x = p[go], q[go], x[go]
        ok = np.einsum("nd,nd->n", a[p], b[q]) / (na[p] * nb[q]) >= threshold
        found_i.append(p[ok])
        found_j.append(q[ok])
    none = np.zeros(0, int)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the edges (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row: links join vectors of one label with cosine >= threshold.

    Within a label, vectors are cut into cells along the first principal axis, so wide that links only join the same or
    neighbouring cells, and cells into tiles by a hash, of about `tile` vectors, or 8 times the square root of a cell if that is
    more; blocks of `tile` vectors are compared at once. Every two tiles that can hold links meet
    in one task, whatever the size of their label; see linked() for the early stop. A task reports for each vector how
    many links it has there and the smallest vector it is connected to, never the pairs, so a group of n copies gives
    rows in proportion to n. Components then follow from those stars.

    Vectors that are null or zero or hold null or non-finite components, and null labels, link with nothing: n_links 0,
    their own component. Vectors are scaled by powers of two, so very small and very large ones count like others. Vectors of different lengths don't link, nor do rows with the same vec_id; such rows share one result. A null
    vec_id gives n_links 0 and a null component and kept. No rows give none; other columns are ignored.
    """
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    valid = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = every.where(valid).where(sound)
    axes = rotation(rows)
    width = float(np.sqrt(max(2 - 2 * threshold, 1e-12))) * (1 + 1e-9)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = [scaled(x.values.to_numpy(zero_copy_only=False)) for x in batch["embedding"]]
            cell = [int(np.floor((v @ axes[:, 0] / np.linalg.norm(v) if len(v) == len(axes) else 0.0) / width)) for v in vs]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"].cast(pa.string()), pa.array([len(v) for v in vs], pa.int32()), pa.array(cell, pa.int32()), pa.array([v.astype("<f8").tobytes() for v in vs], pa.binary())], ["vec_id", "label", "dim", "cell", "v"])

    cells = rows.mapInArrow(placed, "vec_id long, label string, dim int, cell int, v binary")
    # a tile grows with the square root of its cell, so copies of vectors grow slower than pairs of tiles
    most = F.greatest(F.lit(float(tile)), F.least(tile / 128 * F.sqrt(F.count("*").cast("double")), TILE_NUMBERS / F.col("dim")))
    tiles = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / most).cast("int").alias("tiles"))
    after = tiles.select("label", "dim", (F.col("cell") - 1).alias("cell"), F.col("tiles").alias("next_tiles"))
    tiles = tiles.join(after, ["label", "dim", "cell"], "left").select("label", "dim", "cell", "tiles", F.coalesce("next_tiles", F.lit(0)).alias("next_tiles"))
    before = tiles.select("label", "dim", (F.col("cell") + 1).alias("cell"), F.col("tiles").alias("last_tiles"))
    tiles = tiles.join(before, ["label", "dim", "cell"], "left").select("*", F.coalesce("last_tiles", F.lit(0)).alias("_last")).drop("last_tiles")
    dealt = cells.join(tiles, ["label", "dim", "cell"]).withColumn("tile", F.pmod(F.xxhash64(F.lit("tile"), "vec_id"), "tiles").cast("int"))
    # a meeting is (cell, tile, cell, tile), the smaller first; a vector goes to every meeting of its tile
    meet = lambda c1, t1, c2, t2, side: F.struct(c1.alias("c1"), t1.alias("t1"), c2.alias("c2"), t2.alias("t2"), F.lit(side).alias("side"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cell, own = F.col("cell"), F.col("tile")
    meetings = F.concat(
        F.transform(upto(F.col("tiles")), lambda t: F.when(t >= own, meet(cell, own, cell, t, 0)).otherwise(meet(cell, t, cell, own, 1))),
        F.transform(upto(F.col("next_tiles")), lambda t: meet(cell, own, cell + 1, t, 0)),
        F.transform(upto(F.col("_last")), lambda t: meet(cell - 1, t, cell, own, 1)),
    )
    met = dealt.select("label", "dim", "vec_id", "v", F.inline(meetings))

    def compare(key, part):  # frames of pandas, which only tasks import
        import pandas as pd

        same = key[2] == key[4] and key[3] == key[5]
        side = part["side"].to_numpy()
        ids = part["vec_id"].to_numpy(np.int64)
        v = np.frombuffer(b"".join(part["v"]), "<f8").reshape(len(part), -1)
        a = np.flatnonzero(side == 0)
        b = a if same else np.flatnonzero(side == 1)
        if not len(a) or not len(b):
            return pd.DataFrame({"vec_id": [], "n": [], "root": []})
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), int)
        place[order] = np.arange(len(ids))
        n, root = np.zeros(len(ids), int), np.arange(len(ids))
        for p in range(0, len(a), tile):
            for q in range(p if same else 0, len(b), tile):
                i, j = linked(v[a[p : p + tile]], v[b[q : q + tile]], axes, threshold)
                i, j = a[p + i], b[q + j]
                go = (i < j) & (ids[i] != ids[j]) if same else ids[i] != ids[j]
                i, j = i[go], j[go]
                n += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
                if len(i):
                    root = local_roots(len(ids), np.concatenate([place[i], np.arange(len(ids))]), np.concatenate([place[j], root]))
        root = ids[order[root[place]]]
        at = np.flatnonzero(n)
        return pd.DataFrame({"vec_id": ids[at], "n": n[at], "root": root[at]})

    found = cut(met.groupBy("label", "dim", "c1", "t1", "c2", "t2").applyInPandas(compare, "vec_id long, n long, root long"))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    parts = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "vec_id")
    out = every.select("vec_id").join(counts, "vec_id", "left").join(parts, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
