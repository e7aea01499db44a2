"""SentencePiece encoding against the library; centroids and ranked search against brute-force versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from corpusloom.llm import centroids, pieces, ranked
from pyspark.sql import functions as F

CLASH = [f.split()[0] for f in (ranked.INDEX + ", " + centroids.STATE).split(", ")] + ["rank", "score", "item", "cluster", "distance", "n", "s", "df", "term", "row"]


def clashing(rows, *own):
    return rows.select("*", *[F.lit("x").alias(c) for c in dict.fromkeys(CLASH) if c not in own])


# ---- pieces


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def texts(n, seed):
    r = random.Random(seed)
    parts = ["a", "b", "e", "t", "h", " ", "  ", "\n", "\t", "é", "中", "文", "▁", "😀", "12", "the", "ing", "<s>", "</s>", "<0x0A>", "\0", "ि", "क", "\r", ".", "“.", "==", "İ", "Th", "--", " " * 20, "ation", "﻿", "²."]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_ids_and_decoding_as_the_library(library):
    own = pieces.pieces(pieces.MODEL)
    r = random.Random(2)
    every = list(own.id)
    joined = ["".join(r.choice(every) for _ in range(r.randint(1, 6))) for _ in range(3000)]
    long = ["a" * 50_000, " " * 30_001 + "x", "ab" * 30_000, "中" * 20_000, "the end " * 20_000]
    for text in [*texts(5000, 1), *joined, *long]:
        ids = library.encode(text)
        assert own.encode(text) == ids, text[:80]
        assert own.decode(ids) == library.decode(ids), text[:80]


def test_decoding_of_any_ids(library):
    own, r = pieces.pieces(pieces.MODEL), random.Random(3)
    for _ in range(2000):
        ids = [r.randrange(32_000) if r.random() < 0.5 else r.randrange(3, 259) for _ in range(r.randint(0, 9))]
        assert own.decode(ids) == library.decode(ids), ids


def test_pieces_that_merging_does_not_yield_are_not_used():
    own = pieces.pieces(pieces.MODEL)
    out = own.encode_run("the▁theory▁of▁them")
    assert "".join(out) == "the▁theory▁of▁them" and all(own.fits[p] for p in zip(out, out[1:], strict=False))
    assert not own.compatible(("t", "he"))


def test_piece_rows(spark, library):
    rows = [(1, "the cat"), (1, "the cat"), (None, "x\ny"), (2, None), (3, ""), (4, "z" * 1_000_000)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    got = [tuple(r) for r in pieces.pieces_round_trip(docs).collect()]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(ids := library.encode(t or "")), digest(",".join(map(str, ids))), digest(library.decode(ids))) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    encoded = pieces.encode_pieces(docs)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str) == sorted(((i, library.encode(t or "")) for i, t in rows), key=str)
    assert sorted((r.text for r in pieces.decode_pieces(encoded).collect()), key=str) == sorted((t or "" for _, t in rows), key=str)
    assert pieces.pieces_round_trip(docs.limit(0)).count() == 0


# ---- centroids


def lloyd(rows, k=8, rounds=10, d=64, scale=1024.0):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    kept = [r for r in kept if max(map(abs, r[1])) <= centroids.MOST]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min(range(len(centers)), key=lambda j: (far(v, centers[j]), j)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(centers)):
            if mine := [v for (_, v), o in zip(kept, own, strict=True) if o == j]:
                centers[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = assign()
    return [(i, o, far(v, centers[o])) for (i, v), o in zip(kept, own, strict=True)], centers


def vectors(seed, n=300, d=64, kinds=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(kinds, d))
    v = middle[rng.integers(kinds, size=n)] + 0.3 * rng.normal(size=(n, d))
    return [(int(i), [float(np.float32(x)) for x in row]) for i, row in enumerate(v / np.linalg.norm(v, axis=1)[:, None])]


def check_clusters(spark, rows, kind="double", **how):
    df = clashing(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3), "vec_id", "embedding")
    members, cents = centroids.elkan_clusters(df, **how)
    want, centers = lloyd(rows, how.get("k", 8), how.get("rounds", 10), how.get("dimension", 64), how.get("scale", 1024.0))
    assert sorted(map(tuple, members.collect()), key=str) == sorted(want, key=str)
    got = {r.cluster: r for r in cents.collect()}
    assert [got[j].centroid for j in range(len(centers))] == centers
    assert all(got[j].inertia == sum(x for _, o, x in want if o == j) and got[j].n == sum(o == j for _, o, _ in want) for j in got)


def test_clusters_as_by_hand(spark):
    check_clusters(spark, vectors(1))


def test_clusters_of_odd_rows(spark):
    v = vectors(2, 40)
    one = v[0][1]
    odd = [(1, None), (2, one[:63]), (3, [*one, 0.1]), (4, [*one[:63], None]), (5, [*one[:63], float("nan")]), (6, [*one[:63], float("inf")]), (7, [*one[:63], 1e9]), (8, [-1e5] * 64), (9, [0.0] * 64), (None, one), (None, v[5][1]), (3, one)]
    check_clusters(spark, [*v, *odd, *[(100 + i, one) for i in range(200)], *v[:10]])


def test_ties_go_to_the_smaller_centroid(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-2, 2)), float(rng.randint(-2, 2))]) for i in range(120)]
    for k in (1, 3, 8):
        check_clusters(spark, rows, k=k, rounds=4, dimension=2, scale=1.0)


def test_few_vectors_and_none(spark):
    check_clusters(spark, vectors(3, 3))
    members, cents = centroids.elkan_clusters(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))
    assert members.count() == cents.count() == 0


def test_bounds_spare_distances_and_lose_none():
    v = (np.array([x for _, x in vectors(5, 2000, kinds=8)]) * 1024).astype(np.int64)
    centers = v[:8].copy()
    own, upper, lower, every = centroids.first_bounds(v, centers)
    spared = 0
    for _ in range(6):
        new = np.array([v[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else centers[j] for j in range(8)])
        moved = centroids.above(centroids.squares(new, centers))
        centers = new
        own, upper, lower, n = centroids.next_bounds(v, own, upper, lower, centers, moved)
        far = np.stack([centroids.squares(v, c) for c in centers], 1)
        assert (own == far.argmin(1)).all() and (upper >= np.sqrt(far[np.arange(len(v)), own])).all() and (lower <= np.sqrt(far)).all()
        spared += every - n
    assert spared > 2 * every


# ---- ranked search


def by_hand(docs, items, top=20):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(ts), len(ts)) for i, t in docs if (ts := find(t))]
    total, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        asked = find(text)
        scores = [(sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * total // length))) for t in asked if t in c), i) for i, c, n in held]
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:top]
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return sorted(out, key=str)


def check_ranks(spark, docs, items, top=20):
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "doc_id", "text")
    q = clashing(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    assert sorted(map(tuple, ranked.ranked_search(d, q, top).collect()), key=str) == by_hand(docs, items, top)


def some_docs(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "ete", "中文", "x-y", "İ", "A", "a", "Straße"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(r.choices(words, weights, k=r.choice([1, 3, 20, 200])))) for i in range(n)]


def test_ranks_as_by_hand(spark, monkeypatch):
    docs = some_docs(1, 400)
    docs += [(1000 + i, docs[7][1]) for i in range(100)] + [(7, docs[7][1]), (None, docs[7][1]), (None, "w3"), (5000, None), (5001, ""), (5002, "--"), (5003, "w1 " * 50_000)]
    items = [(i, t) for i, (_, t) in enumerate(some_docs(2, 30))] + [(0, "w1 w1 w2"), (None, "w5"), (90, None), (91, ""), (92, "no match here"), (93, docs[7][1])]
    check_ranks(spark, docs, items)
    monkeypatch.setattr(ranked, "SHARD_DOCS", 37)
    monkeypatch.setattr(ranked, "CELLS", 64)
    check_ranks(spark, docs, items, 3)


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 20)
    check_ranks(spark, some_docs(3, 60), [(i, t) for i, (_, t) in enumerate(some_docs(4, 12))])


def test_no_documents_and_no_items(spark):
    docs, items = spark.createDataFrame(some_docs(1, 5), "doc_id long, text string"), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranked.ranked_search(docs.limit(0), items).count() == ranked.ranked_search(docs, items.limit(0)).count() == 0
    assert ranked.ranked_search(docs.where("false").unionByName(spark.createDataFrame([(1, None)], "doc_id long, text string")), items).count() == 0


def test_treaps_are_ordered_and_spare_documents():
    rng = np.random.default_rng(6)
    sizes = np.array([1, 400, 30, 2000])
    docs = np.concatenate([np.sort(rng.choice(2000, s, replace=False)) for s in sizes])
    impacts = rng.integers(1, 50, len(docs))
    t = ranked.Treaps(sizes, docs, impacts)
    ends = np.cumsum(sizes)
    for root, lo, hi in zip(t.root, ends - sizes, ends, strict=True):
        seen, stack = [], [(int(root), lo, hi)]
        while stack:
            x, a, b = stack.pop()
            if x < 0:
                assert a == b
                continue
            assert a <= x < b and impacts[x] == impacts[a:b].max()
            seen.append(x)
            stack += [(int(t.left[x]), a, x), (int(t.right[x]), x + 1, b)]
        assert len(seen) == hi - lo
    impacts[ends[0] + 5] = 10_000
    t = ranked.Treaps(sizes, docs, impacts)
    best = ranked.Best(1, 1)
    scored = ranked.search(t, np.array([0]), np.array([[0, 1, 2, 3]]), np.ones((1, 4), np.int64), np.arange(2000), best)
    assert best.id[0, 0] == docs[ends[0] + 5] and scored < 20
