"""Documents with nearly the same word shingles: a Jaccard join with prefix filters under several token orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..memory import giving_back
from .bytesfast import BASE, INVERSE, mix, power, prefix_sums, text_blocks
from .common import connected_components, cut, even_join, gathered, parts_of

#: Two sets link when PER_CENT / 100 of their union is common.
WORDS, PER_CENT = 3, 90
ORDERS = 2
#: Members of a posting list that all its members are compared to before pairs are listed.
LEADERS = 24
BLOCK_BYTES = 2_000_000
#: Bits of the number of counters in the frequency sketch, between these by how many tokens there are, TOKENS a counter. The
#: sketch only orders tokens; any order gives the same links.
LEAST_BITS, MOST_BITS, TOKENS = 21, 22, 8
#: Counters of one slice, which one group adds up; a count reaches the driver as its binary logarithm, in so many steps an
#: octave: one byte a counter.
SLICE, STEPS = 1 << 15, 6
#: Bits of a set's parity map, in longs of 64.
LONGS = 8
#: Names of sets that a task remembers, so that it hands on copies of a text once; the rest are merged later.
REMEMBERED = 50_000
#: Ids of documents to fetch are broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_IDS = 200_000
#: Pairs of whole sets that a task verifies, and sets of a partition.
PAIRS = 1_000

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
TURNS = [np.uint64(pow(BASE, 3 + 2 * i, 1 << 64) | 1) for i in range(32)]


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct shingle names of each text, sorted; of a text with fewer words the name of them all; else none."""
    for _, data, marks in text_blocks(texts, BLOCK_BYTES):
        data = FOLD[data]
        white = np.ones(len(data) + 2, bool)
        white[1:-1] = WHITE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[marks] = True
        begin = np.flatnonzero(~white[1:-1] & (white[:-2] | edge[:-1]))
        end = np.flatnonzero(~white[1:-1] & (white[2:] | edge[1:])) + 1
        sums = prefix_sums(data)
        name = mix((sums[end] - sums[begin]) * power(INVERSE, len(data) + 1)[begin])
        at = np.searchsorted(begin, marks)
        n = len(name) - words + 1
        grams = sum((name[i : i + max(n, 0)] * TURNS[i] for i in range(words)), np.zeros(max(n, 0), np.uint64))
        grams = mix(grams)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                short = sum((name[a + i : a + i + 1] * TURNS[i] for i in range(b - a)), np.array([b - a], np.uint64))
                yield mix(short)
            else:
                yield np.zeros(0, np.uint64)


def set_names(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set."""
    if not len(tokens):
        return 0, 0
    a = mix(tokens + np.uint64(1))
    return int(np.add.reduce(a).astype(np.int64)), int(np.bitwise_xor.reduce(mix(a)).astype(np.int64))


def parity_map(tokens: np.ndarray) -> np.ndarray:
    """LONGS longs whose bits say for each of 64 * LONGS cells whether it holds an odd number of tokens.

    Common tokens cancel out, so the maps of two sets differ in at most as many bits as the sets have tokens not common.
    """
    cells = (mix(tokens ^ TURNS[20]) % np.uint64(64 * LONGS)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=64 * LONGS) & 1).astype(np.uint8)).view("<i8")


def prefix_length(n: int, per_cent: int) -> int:
    """So many of n tokens, by any order, hold a common one with every partner that can link."""
    return n - -(-per_cent * n // 100) + 1


def frequency_classes(docs: DataFrame, words: int, bits: int) -> np.ndarray:
    """For each of the 2^bits counters of the sketch how much fuller it is than the mean, in half octaves: 0 for the usual ones.

    Every task counts the tokens of its documents, by their first bits; slices of counters are added up by Spark, and
    2^bits bytes reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)

        def add(held: list[np.ndarray]) -> None:
            at, n = np.unique((np.concatenate(held) >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
            counts[at] += n.astype(np.uint32)

        for batch in batches:
            held, n = [], 0
            for t in shingle_sets(batch["text"], words):
                held.append(t)
                n += len(t)
                if n > 500_000:
                    add(held)
                    held, n = [], 0
            if held:
                add(held)
        for s in range(0, 1 << bits, SLICE):
            at = np.flatnonzero(counts[s : s + SLICE])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([counts[s + at].astype("<u4").tobytes()], pa.binary())], ["slice", "at", "n"])

    def added(part: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for at, n in zip(part["at"], part["n"], strict=True):
            total[np.frombuffer(at.as_buffer(), "<u2")] += np.frombuffer(n.as_buffer(), "<u4")
        steps = np.log2(np.maximum(total, 1)) * STEPS
        return pa.table({"slice": pa.array([part["slice"][0].as_py()], pa.int32()), "total": pa.array([int(total.sum())], pa.int64()), "steps": pa.array([steps.astype("u1").tobytes()], pa.binary())})

    sums = docs.select("text").mapInArrow(giving_back(count), "slice int, at binary, n binary").groupBy("slice").applyInArrow(added, "slice int, total long, steps binary").collect()
    steps = np.zeros(1 << bits, np.uint8)
    for r in sums:
        steps[r.slice : r.slice + SLICE] = np.frombuffer(r.steps, "u1")
    usual = np.log2(max(1.0, sum(r.total for r in sums) / (1 << bits)) / 0.75)
    classes = np.clip(np.floor(2 * (np.arange(256) / STEPS - usual)), 0, 255).astype(np.uint8)
    return classes[steps]


def ngram_components(docs: DataFrame, words: int = WORDS, per_cent: int = PER_CENT, leaders: int = LEADERS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id for each row of docs(doc_id, text).

    Sets that are equal are one class, found by their names. For different sets, a token order ranks a set's tokens; two
    sets that link share one of the first prefix_length tokens under every order. All orders put tokens that fill their
    sketch counter last and differ in the rest, so a pair must meet under each of them before it is verified.

    Their first common token must come early in both (early), and how many prefix tokens they share is bounded from below
    (shared_at_least); both drop most chance meetings. Parity maps bound from
    below how many tokens are not common (close), which drops most pairs just under the threshold before they are verified.

    Large groups of near copies would give all their pairs, so links are sought in two turns. First every posting list
    links its members to its `leaders` least members only; what is verified merges into components. That takes every pair of
    a list with few members, and of a longer list every pair with a leader, so a pair shares at most as many more tokens
    as either member has places beyond the leaders of such lists. Then, in those, members outside a list's largest component meet those of other components, and only pairs that
    meet under each order are verified. A pair that is never listed lies within a component, so the components are those
    of all links. Verification compares whole sets. Neither `leaders` nor broadcast_ids, which says up to how many ids of
    documents to verify are broadcast, changes the result.

    A text without words, empty or null has no shingles, links with nothing and is its own component; rows of one
    doc_id with different texts link each by their own sets, and text_hash (xxhash64 of the text) tells them apart; a null doc_id keeps its count, takes the component
    of the documents with an id that have the same set, and is never a component's id; a set that only rows without an id have
    links with nothing, so it joins no others, and its rows have no component; no rows give none; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(t), *set_names(t), parity_map(t)) for t in shingle_sets(batch["text"], words)]
            n, a, b, maps = zip(*rows, strict=True) if rows else ((), (), (), ())
            bits = np.array(maps, np.int64).reshape(len(rows), LONGS)
            columns = [pa.array(x, pa.int64()) for x in (n, a, b, *bits.T)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], *columns], ["doc_id", "text_hash", "n", "s1", "s2", *maps_of()])

    sets = cut(docs.mapInArrow(giving_back(slim), ", ".join(f"{c} long" for c in ("doc_id", "text_hash", "n", "s1", "s2", *maps_of()))))
    docs = docs.drop("text_hash")
    total, n_sets = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    classes = sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), *(F.min(c).alias(c) for c in maps_of()))
    classes = cut(classes.coalesce(parts_of(n_sets)))
    bits = min(MOST_BITS, max(LEAST_BITS, (total // TOKENS).bit_length()))
    parts = connected_components(*verified_links(docs, classes, n_sets, frequency_classes(docs, words, bits), words, per_cent, leaders, broadcast_ids))
    # a component's id is its least document, and a class's least document is in the class
    named = classes.join(parts.hint("merge"), classes["rep"] == parts["node"], "left").select(F.col("s1").bitwiseXOR(F.col("s2")).alias("x"), "s2", F.col("n").alias("_n"), F.coalesce("component", "rep").alias("component")).coalesce(parts_of(n_sets))
    every = sets.select("doc_id", "text_hash", "n", "s2", F.col("s1").bitwiseXOR(F.col("s2")).alias("x"))
    out = every.join(named.hint("merge"), (every["x"] == named["x"]) & (every["s2"] == named["s2"]) & (every["n"] == named["_n"]), "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def verified_links(docs: DataFrame, classes: DataFrame, n_classes: int, sketch: np.ndarray, words: int, per_cent: int, most: int, broadcast_ids: int) -> tuple[DataFrame, int]:
    """(a, b): enough links between classes, by their least documents, to connect all that any link connects; and how many.

    Only posting lists and their stars run on as many partitions as shuffles have. All other steps are cut where their rows
    are few and go on with partitions by their number, so plans stay small and tasks few: both cost the driver memory.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(sketch)  # a byte a counter, 2^MOST_BITS at most
    shift = np.uint64(64 - (len(sketch) - 1).bit_length())

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fuller, seen = frequent.value, set()
        for batch in batches:
            rows: list[tuple] = []
            for t in shingle_sets(batch["text"], words):
                name = set_names(t)
                if len(t) and name not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(name)
                    p, s1 = prefix_length(len(t), per_cent), name[0]
                    late = fuller[(t >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)
                    for order in range(ORDERS):
                        key = late | (mix(t ^ TURNS[8 + order]) >> np.uint64(8))
                        first = np.argpartition(key, p - 1)[:p]
                        first = t[first[np.argsort(key[first])]]
                        rows.append((order, s1, len(t), mix(first + np.uint64(order)).view(np.int64)))
                if len(rows) >= 4000:
                    yield as_batch(rows)
                    rows = []
            if rows:
                yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        order, s1, n, first = zip(*rows, strict=True)
        ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first)))
        return pa.RecordBatch.from_arrays([pa.array(order, pa.int32()), pa.array(s1, pa.int64()), pa.array(n, pa.int32()), tokens], ["ord", "s1", "n", "tokens"])

    rows = docs.select("text").mapInArrow(giving_back(prefixes), "ord int, s1 long, n int, tokens array<long>")
    rows = rows.select("ord", "s1", "n", F.posexplode("tokens").alias("pos", "token"))
    own = Window.partitionBy("token", "ord")
    size = lambda step: F.lag("n", step).over(own.orderBy("n"))
    rows = rows.withColumn("under", size(1)).withColumn("over", size(-1))
    # the members next in size cannot link with it, so none of this list can
    rows = rows.where(f"under * 100 >= n * {per_cent} or n * 100 >= over * {per_cent}").drop("under", "over")
    rows = rows.withColumn("nth", F.dense_rank().over(own.orderBy("s1"))).withColumn("members", F.max("nth").over(own)).where("members > 1")
    live = rows.groupBy("token", "ord", "s1", "n", "pos").agg(F.min("nth").alias("nth"), (F.max("members") > most + 1).alias("long"))
    live = cut(live.withColumn("k", F.struct("token", "ord")).drop("token", "ord"))
    leaders = live.where(F.col("nth") <= most).select("k", F.col("s1").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("ix"), F.col("nth").alias("mth"))
    stars = live.select("k", F.col("s1").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("iy"), "nth").join(leaders.hint("merge"), "k").where((F.col("mth") < F.col("nth")) & sized(per_cent))
    orders = range(ORDERS)
    stars = stars.groupBy("x", "y", "nx", "ny").agg(F.max(early(per_cent)).alias("soon"), *(F.count_if(F.col("k.ord") == o).alias(f"c{o}") for o in orders)).where("soon")
    inside = live.where(F.col("long") & (F.col("nth") > most)).groupBy("s1").agg(*(F.count_if(F.col("k.ord") == o).alias(f"in{o}") for o in orders))
    inside = cut(inside.coalesce(parts_of(8 * n_classes)))  # it adds up several rows a class
    for s in "xy":
        stars = stars.join(inside.toDF(s, *(f"{s}in{o}" for o in orders)).hint("merge"), s, "left")
    for o in orders:  # a list that both are in is missing here only if both are in it beyond its leaders
        stars = stars.where(F.col(f"c{o}") + F.expr(f"least(coalesce(xin{o}, 0), coalesce(yin{o}, 0))") >= shared_at_least(per_cent))
    stars, n = gathered(cut(stars.select("x", "y", "nx", "ny")))
    maps = classes.select("s1", *maps_of())
    stars = stars.join(maps.toDF("x", *maps_of("x")).hint("merge"), "x").coalesce(parts_of(n + n_classes)).join(maps.toDF("y", *maps_of("y")).hint("merge"), "y").where(close(per_cent))
    stars, n = gathered(cut(stars.select("x", "y").distinct().coalesce(parts_of(n + n_classes))))
    known, n_known = gathered(cut(links(docs, classes, n_classes, stars, n, words, per_cent, broadcast_ids)))
    parts = connected_components(known.select(F.col("x").alias("a"), F.col("y").alias("b")), n_known)
    joined = live.where(F.col("long") & (F.col("nth") > most)).join(parts.withColumnRenamed("node", "s1").hint("merge"), "s1", "left").select("k", "s1", "n", "pos", F.coalesce("component", "s1").alias("part"))
    joined, n = gathered(cut(joined))
    sizes = joined.groupBy("k", "part").agg(F.count("*").alias("c")).coalesce(parts_of(n))
    mixed = sizes.groupBy("k").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts").coalesce(parts_of(n))
    open_rows, n = gathered(cut(even_join(joined, mixed, "k").coalesce(parts_of(n))))
    if not n:
        return known.select("a", "b"), n_known
    open_rows = cut(open_rows.join(maps.hint("merge"), "s1").coalesce(parts_of(n + n_classes)).select("k", "s1", "n", "pos", "part", "main", *maps_of()))
    left = open_rows.where("part <> main").drop("main").toDF("k", "x", "nx", "ix", "px", *maps_of("x"))
    right = open_rows.toDF("k", "y", "ny", "iy", "py", "main", *maps_of("y"))
    once = (F.col("py") == F.col("main")) | (F.col("x") < F.col("y"))
    pairs = left.join(right.hint("merge"), "k").where((F.col("px") != F.col("py")) & once & sized(per_cent) & early(per_cent) & close(per_cent))
    pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.expr("shiftleft(1, k.ord)").alias("ord"))
    pairs = pairs.groupBy("x", "y").agg(F.bit_or("ord").alias("orders")).where(F.col("orders") == (1 << ORDERS) - 1).select("x", "y")
    pairs, n = gathered(cut(pairs.join(stars.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).hint("merge"), ["x", "y"], "left_anti")))
    if not n:
        return known.select("a", "b"), n_known
    return known.select("a", "b").unionByName(links(docs, classes, n_classes, pairs, n, words, per_cent, broadcast_ids).select("a", "b")), n_known + n


def sized(per_cent: int) -> Column:
    """Whether sets of nx and ny tokens can link at all."""
    return (F.col("nx") * 100 >= F.col("ny") * per_cent) & (F.col("ny") * 100 >= F.col("nx") * per_cent)


def least_common(per_cent: int) -> Column:
    """How many tokens linked sets of nx and ny tokens have in common at least."""
    return F.expr(f"({per_cent} * (nx + ny) + {99 + per_cent}) div {100 + per_cent}")


def maps_of(side: str = "") -> list[str]:
    return [f"{side}map{i}" for i in range(LONGS)]


def close(per_cent: int) -> Column:
    """Whether the parity maps differ in no more bits than linked sets of nx and ny tokens have tokens not common."""
    differ = sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(maps_of("x"), maps_of("y"), strict=True)), F.lit(0))
    return differ <= F.col("nx") + F.col("ny") - 2 * least_common(per_cent)


def early(per_cent: int) -> Column:
    """Whether a shared token, ix-th and iy-th from 0 under an order, is early enough to be the first one of linked sets.

    If the first common token were later in either set, less than least_common would be left from there on.
    """
    return (F.col("ix") <= F.col("nx") - least_common(per_cent)) & (F.col("iy") <= F.col("ny") - least_common(per_cent))


def shared_at_least(per_cent: int) -> Column:
    """How many prefix tokens sets of nx and ny tokens share if they link, under any order.

    Up to the smaller of the two last prefix tokens both prefixes hold all there is, and that is the whole prefix of one
    set. What comes after it in that set can be common too, nothing else: common <= shared + n - prefix_length(n).
    """
    rest = lambda n: F.expr(f"({per_cent} * {n} + 99) div 100 - 1")  # noqa: E731  n - prefix_length(n)
    return F.greatest(F.lit(1), least_common(per_cent) - F.greatest(rest("nx"), rest("ny")))


def links(docs: DataFrame, classes: DataFrame, n_classes: int, pairs: DataFrame, n_pairs: int, words: int, per_cent: int, broadcast_ids: int) -> DataFrame:
    """(x, y, a, b) for the n_pairs pairs (x, y) of set names whose whole sets link; a and b are the least documents of both."""
    names = pairs.select(F.col("x").alias("s1")).unionByName(pairs.select(F.col("y").alias("s1"))).distinct().coalesce(parts_of(2 * n_pairs))
    wanted, n = gathered(cut(classes.where("rep is not null").join(names.hint("merge"), "s1").select("s1", "rep").coalesce(parts_of(2 * n_pairs + n_classes))))
    few = n <= broadcast_ids
    ids = wanted.select(F.col("rep").alias("doc_id"), "s1")
    texts = docs.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = list(shingle_sets(part["text"], words))
                # a doc_id that repeats may carry other texts too
                own = pa.array([set_names(t)[0] == s for t, s in zip(sets, part["s1"].to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part["s1"], part["doc_id"], pa.array([t.astype("<u8").tobytes() for t in sets], pa.binary())], ["s1", "rep", "t"]).filter(own)

    held = texts.select("s1", "doc_id", "text").mapInArrow(giving_back(tokens), "s1 long, rep long, t binary")
    held = cut(held.groupBy("s1", "rep").agg(F.first("t").alias("t")).coalesce(parts_of(n, PAIRS)))
    both = pairs.join(held.toDF("x", "a", "tx").hint("merge"), "x").coalesce(parts_of(n_pairs, PAIRS))
    both = both.join(held.toDF("y", "b", "ty").hint("merge"), "y").coalesce(parts_of(n_pairs, PAIRS))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for p, q in zip(batch["tx"], batch["ty"], strict=True):
                s, t = np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8")
                at = np.searchsorted(s, t)
                common = int((s[np.minimum(at, len(s) - 1)] == t).sum()) if len(s) and len(t) else 0
                ok.append(100 * common >= per_cent * (len(s) + len(t) - common))
            yield batch.select(["x", "y", "a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("x", "y", "a", "b", "tx", "ty").mapInArrow(giving_back(verify), "x long, y long, a long, b long")
