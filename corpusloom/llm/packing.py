"""Hierarchical multi-length packing of tokenized documents."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..memory import give_back, giving_back
from .common import Words

TOKENIZER = "byte_bpe_50k.json"
WINDOW, TIERS, END_ID = 2048, (2048, 1024, 512, 256), 1
#: A gap of fewer tokens is padded; a document is not cut for it.
MIN_FILL = 16
#: Documents that are packed together. More give less padding, fewer give smaller tasks.
GROUP_DOCS = 2048

#: The tokenizer's own splitting pattern, for texts of these characters only, where it needs no Unicode tables.
LATIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼½¾]+| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]+|\s+(?!\S)|\s+")
OUTSIDE = re.compile("[^\t-\r\x20-\x7e\xa1-\xff]")
CACHE_WORDS = 100_000
#: Rows, and bytes of ids, that a task hands on at once.
HELD_ROWS, HELD_BYTES = 20_000, 2_000_000


def as_bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class ByteEncoder:
    """The ids of a text as little-endian unsigned 32-bit integers, equal to those of the tokenizers library.

    Words are looked up in a bounded cache; new ones go to tiktoken, which holds the same vocabulary as ranks. A text
    with special tokens or characters outside Latin-1 goes through the library itself.
    """

    def __init__(self, name: str = TOKENIZER):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(name))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.word = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary  # a word is one piece
        self.words = Words(lambda w: as_bytes(self.word(w)), CACHE_WORDS)

    def __call__(self, text: str) -> bytes:
        if OUTSIDE.search(text) or any(s in text for s in self.special):
            return as_bytes(self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.words.__getitem__, LATIN_SPLIT.findall(text)))


@lru_cache(1)
def encoder(name: str) -> ByteEncoder:
    return ByteEncoder(name)


TOKENS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def tokenized(name: str, window: int):
    """For mapInArrow: a document's full windows, without ids, and its rest of 1 to window - 1 ids with them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = encode(text.as_py() or "") + end
                n, view = len(ids) // 4, memoryview(ids)
                for s in range(0, n, window):
                    piece = view[4 * s : 4 * (s + window)]
                    k = len(piece) // 4
                    rows.append((doc_id, s, k, zlib.crc32(piece), n, None if k == window else bytes(piece)))
                    held += 0 if k == window else 4 * k
                if len(rows) >= HELD_ROWS or held >= HELD_BYTES:
                    yield arrow(rows)
                    rows, held = [], 0
            if rows:
                yield arrow(rows)

    return giving_back(of)


def arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in TOKENS.split(", ")])


def fill(lengths: list[int], window: int = WINDOW, tiers: tuple[int, ...] = TIERS, min_fill: int = MIN_FILL) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(tier, [(piece, from, to)]) for each sequence of pieces of 1 to window - 1 tokens; tiers are halves of the window.

    A piece is routed to the smallest tier that holds it. Each tier, from the longest down, is packed in windows of its own
    size: a piece of the tier opens one, and the gap takes the longest pieces that fit, which come from the shorter tiers.
    Then gaps that whole pieces left are filled by cutting the pieces of the emptiest windows, the shortest tier first. A
    window of the longest tier may keep a gap below min_fill; a shorter one is full or dissolved, as only full ones need
    no padding. What the last open window holds is cut to the sizes of the tiers.
    """
    sizes = sorted({window, *(t for t in tiers if t < window)})
    pool = sorted((n, i) for i, n in enumerate(lengths))
    done: list[tuple[int, list[tuple[int, int, int]]]] = []
    loose: list[tuple[int, int, list[tuple[int, int, int]]]] = []
    for size, below in zip(reversed(sizes), [*reversed(sizes[:-1]), 0], strict=True):
        while pool and pool[-1][0] > below:
            n, i = pool.pop()
            gap, now = size - n, [(i, 0, n)]
            while gap and (at := bisect_right(pool, (gap, len(lengths)))):
                m, j = pool.pop(at - 1)
                now.append((j, 0, m))
                gap -= m
            if gap == 0 or (size == window and gap < min_fill):
                done.append((size, now))
            else:
                loose.append((gap, size, now))
    # the fullest windows are filled first; at the end stand those that give: the shortest and emptiest
    loose.sort(key=lambda w: (-w[1], w[0]))
    at, end = 0, len(loose) - 1
    while at < end:
        gap, size, now = loose[at]
        while gap and at < end and not (size == window and gap < min_fill):
            spare, tier, donor = loose[end]
            i, a, b = donor.pop()
            take = min(gap, b - a)
            now.append((i, a, a + take))
            gap -= take
            if a + take < b:
                donor.append((i, a + take, b))
            loose[end] = (spare + take, tier, donor)
            end -= not donor
        loose[at] = (gap, size, now)
        if at < end or gap == 0 or (size == window and gap < min_fill):
            done.append((size, now))
            at += 1
    if at == end and loose[at][2]:
        gap, size, now = loose[at]
        left = size - gap
        for tier in reversed(sizes):
            while left >= tier:
                part, need = [], tier
                while need:
                    i, a, b = now.pop(0)
                    take = min(need, b - a)
                    part.append((i, a, a + take))
                    need -= take
                    if a + take < b:
                        now.insert(0, (i, a + take, b))
                done.append((tier, part))
                left -= tier
        if now:
            done.append((sizes[0], now))
    return done


def step_groups(costs: list[float], groups: int) -> list[int]:
    """The group of each sequence: the costliest first, each to the group that has cost least so far."""
    heap = [(0.0, g) for g in range(groups)]
    out = [0] * len(costs)
    for i in sorted(range(len(costs)), key=lambda i: -costs[i]):
        cost, g = heap[0]
        heapreplace(heap, (cost + costs[i], g))
        out[i] = g
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def packed(window: int, tiers: tuple[int, ...], step: int, span: int):
    """For applyInPandas over a group of documents."""

    def of(key, rows):  # frames of pandas, which only tasks import
        import pandas as pd

        rows = rows.sort_values(["doc_id", "start", "length", "ids_crc32"], kind="stable", na_position="first").reset_index(drop=True)
        loose = np.flatnonzero(rows["length"].to_numpy() < window)
        ids = [np.frombuffer(x, "<u4") for x in rows["ids"].to_numpy()[loose]]
        sequences = [(window, [(int(i), 0, window)]) for i in np.flatnonzero(rows["length"].to_numpy() == window)]
        sequences += [(tier, [(int(loose[i]), a, b) for i, a, b in s]) for tier, s in fill([len(x) for x in ids], window, tiers)]
        where = {int(r): x for r, x in zip(loose, ids, strict=True)}
        # a step takes as many tokens as `step` long windows, or more shorter ones; attention costs by squares
        tokens = sum(b - a for _, s in sequences for _, a, b in s)
        turn = step_groups([sum(b - a for _, a, b in s) ** 2 for _, s in sequences], max(1, -(-tokens // (step * window))))
        doc, start, crc, total = (rows[c].to_numpy() for c in ("doc_id", "start", "ids_crc32", "doc_tokens"))
        out: list[tuple] = []
        for n, (tier, s) in enumerate(sequences):
            at = 0
            for r, a, b in s:
                whole = r not in where or b - a == len(where[r])
                out.append((doc[r], int(start[r]) + a, b - a, int(crc[r]) if whole else zlib.crc32(where[r][a:b].tobytes()), int(total[r]), key[0] * span + n, at, tier, key[0] * span + turn[n]))
                at += b - a
        made = pd.DataFrame(out, columns=[x.split()[0] for x in PIECES.split(", ")])
        del rows, loose, ids, sequences, where, doc, start, crc, total, out
        give_back()
        return made

    return of


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW, tiers: tuple[int, ...] = TIERS, group_docs: int = GROUP_DOCS, step: int = 8) -> DataFrame:
    """The tokens of docs(doc_id, text) in sequences of at most window tokens; one row for each piece of a document.

    A document is its ids and then END_ID. It is cut into full windows, sequences of their own, and a rest, which its
    length routes to a tier, and each tier is packed in windows of its own size. Groups of about group_docs documents, dealt by a hash, are packed apart from each other:
    only the rests' ids and one row for each full window are shuffled. See fill() for how gaps of long windows are
    filled from shorter tiers; tier is a sequence's window; step_group numbers groups of sequences of balanced cost, each of
    about the tokens of `step` long windows.

    A null or empty text is the end id alone; rows that repeat a doc_id are packed each; a null doc_id stays null; an
    empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = max(1, -(-rows.count() // group_docs))
    tokens = rows.mapInArrow(tokenized(tokenizer, window), TOKENS)
    # the sequences of a group stay far below 2^40
    # rows that repeat are told apart by their places in what a task reads
    grouped = tokens.withColumn("part", F.pmod(F.xxhash64("doc_id", "doc_tokens", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))).groupBy("part")
    return grouped.applyInPandas(packed(window, tiers, step, 1 << 40), PIECES)
