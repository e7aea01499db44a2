"""Byte pair encoding by a deterministic automaton over tokens, compiled merge by merge."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words

TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS = 400_000
#: Texts of these characters only are split by an expression that needs no Unicode tables; others by the library's splitter.
OUTSIDE = re.compile("[^\t-\r\x20-\x7e\xa1-\xff]")
LATIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zªµºÀ-ÖØ-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sA-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]+")


def byte_letters() -> dict[int, str]:
    """The usual letters for bytes: printable ones stand for themselves, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def intervals(parent: list[int], used: set[int]) -> tuple[list[list[int]], list[int], list[int], dict[int, int]]:
    """Of a tree of classes: children, and in preorder the used classes below each class, from lo to hi, and their places."""
    kids: list[list[int]] = [[] for _ in parent]
    for i, p in enumerate(parent):
        if p >= 0:
            kids[p].append(i)
    lo, hi, place = [0] * len(parent), [0] * len(parent), {}
    stack = [(0, False)]
    while stack:
        i, left = stack.pop()
        if left:
            hi[i] = len(place)
            continue
        lo[i] = len(place)
        if i in used:
            place[i] = len(place)
        stack.append((i, True))
        stack.extend((k, False) for k in kids[i])
    return kids, lo, hi, place


class Automaton:
    """Deterministic and compiled; it accepts exactly the token sequences that merging yields. Its state is the last token.

    It begins with one state per symbol, and every token may follow every state. Then come the merges, one gadget each:
    for (a, b) -> c the transition from a by b goes, and the new token c gets the transitions into a and those out of b
    as they are at that time (of three equal tokens the first two merge, so into a a there is none from a). States with
    the same transitions out are one row and tokens with the same transitions in one column, and c shares b's row and a's
    column. A gadget gives a and b a row and a column of their own below the ones they had, so rows and columns form two
    trees, and the transitions that a gadget removes are one rectangle: all rows below a's and all columns below b's, which
    are intervals in preorder. Painting one rectangle a merge gives the table of bits, rows by columns.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.end = end
        self.labels = {i: t for t, i in vocab.items()}
        happen = list(merges)
        while gone := self._compile(vocab, happen):  # merges whose transition had gone already make nothing
            happen = [m for k, m in enumerate(happen) if k not in gone]
        made = {a + b for a, b in happen}
        never = {a + b for a, b in merges} - made
        live = {t: i for t, i in vocab.items() if t not in never}
        self.final = {t.removesuffix(end): i for t, i in live.items() if t.endswith(end)}
        inner = {t: i for t, i in live.items() if not t.endswith(end)}
        #: Letters of tokens: a token, or -1 for what only begins one.
        self.spelled = {t[:k]: -1 for t in inner for k in range(1, len(t))} | inner

    def _compile(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> set[int]:
        """Fills table, row_of and column_of; or else returns the places of merges that can't happen."""
        size = max(vocab.values(), default=-1) + 1
        row, column = [0] * size, [0] * size
        above, before = [-1], [-1]
        made: set[int] = set()
        gone: set[int] = set()
        for k, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if z in made:
                gone.add(k)
                continue
            made.add(z)
            out = row[y]
            above.append(row[x])
            before.append(column[y])
            row[x] = column[y] = len(above) - 1
            row[z], column[z] = out, column[x]
        if gone:
            return gone
        kids, _, _, place = intervals(above, set(row))
        _, first, last, at = intervals(before, set(range(len(before))))
        used = sorted(set(column), key=at.__getitem__)
        keep = np.array([at[c] for c in used], int)
        table: list[bytes] = [b""] * len(place)
        stack = [(0, np.ones(len(before), bool))]
        while stack:
            i, bits = stack.pop()
            if i:
                bits[first[i] : last[i]] = False
            gone |= {k - 1 for k in kids[i] if not bits[first[before[k]]]}
            if i in place:
                table[place[i]] = np.packbits(bits[keep], bitorder="little").tobytes()
            for n, k in enumerate(kids[i]):
                stack.append((k, bits if n == len(kids[i]) - 1 else bits.copy()))
        if gone:
            return gone
        self.table = table
        self.row_of = [place[r] for r in row]
        number = {c: n for n, c in enumerate(used)}
        self.column_of = [number[c] for c in column]
        return gone

    def allows(self, state: int, token: int) -> bool:
        column = self.column_of[token]
        return bool(self.table[self.row_of[state]][column >> 3] >> (column & 7) & 1)

    def encode_word(self, symbols: str) -> tuple[int, ...]:
        """The one accepted sequence over a word's letters.

        What is accepted up to a position is unique, so each position has one state. From left to right, every token
        that begins at a position leads from its state, if the table allows it, to the state of the position where the
        token ends; the sequence is read off backwards from the end.
        """
        spelled, table, row_of, column_of, n = self.spelled, self.table, self.row_of, self.column_of, len(symbols)
        state, begin = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            row = table[row_of[state[i]]] if i else None
            token = self.final.get(symbols[i:])
            if token is not None and state[n] < 0:
                column = column_of[token]
                if row is None or row[column >> 3] >> (column & 7) & 1:
                    state[n], begin[n] = token, i
            j = i + 1
            while j < n and (token := spelled.get(symbols[i:j])) is not None:
                if token >= 0 and state[j] < 0:
                    column = column_of[token]
                    if row is None or row[column >> 3] >> (column & 7) & 1:
                        state[j], begin[j] = token, i
                j += 1
        out, at = [], n
        while at:
            out.append(state[at])
            at = begin[at]
        return tuple(reversed(out))


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, name: str = TOKENIZER):
        import public_tokenizers
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.automaton = Automaton(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        own = Tokenizer.from_file(public_tokenizers.path(name))
        self.normalize, self.split = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.letters = byte_letters()
        labels = self.automaton.labels | {i: t for t, i in self.special.items()}
        self.label = [labels.get(i, "") for i in range(max(labels) + 1)]
        self.digits = [str(i) for i in range(len(self.label))]
        self.words = Words(lambda w: self.automaton.encode_word("".join(map(self.letters.__getitem__, w.encode()))), CACHE_WORDS)
        self.spelled = Words(self.automaton.encode_word, CACHE_WORDS)

    def encode(self, text: str) -> list[int]:
        if "<|" in text and len(parts := self.cut_special.split(text)) > 1:
            return [i for p in parts if p for i in ([self.special[p]] if p in self.special else self.encode(p))]
        if OUTSIDE.search(text):
            return [i for w, _ in self.split(self.normalize(text)) for i in self.spelled[w]]
        return list(chain.from_iterable(map(self.words.__getitem__, LATIN_SPLIT.findall(text.lower()))))

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined by spaces, as the library does for a file without a decoder."""
        return " ".join(map(self.label.__getitem__, ids))


@lru_cache(1)
def codec(name: str) -> Codec:
    return Codec(name)


def encode_documents(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """docs(doc_id, text) to (doc_id, ids): the ids of the whole text, special tokens in it included, none added.

    A null or empty text has no ids; rows that repeat are encoded each; other columns are ignored; no rows give none.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([own.encode(t.as_py() or "") for t in part["text"]], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids) to (doc_id, text), by the labels of the ids. Null ids give an empty text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([own.decode(x.as_py() or []) for x in part["ids"]], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(of, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, where only digests leave the task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        digits = own.digits.__getitem__
        for batch in batches:
            n, a, b = [], [], []
            for text in batch["text"]:
                ids = own.encode(text.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(digits, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
