"""SentencePiece encoding and decoding of merge-type models, by backtracking over longest matches."""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words

MODEL = "piece_bpe_32k.model"
CACHE_WORDS, CACHE_PAIRS = 300_000, 200_000
#: What stands for a space within pieces.
SPACE = "▁"

codecs.register_error("corpusloom.each", lambda e: ("�", e.start + 1))  # every byte that is no UTF-8 by itself


class Pieces:
    """Whole texts to ids and back, as a SentencePiece model of type BPE does, without its encoder.

    A merge joins the neighbours whose joint piece has the highest score, the leftmost of equal ones. A sequence of pieces
    is what merging yields if and only if that holds for each two neighbours in it, so a text is encoded from left to
    right: the longest piece first (all matches come from an Aho-Corasick automaton), shorter ones if it doesn't fit its
    neighbour or ends where no encoding can go on; with none left, the position is marked in a bitfield of failures and the
    piece before is taken back. Two pieces fit if, as both are merged again from their letters, no merge across their border
    comes before the merges within.
    """

    def __init__(self, name: str = MODEL):
        import ahocorasick
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_file=public_tokenizers.path(name))
        every = range(own.get_piece_size())
        self.byte = {int(own.id_to_piece(i)[3:5], 16): i for i in every if own.is_byte(i)}
        plain = [i for i in every if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i))]
        self.id = {own.id_to_piece(i): i for i in plain}
        self.score = {own.id_to_piece(i): own.get_score(i) for i in plain}
        self.unknown = own.unk_id()
        self.label = [SPACE.encode() + "⁇".encode() + SPACE.encode() if i == self.unknown else b"" if own.is_control(i) else own.id_to_piece(i).encode() for i in every]
        for b, i in self.byte.items():
            self.label[i] = bytes([b])
        self.digits = [str(i) for i in every]
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            self.automaton.add_word(p, len(p) - 1)
        self.automaton.make_automaton()
        self.tree = Words(self.borders, CACHE_PAIRS)
        self.fits = Words(self.compatible, CACHE_PAIRS)
        self.shorter = Words(lambda p: next((k for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), 0), CACHE_PAIRS)
        self.words = Words(self.encode_word, CACHE_WORDS)
        # Texts are cut where no piece goes on: before a space, and around Latin letters where a model keeps them apart.
        inner = [p.lstrip(SPACE) for p in self.id]
        if any(SPACE in p for p in inner):
            raise ValueError("pieces with a space after other letters are not supported")
        latin, single = "A-Za-zÀ-ÖØ-öø-ɏ", "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in self.id)
        mixed = any(re.search(f"[{latin}]", p) and re.search(f"[^{latin}]", p) for p in inner)
        words = f"{SPACE}*[^{SPACE}{single}]+" if mixed else f"{SPACE}*[{latin}]+|{SPACE}*[^{SPACE}{latin}{single}]+"
        self.cut = re.compile(f"{words}|{SPACE}+" + (f"|[{single}]" if single else ""))

    def borders(self, piece: str) -> tuple[list[tuple], list[tuple]] | None:
        """What stands at the left and at the right end of a piece as it is merged from its letters, each as (piece, born,
        gone): the scores that merging has come down to by then. None if merging does not yield the piece."""
        out, low, last = list(piece), float("inf"), float("-inf")
        left, right = [(out[0], low, last)], [(out[-1], low, last)]
        while len(out) > 1:
            joint = [(-self.score[p], k) for k in range(len(out) - 1) if (p := out[k] + out[k + 1]) in self.score]
            if not joint:
                return None
            score, k = min(joint)
            low = min(low, -score)
            both = out[k] + out[k + 1]
            if k == 0:
                left[-1:] = [(*left[-1][:2], low), (both, low, last)]
            if k + 2 == len(out):
                right[-1:] = [(*right[-1][:2], low), (both, low, last)]
            out[k : k + 2] = [both]
        return left, right

    def compatible(self, pair: tuple[str, str]) -> bool:
        """Whether both pieces stay apart: no merge across their border comes before what takes up its left part (of equal
        scores that one is further left) and not after what takes up its right part."""
        score = self.score.get
        for x, x_born, x_gone in self.tree[pair[0]][1]:
            for y, y_born, y_gone in self.tree[pair[1]][0]:
                s = score(x + y)
                if s is not None and (s := min(s, x_born, y_born)) > x_gone and s >= y_gone:
                    return False
        return True

    def encode_run(self, text: str) -> list[str]:
        """The pieces of a text whose every letter is a piece."""
        n = len(text)
        longest = [1] * n
        for end, more in self.automaton.iter(text):  # by end, so of one beginning the longest comes last
            longest[end - more] = more + 1
        failed = bytearray((n >> 3) + 1)  # a bit a position
        out: list[str] = []
        at, size, last = 0, longest[0], None
        tree, fits, shorter = self.tree, self.fits, self.shorter
        while at < n:
            end = at + size
            piece = text[at:end]
            if not failed[end >> 3] >> (end & 7) & 1 and tree[piece] and (last is None or fits[last, piece]):
                out.append(piece)
                at, last = end, piece
                if end < n:
                    size = longest[end]
                continue
            size = shorter[piece]
            if not size:
                failed[at >> 3] |= 1 << (at & 7)
                size = len(out.pop())  # whose end has failed now, so a shorter one comes
                at -= size
                last = out[-1] if out else None
        return out

    def encode_word(self, word: str) -> tuple[int, ...]:
        """The ids of a word; a letter that is no piece becomes the ids of its bytes, or the unknown id in a model without them."""
        own = self.id
        if all(map(own.__contains__, word)):
            return tuple(map(own.__getitem__, self.encode_run(word)))
        out, begin = [], 0
        for k, letter in enumerate(word):
            if letter not in own:
                out += map(own.__getitem__, self.encode_run(word[begin:k]) if k > begin else ())
                out += [self.byte[b] for b in letter.encode()] if self.byte else [self.unknown]
                begin = k + 1
        return tuple(out + [own[p] for p in self.encode_run(word[begin:])] if begin < len(word) else out)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.cut.findall(SPACE + text.replace(" ", SPACE))))) if text else []

    def decode(self, ids: list[int]) -> str:
        """The labels joined, bytes read as UTF-8 and the space before the text taken off."""
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "corpusloom.each").removeprefix(SPACE).replace(SPACE, " ")


@lru_cache(1)
def pieces(name: str) -> Pieces:
    return Pieces(name)


def encode_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs(doc_id, text) to (doc_id, ids): the ids of the whole text, without begin and end.

    A null or empty text has no ids; rows that repeat are encoded each; null ids of documents stay null; other columns are
    ignored; no rows give none.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([own.encode(t.as_py() or "") for t in part["text"]], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids) to (doc_id, text). Null ids give an empty text; other columns are ignored; no rows give none."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([own.decode(x.as_py() or []) for x in part["ids"]], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(of, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def pieces_round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, where only digests leave the task.

    Nulls, empty texts, repeated rows, other columns and no rows as in encode_pieces.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        digits = own.digits.__getitem__
        for batch in batches:
            n, a, b = [], [], []
            for text in batch["text"]:
                ids = own.encode(text.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(digits, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
