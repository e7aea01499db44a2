"""Many terms looked up in many texts at once: an automaton over all terms, one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the terms that one automaton is compiled from, as they go to every task; more terms are several passes.
AUTOMATON_CHARS = 4_000_000


def automaton(terms: Sequence[str]):
    """An Aho-Corasick automaton whose matches are places in terms, which must differ and not be empty."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        found.add_word(t, i)
    if terms:
        found.make_automaton()
    return found


def terms_within(texts: pa.Array, own, n: int) -> Iterator[set[int]]:
    """For each text the places of the terms in it; null texts have none."""
    for text in texts:
        text = text.as_py()
        yield {i for _, i in own.iter(text)} if text and n else set()


def term_blocks(terms: DataFrame, term: str, most: int = 0) -> Iterator[list[str]]:
    """The distinct terms of a table in lists of about `most` characters; null and empty ones are left out."""
    most = most or AUTOMATON_CHARS
    distinct = terms.select(F.col(term).alias("term")).where("term is not null and term <> ''").distinct()
    size = distinct.agg(F.sum(F.length("term") + 1)).first()[0] or 0
    blocks = -(-size // most)
    for b in range(blocks):  # all of one block come to the driver, and from there to every task
        yield sorted(r.term for r in distinct.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).collect())


def matched_terms(rows: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """rows without `text`, once for each of the distinct terms that the text contains as it is, as a column `_term`.

    Terms are compiled into automata of bounded size, and each text is read once for each of those. An empty term is in
    every text; null texts and null terms match nothing; no terms give no rows.
    """
    others = [c for c in rows.columns if c != text]
    schema = T.StructType([*(rows.schema[c] for c in others), T.StructField("_term", T.StringType())])

    def search(block: list[str]):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = automaton(block)
            for batch in batches:
                at, found = [], []
                for i, terms_ in enumerate(terms_within(batch[text], own, len(block))):
                    at += [i] * len(terms_)
                    found += sorted(terms_)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch[c].take(take) for c in others), pa.array([block[i] for i in found], pa.string())], [*others, "_term"])

        return of

    out = None
    for block in term_blocks(terms, term):
        part = rows.mapInArrow(search(block), schema)
        out = part if out is None else out.unionByName(part)
    if terms.where(F.col(term) == "").limit(1).count():
        whole = rows.where(F.col(text).isNotNull()).select(*others, F.lit("").alias("_term"))
        out = whole if out is None else out.unionByName(whole)
    return out if out is not None else rows.select(*others, F.lit("").alias("_term")).where("false")
