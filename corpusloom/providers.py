"""Models outside the library: embedders and generators run in Arrow batches; stand-ins need none."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import RETRYABLE
from .functions.vectors import hashed_words


#: Models of this Python worker, by the pickled factory that has loaded them.
LOADED: dict[bytes, Callable] = {}


def loaded(factory: bytes) -> Callable:
    """What a pickled factory makes, once a worker."""
    if factory not in LOADED:
        LOADED[factory] = cloudpickle.loads(factory)()
    return LOADED[factory]


def embedded(rows: DataFrame, text: str, encode: Callable[[Sequence[str]], Sequence[Sequence[float]]] | None = None, batch: int = 32, load: Callable[[], Callable] | None = None) -> DataFrame:
    """rows with embedding: by encode, a few texts at once, or by hashed words. A batch that fails has null embeddings.

    `load` may stand instead of encode: a factory without arguments, which each Python worker calls once to load its model.
    Equal texts are encoded once, wherever they stand; a null text counts as an empty one.
    """
    if encode is None and load is None:
        return rows.withColumn("embedding", hashed_words(F.col(text)))
    factory = cloudpickle.dumps(load or (lambda: encode))

    def vectors(texts: list[str]) -> list:
        try:
            return [list(map(float, v)) for v in loaded(factory)(texts)]
        except Exception:  # whatever a model raises
            return [None] * len(texts)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                yield pa.RecordBatch.from_arrays([part["_key"], pa.array(vectors(part["_text"].to_pylist()), pa.list_(pa.float32()))], ["_key", "embedding"])

    keyed = rows.withColumn("_key", F.sha2(F.coalesce(text, F.lit("")), 256))
    distinct = keyed.groupBy("_key").agg(F.first(F.coalesce(text, F.lit(""))).alias("_text"))
    return keyed.join(distinct.mapInArrow(of, "_key string, embedding array<float>"), "_key").select(*rows.columns, "embedding")


# Attempts, seconds of the first and longest pause, and the factors between which chance draws.
ATTEMPTS, FIRST_PAUSE, LONGEST_PAUSE, JITTER = 4, 2.0, 16.0, (0.5, 1.5)


def generated(prompts: DataFrame, generators: Sequence[Callable[[str], str]], attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """req and answer for prompts(req, prompt): the generators in order; null if all fail.

    An error whose message says that another try may help is tried again up to `attempts` times, after a pause that doubles
    and that chance stretches or shortens; after any other error, and after an empty answer, the next generator follows.
    """

    def once(generate: Callable[[str], str], prompt: str) -> str | None:
        for n in range(attempts):
            try:
                return generate(prompt) or None
            except Exception as e:  # whatever a service raises
                if n == attempts - 1 or not any(k in str(e).lower() for k in RETRYABLE):
                    return None
                wait(min(FIRST_PAUSE ** (n + 1), LONGEST_PAUSE) * random.uniform(*JITTER))
        return None

    def answer(prompt: str) -> str | None:
        return next((a for a in (once(g, prompt) for g in generators) if a is not None), None)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["req"], pa.array([answer(p) for p in batch["prompt"].to_pylist()], pa.string())], ["req", "answer"])

    return prompts.select("req", "prompt").mapInArrow(of, f"req {prompts.schema['req'].dataType.simpleString()}, answer string")
