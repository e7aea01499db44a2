"""Caches with a time to live and request limits, over event tables and streams."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_seconds(ts: Column) -> Column:
    """Seconds since 1970, rounded to the nearest whole one, halves to the even one, as SQL casts a fraction to BIGINT."""
    return F.rint(F.unix_micros(ts.cast("timestamp")) / 1e6).cast("long")


def in_order(events: DataFrame, key: str, order: list[str], fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """fold over the rows (key, *order columns) of one key after the other, each in order.

    Rows are dealt by key and sorted within partitions, so a key's rows stream through one task in order; what is held is
    the state that fold keeps for a key, however many rows it has.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        names, held = [c.split()[0] for c in schema.split(", ")], []
        for _, own in groupby(rows, key=lambda r: r[0]):
            held += fold(own)
            if len(held) >= 10_000:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held, strict=True), strict=True)))
                held = []
        if held:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held, strict=True), strict=True)))

    return events.select(key, *order).repartition(key).sortWithinPartitions(key, *order).mapInArrow(of, schema)


def cache_replay(events: DataFrame, ttl_seconds: int) -> DataFrame:
    """key and its hits and misses for events(key string, at long seconds): an answer lives ttl_seconds from when it was stored.

    The time runs from the store, not from the last hit, so a key's events are folded in order; the state is the time of
    the last store and two counts. The cache has no size limit here; see bounded_cache. Events without a time are left out.
    """

    def fold(own: Iterator[tuple]) -> Iterator[tuple]:
        stored, hits, misses = None, 0, 0
        for key, at in own:  # noqa: B007
            if stored is not None and at - stored < ttl_seconds:
                hits += 1
            else:
                stored, misses = at, misses + 1
        yield key, hits, misses

    return in_order(events.where("at is not null"), "key", ["at"], fold, "key string, hits long, misses long")


#: Entries and seconds of the two caches: one drops what was used longest ago, the other what was stored first.
RECENT_SIZE, RECENT_TTL = 500, 1800
FIRST_SIZE, FIRST_TTL = 100, 300


def bounded_cache(events: DataFrame, size: int, ttl_seconds: int, recent: bool = True) -> DataFrame:
    """instance, hits, misses and evicted for events(instance string, at long, seq long, key string), in the order of at and seq.

    Each instance has a cache of `size` answers. With recent, a hit makes an answer the most recent, and before one is stored
    in a full cache the least recent one goes; an answer older than ttl_seconds goes when it is asked for. Without, an answer
    as old as that is stored anew in its old place, and the first one stored goes once there are more than `size`.
    """

    def fold(own: Iterator[tuple]) -> Iterator[tuple]:
        held: OrderedDict[str, int] = OrderedDict()
        hits = misses = evicted = 0
        for instance, at, _, key in own:  # noqa: B007
            stored = held.get(key)
            if stored is not None and (at - stored <= ttl_seconds if recent else at - stored < ttl_seconds):
                hits += 1
                if recent:
                    held.move_to_end(key)
                continue
            misses += 1
            if recent:
                held.pop(key, None)
                if len(held) >= size:
                    held.popitem(last=False)
                    evicted += 1
                held[key] = at
            else:
                held[key] = at
                if len(held) > size:
                    held.popitem(last=False)
                    evicted += 1
        yield instance, hits, misses, evicted

    return in_order(events, "instance", ["at", "seq", "key"], fold, "instance string, hits long, misses long, evicted long")


def over_limit(events: DataFrame, limit: int, window: str = "15 minutes") -> DataFrame:
    """user, start and n of windows in which a user made more than `limit` requests; events(user, ts), static or a stream."""
    counts = events.groupBy("user", F.window("ts", window)).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > limit).select("user", F.col("window.start").alias("start"), "n")


def over_limit_stream(events: DataFrame, limit: int, window: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """over_limit for a stream whose events come at most `late` late."""
    return over_limit(events.withWatermark("ts", late), limit, window)
