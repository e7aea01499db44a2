"""Requested names against stored ones by inverted indexes: equal, one within the other, or with words in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_name, significant_words

#: Letters of a gram; names that are shorter are grams of their own.
GRAM = 3


def runs(text: Column, size: int) -> Column:
    """The runs of so many letters of a text, or the text itself if it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def grams(text: Column) -> Column:
    """The distinct runs of up to GRAM letters of a text, so that each shorter text within it is one or has them all."""
    return F.array_distinct(F.filter(F.concat(*[runs(text, k) for k in range(1, GRAM + 1)]), lambda g: g != ""))


def key_grams(text: Column) -> Column:
    """The grams by which a text is looked up in longer ones: its runs of GRAM letters, or itself if it is shorter."""
    return F.array_distinct(F.filter(runs(text, GRAM), lambda g: g != ""))


def rarest(keys: DataFrame, frequency: DataFrame, by: list[str]) -> DataFrame:
    """For each row of `by` in keys(*by, scope, gram) its gram with the fewest postings; none of a row without a gram that
    the other side lacks, as then nothing there contains it."""
    known = keys.join(frequency, ["scope", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    least = known.groupBy(*by, "scope").agg(F.min(F.struct("n", "gram")).alias("least"))
    return least.where("least.n > 0").select(*by, "scope", F.col("least.gram").alias("gram"))


def within(short: DataFrame, long: DataFrame, short_id: str, long_id: str) -> DataFrame:
    """(short_id, long_id) for short(short_id, scope, text) and long(long_id, scope, text): texts that stand in a longer one
    of their scope, which is neither equal nor empty.

    Each short text meets only the long ones that hold its rarest gram; what meets is compared.
    """
    postings = long.select(long_id, "scope", F.col("text").alias("_long"), F.explode(grams(F.col("text"))).alias("gram"))
    frequency = postings.groupBy("scope", "gram").agg(F.count("*").alias("n"))
    keys = short.where("text <> ''").select(short_id, "scope", F.col("text").alias("_short"), F.explode(key_grams(F.col("text"))).alias("gram"))
    met = rarest(keys, frequency, [short_id, "_short"]).join(postings, ["scope", "gram"])
    return met.where(F.col("_long").contains(F.col("_short")) & (F.col("_long") != F.col("_short"))).select(short_id, long_id)


def shared_words(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """(_ask, _name) for asked(_ask, scope, text) and stored(_name, scope, text) with two significant words in common.

    Who shares two words shares one besides its most frequent word, so that one is not looked up.
    """
    postings = stored.select("_name", "scope", F.col("text").alias("_b"), F.explode(significant_words(F.col("text"))).alias("word"))
    frequency = postings.groupBy("scope", "word").agg(F.count("*").alias("n"))
    words = asked.withColumn("_a", significant_words(F.col("text")))
    keys = words.select("_ask", "scope", "_a", F.explode("_a").alias("word")).join(frequency, ["scope", "word"])
    most = keys.groupBy("_ask").agg(F.max(F.struct("n", "word"))["word"].alias("most"))
    met = keys.join(most, "_ask").where("word <> most").drop("n", "most").join(postings, ["scope", "word"])
    return met.where(F.size(F.array_intersect("_a", significant_words(F.col("_b")))) >= 2).select("_ask", "_name").distinct()


def name_matches(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """_ask, tier, norm, name for stored(scope, name) and asked(_ask, scope, requested): every stored name of the scope that is
    equal once normalized (tier 1), else one within the other (2), else shares two significant words (3).

    An empty request stands within every name. Null and empty names and null requests match nothing, and null scopes
    never meet. Names of a scope count by their normalized text.
    """
    norm = lambda c: F.lower(normalize_name(F.col(c)))
    names = stored.where("name is not null and name <> ''").select("scope", "name", norm("name").alias("text")).distinct()
    unique = names.select("scope", "text", F.col("text").alias("_name")).distinct()
    asks = asked.where("requested is not null").select("_ask", "scope", norm("requested").alias("text"))
    equal = asks.join(unique, ["scope", "text"]).select("_ask", "_name", F.lit(1).alias("tier"))
    inside = within(asks, unique, "_ask", "_name").unionByName(within(unique, asks, "_name", "_ask"))
    inside = inside.unionByName(asks.where("text = ''").join(unique.drop("text"), "scope").select("_ask", "_name")).select("_ask", "_name", F.lit(2).alias("tier"))
    words = shared_words(asks, unique).select("_ask", "_name", F.lit(3).alias("tier"))
    found = equal.unionByName(inside).unionByName(words).groupBy("_ask", "_name").agg(F.min("tier").alias("tier"))
    scoped = found.join(asked.select("_ask", "scope"), "_ask")
    return scoped.join(names.withColumnRenamed("text", "_name"), ["scope", "_name"]).select("_ask", "tier", F.col("_name").alias("norm"), "name")


def best_names(matches: DataFrame) -> DataFrame:
    """_ask, name, tier: of name_matches the best tier of each request, then the least normalized name, then its last spelling."""
    first = matches.groupBy("_ask", "tier", "norm").agg(F.max("name").alias("name"))
    return first.groupBy("_ask").agg(F.min(F.struct("tier", "norm", "name")).alias("s")).select("_ask", "s.name", "s.tier")
