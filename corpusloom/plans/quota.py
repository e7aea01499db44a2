"""Quotas: shares of question types, whole counts from shares, caps and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shares by profile, in order; subjects without numerical questions; levels by type; caps by difficulty.
PROFILES = {
    "balanced": (("recall", 0.20), ("conceptual", 0.25), ("application", 0.25), ("numerical", 0.15), ("assertion_reason", 0.15)),
    "cbse_standard": (("recall", 0.15), ("conceptual", 0.20), ("application", 0.25), ("numerical", 0.20), ("assertion_reason", 0.20)),
    "easy_test": (("recall", 0.40), ("conceptual", 0.30), ("application", 0.15), ("numerical", 0.10), ("assertion_reason", 0.05)),
    "competitive": (("recall", 0.10), ("conceptual", 0.15), ("application", 0.30), ("numerical", 0.25), ("assertion_reason", 0.20)),
}
NOT_NUMERICAL = ("english", "hindi", "history", "geography", "civics", "political science")
LEVELS = {"recall": "remember", "conceptual": "understand,analyze", "application": "apply,analyze", "numerical": "apply,evaluate", "assertion_reason": "analyze,evaluate"}
CAPS = {"easy": 10, "medium": 8, "hard": 7, "very_hard": 5}
BATCH, OVERSHOOT, MORE = 12, 1.30, 15


def profile_rows(like: DataFrame) -> DataFrame:
    rows = [(p, i, t, s) for p, shares in PROFILES.items() for i, (t, s) in enumerate(shares)]
    return like.sparkSession.createDataFrame(rows, "profile string, ord int, qtype string, share double")


def distributions(sections: DataFrame) -> DataFrame:
    """sec, ord, qtype, share of sections(sec, subject, difficulty, profile); shares of a section sum to 1.

    In subjects without numerical questions their share goes half each to conceptual and application. Hard sections move
    0.10 from recall (0.05 is kept) to application and numerical; easy ones move 0.10 to recall, 0.05 each from those
    two (0.05 is kept). The type numerical that comes back this way is last in order.
    """
    known = F.when(F.col("profile").isin(*PROFILES), F.col("profile")).otherwise("balanced")
    rows = sections.withColumn("profile", known).join(F.broadcast(profile_rows(sections)), "profile")  # 20 rows
    plain = F.lower("subject").isin(*NOT_NUMERICAL)
    own = Window.partitionBy("sec")
    numerical = F.max(F.when(F.col("qtype") == "numerical", F.col("share"))).over(own)
    rows = rows.withColumns({"_plain": plain, "_n": numerical})
    kind = F.col("qtype")
    share = F.when(F.col("_plain") & kind.isin("conceptual", "application"), F.col("share") + F.col("_n") * 0.5).when(F.col("_plain") & (kind == "numerical"), 0.0).otherwise(F.col("share"))
    rows = rows.withColumn("s", share)
    s, hard, easy = F.col("s"), F.col("difficulty") == "hard", F.col("difficulty") == "easy"
    moved = (
        F.when(hard & (kind == "recall"), F.greatest(F.lit(0.05), s - 0.10)).when(hard & kind.isin("application", "numerical"), s + 0.05)
        .when(easy & (kind == "recall"), s + 0.10).when(easy & kind.isin("application", "numerical"), F.greatest(F.lit(0.05), s - 0.05)).otherwise(s)
    )
    there = ~F.col("_plain") | (kind != "numerical") | hard | easy
    rows = rows.withColumn("s", moved).where(there).withColumn("ord", F.when(F.col("_plain") & (kind == "numerical"), 9).otherwise(F.col("ord")))
    total = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("ord", "s")).over(own)), lambda x: x["s"]), F.lit(0.0), lambda a, x: a + x)
    return rows.select("sec", "ord", "qtype", (F.col("s") / total).alias("share"))


def apportioned(shares: DataFrame, totals: DataFrame) -> DataFrame:
    """sec, qtype, n for shares(sec, ord, qtype, share) and totals(sec, total): whole counts that add up to total.

    Each type gets the floor of its share, then one more in order of share (ties by ord) until the total is reached. If the
    total allows one of each, empty types in that order take one from the fullest type that has more than one (the
    first in that order on ties). Types left with none go. A section has a handful of types, folded as one expression.
    """
    order = Window.partitionBy("sec").orderBy(F.desc("share"), "ord")
    rows = shares.join(totals, "sec").withColumn("nth", F.row_number().over(order)).withColumn("n", F.floor(F.col("total") * F.col("share")).cast("long"))
    rest = F.col("total") - F.sum("n").over(Window.partitionBy("sec"))
    rows = rows.withColumn("n", F.col("n") + F.when(F.col("nth") <= rest, 1).otherwise(0))
    lists = rows.groupBy("sec", "total").agg(F.array_sort(F.collect_list(F.struct("nth", "qtype", "n"))).alias("types"))
    counts = F.transform("types", lambda t: t["n"])

    def steal(now: Column, k: Column) -> Column:
        most = F.array_max(now)
        giver = F.array_position(now, most).cast("int") - 1
        take = (F.get(now, k) == 0) & (most > 1)
        return F.when(take, F.transform(now, lambda x, i: F.when(i == giver, x - 1).when(i == k, F.lit(1).cast("long")).otherwise(x))).otherwise(now)

    fair = F.when(F.col("total") >= F.size("types"), F.aggregate(F.sequence(F.lit(0), F.size("types") - 1), counts, steal)).otherwise(counts)
    out = lists.withColumn("fair", fair).select("sec", F.posexplode("types").alias("k", "t"), "fair")
    return out.select("sec", F.col("t.qtype").alias("qtype"), F.get("fair", F.col("k")).alias("n")).where("n > 0")


def generation_plan(sections: DataFrame, levels_on: bool = True) -> DataFrame:
    """Batches of sections(sec, subject, difficulty, profile, format, quantity, levels): sec, qtype, n, format, levels.

    Assertion sections keep their type and always have levels; else numerical questions are short answers unless multiple
    choice was asked for, and levels are given if they are on: the section's own, or those of the type.
    """
    own = F.coalesce(F.nullif("levels", F.lit("")), F.lit(None).cast("string"))
    fixed = sections.where("format = 'assertion_reason'").select("sec", F.lit("assertion_reason").alias("qtype"), F.col("quantity").cast("long").alias("n"), F.lit("assertion_reason").alias("format"), F.coalesce(own, F.lit(LEVELS["assertion_reason"])).alias("levels"))
    mixed = sections.where("format <> 'assertion_reason'")
    counts = apportioned(distributions(mixed), mixed.select("sec", F.col("quantity").cast("long").alias("total"))).join(mixed.select("sec", "format", "levels"), "sec")
    form = F.when(F.col("qtype") == "assertion_reason", "assertion_reason").when((F.col("qtype") == "numerical") & (F.col("format") != "mcq"), "short_answer").otherwise(F.col("format"))
    by_type = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    levels = F.coalesce(own, by_type[F.col("qtype")]) if levels_on else F.lit("")
    return fixed.unionByName(counts.select("sec", "qtype", "n", form.alias("format"), levels.alias("levels")))


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("qtype").agg(F.sum("n").alias("n"))


def capped(quantity: Column, difficulty: Column) -> Column:
    caps = F.create_map(*[F.lit(x) for kv in CAPS.items() for x in kv])
    return F.least(quantity, F.coalesce(F.try_element_at(caps, difficulty), F.lit(CAPS["medium"])))


def wanted(total: Column) -> Column:
    """30 % more than needed, at most 15 more."""
    return F.least(F.ceil(total * OVERSHOOT).cast("long"), total + MORE)


def batches(requests: DataFrame) -> DataFrame:
    """req, batch from 1 and its size for requests(req, total): twelves, the last one short."""
    n = wanted(F.col("total"))
    rows = requests.select("req", n.alias("n")).where("n > 0").select("req", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("n") / BATCH).cast("long"))).alias("batch"))
    return rows.select("req", "batch", F.least(F.lit(BATCH).cast("long"), F.col("n") - BATCH * (F.col("batch") - 1)).alias("size"))


def batches_needed(produced: DataFrame) -> DataFrame:
    """Batches of produced(req, batch, requested, n) that run: those before which fewer than requested + 5 came out."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("req").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return produced.withColumn("before", before).where("before < requested + 5")
