"""Secrets in texts, with multipart credentials linked by place; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, restored

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, expression, least length of the value, group of the value. The first three stand alone, in the order of their
#: report; the others are weak and count only beside complementary parts. A run of `{n,}` equals a run of `+` of which
#: shorter ones are dropped, as both start at the same place and take the whole run.
KINDS = (
    ("assign", ASSIGN, 12, 2),
    ("access", r"AKIA[A-Z0-9]{14,}", 18, 0),
    ("hex", r"[0-9a-f]{16,}", 16, 0),
    ("endpoint", r"""https?://[^\s"'<>]{4,}""", 0, 0),
    ("ident", r"""(?i)\b(username|user|login|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", 3, 2),
    ("token", r"[A-Za-z0-9+/_-]{20,}={0,2}", 20, 0),
)
BASE = 3
#: Parts belong together if they start at most so many code points apart.
SCOPE = 200


def steps(text: Column, kind: int) -> Column:
    """The matches of one kind: n-th, code points between the match before and this one, its length, whether it counts."""
    _, pattern, least, group = KINDS[kind]
    found, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    counts = lambda m, i: F.length(F.get(values, i)) >= least
    if KINDS[kind][0] == "token":
        counts = lambda m, i: m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    out = F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("nth"), F.length(F.get(between, i)).cast("long").alias("skip"), F.length(m).cast("long").alias("size"), counts(m, i).alias("counts")))
    empty = F.array().cast("array<struct<kind:int,nth:bigint,skip:bigint,size:bigint,counts:boolean>>")
    return F.coalesce(F.when(text.rlike(pattern), out), empty)


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, text_hash and spans, an array of (start, kind, end) in order.

    Spans are in code points, the end exclusive; kind is an index into KINDS. Matches of the base kinds all count.
    Identifiers, secrets and endpoints are then linked by an interval join on their starts: a bare token counts beside
    an access id, or beside both an identifier and an endpoint; an identifier beside a secret, or beside both a token
    and an endpoint; an endpoint beside an identifier of either kind and a secret. A token that overlaps a base span or
    an endpoint is not one.

    The expressions run once over the texts; only lengths are shuffled, by document, and windows add them up to places.
    A null or empty text has no spans; rows that repeat doc_id and text each get their row; null ids are kept; other
    columns are ignored; no rows give none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    anchor = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("nth"), F.lit(0).cast("long").alias("skip"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("counts")))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.inline(F.concat(anchor, *[steps(text, k) for k in range(len(KINDS))]))).repartition("doc_id", "text_hash")
    own = Window.partitionBy("doc_id", "text_hash")
    per_kind = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("nth")
    rows = rows.withColumns({
        "copies": F.sum(F.when(F.col("kind") == -1, 1)).over(own),
        # a row that repeats adds each length once more
        "before": F.coalesce(F.sum(F.col("skip") + F.col("size")).over(per_kind.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    rows = rows.withColumn("start", F.expr("before div copies") + F.col("skip")).withColumn("end", F.col("start") + F.col("size"))
    rows = rows.where(F.col("counts") | (F.col("kind") == -1))
    name = {k[0]: i for i, k in enumerate(KINDS)}
    solid = (F.col("kind").between(0, BASE - 1)) | (F.col("kind") == name["endpoint"])
    up, down = own.orderBy("start"), own.orderBy(F.col("start").desc())
    rows = rows.withColumns({
        "reach": F.max(F.when(solid, F.col("end"))).over(up.rangeBetween(Window.unboundedPreceding, 0)),
        "next": F.min(F.when(solid, F.col("start"))).over(down.rangeBetween(Window.unboundedPreceding, 0)),
    })
    clash = (F.col("kind") == name["token"]) & (F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False)))
    rows = rows.where(~clash)
    near = up.rangeBetween(-scope, scope)
    has = lambda *kinds: F.max(F.col("kind").isin([name[k] for k in kinds])).over(near)
    rows = rows.withColumns({"n_access": has("access"), "n_ident": has("ident"), "n_secret": has("assign", "hex"), "n_token": has("token"), "n_endpoint": has("endpoint")})
    linked = (
        F.when(F.col("kind").between(0, BASE - 1), True)
        .when(F.col("kind") == name["token"], F.col("n_access") | (F.col("n_ident") & F.col("n_endpoint")))
        .when(F.col("kind") == name["ident"], F.col("n_secret") | (F.col("n_token") & F.col("n_endpoint")))
        .when(F.col("kind") == name["endpoint"], (F.col("n_access") | F.col("n_ident")) & (F.col("n_secret") | F.col("n_token")))
    )
    spans = F.array_sort(F.collect_set(F.when(linked, F.struct("start", "kind", "end"))))
    out = rows.groupBy("doc_id", "text_hash").agg(spans.alias("spans"), F.max("copies").alias("copies"))
    return out.select("doc_id", "text_hash", "spans", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans as text for each row of docs; see find_secrets."""
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return find_secrets(docs).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def mask_secrets(docs: DataFrame, mask: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """docs with every span in text replaced by mask; spans that overlap or touch are one. All rows and columns stay.

    Null and empty texts stay as they are; rows that repeat doc_id and text, null ids among them, are masked alike; no rows
    give none.
    """
    hits = find_secrets(docs, scope).where(F.size("spans") > 0).groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"))
    hits = hits.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "spans")
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), beside(docs, "doc_id", "text"))
    rows = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    span = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    nothing = F.array().cast("array<struct<s:bigint,e:bigint>>")
    merged = F.aggregate(
        "spans",
        F.struct(nothing.alias("done"), F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("e")),
        lambda a, x: F.when(x["start"] <= a["e"], F.struct(a["done"].alias("done"), a["s"].alias("s"), F.greatest(a["e"], x["end"]).alias("e"))).otherwise(
            F.struct(F.when(a["e"] < 0, a["done"]).otherwise(F.concat(a["done"], F.array(span(a["s"], a["e"])))).alias("done"), x["start"].alias("s"), x["end"].alias("e"))
        ),
        lambda a: F.concat(a["done"], F.array(span(a["s"], a["e"]))),
    )
    rows = rows.withColumn("merged", merged)
    gaps = F.arrays_zip(F.concat(F.array(F.lit(0).cast("long")), F.transform("merged", lambda m: m["e"])).alias("s"), F.concat(F.transform("merged", lambda m: m["s"]), F.array(F.length("text").cast("long"))).alias("e"))
    masked = F.array_join(F.transform(gaps, lambda g: F.substring(F.col("text"), (g["s"] + 1).cast("int"), (g["e"] - g["s"]).cast("int"))), mask)
    return rows.select(*restored(docs, doc_id=F.col("doc_id"), text=F.when(F.col("spans").isNotNull(), masked).otherwise(F.col("text"))))
