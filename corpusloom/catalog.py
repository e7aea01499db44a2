"""Every query of the library by name over the driver's tables, with the DuckDB SQL it must agree with."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.vectors import cosine
from .operators import assembly, chunking, dedup, gate, generation, many, render, retrieval, stats, store
from .plans import quota
from .sources import tables
from .sources.tables import Workspace, as_json, corpus, read_table
from .streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CORPUS = "corpus AS (SELECT doc_id AS id, source AS chapter, lang AS subject, CAST(doc_id % 3 AS VARCHAR) AS grade, text AS content FROM documents)"
KEYWORDS = ("the", "license", "password", "nicht", "ment")
CHAPTERS = ("src1", "src7", "src13")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


# ---- counts and summaries


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS chapters, count(DISTINCT lang) AS subjects FROM documents")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.corpus_stats(corpus(spark, sf_dir))


@query("""SELECT source AS chapter, count(*) AS n, length(min(text)) AS first_len, length(max(text)) AS last_len, min(length(text)) AS min_len,
max(length(text)) AS max_len, CAST(sum(len(regexp_extract_all(text, '[^ \\n\\t]+'))) // count(*) AS BIGINT) AS mean_words FROM documents GROUP BY source""")
def chapter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.chapter_stats(corpus(spark, sf_dir))


@query("SELECT DISTINCT source AS chapter FROM documents WHERE source <> '' ORDER BY 1 NULLS LAST LIMIT 30")
def distinct_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distinct_chapters(corpus(spark, sf_dir))


@query("SELECT DISTINCT source AS chapter FROM documents WHERE lang = 'en' AND doc_id % 3 = 1 AND source <> '' ORDER BY 1 LIMIT 100")
def chapters_of_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distinct_chapters(corpus(spark, sf_dir), 100, "en", "1")


@query("""SELECT event_type AS kind, count(*) AS n, count(*) FILTER (value >= 20) AS good,
CAST(round(count(*) FILTER (value >= 20) * 100.0::DOUBLE / greatest(count(*), 1), 1) AS VARCHAR) || '%' AS rate FROM events GROUP BY event_type""")
def request_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.request_counters(read_table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.col("value") >= 20).alias("ok")))


@query("""SELECT source AS chapter, count(*) FILTER (length(text) >= 300) AS uploaded, count(*) FILTER (length(text) < 300) AS failed,
CASE WHEN count(*) FILTER (length(text) < 300) = 0 THEN 'OK' ELSE 'WARN' END AS status FROM documents GROUP BY source""")
def ingestion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ingestion_summary(corpus(spark, sf_dir).select("chapter", (F.length("content") >= 300).alias("ok")))


@query("""SELECT lang AS subject, CAST(doc_id % 3 AS VARCHAR) AS grade, count(DISTINCT source) AS files, count(*) AS chunks, count(*) FILTER (length(text) >= 300) AS uploaded, count(*) FILTER (length(text) < 300) AS failed,
CASE WHEN count(*) FILTER (length(text) < 300) = 0 THEN 'OK' ELSE 'WARN' END AS status FROM documents GROUP BY ROLLUP (lang, CAST(doc_id % 3 AS VARCHAR))""")
def ingestion_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ingestion_totals(corpus(spark, sf_dir).select("subject", "grade", "chapter", (F.length("content") >= 300).alias("ok")))


# ---- retrieval


@query(f"""WITH {CORPUS}, k(keyword) AS (VALUES {values([(w,) for w in KEYWORDS])}), hits AS (
SELECT keyword, id, length(content) AS chars, row_number() OVER (PARTITION BY keyword ORDER BY length(content), id) AS rn
FROM corpus JOIN k ON contains(lower(content), lower(keyword)))
SELECT keyword, id, CAST(chars AS INTEGER) AS chars, CAST(rn AS INTEGER) AS rn FROM hits WHERE rn <= 2""")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_topk(corpus(spark, sf_dir), KEYWORDS)


@query(f"""WITH {CORPUS}, hits AS (SELECT item_id AS qid, id, chapter, subject, content, row_number() OVER (PARTITION BY item_id ORDER BY id) AS rn
FROM corpus JOIN benchmark ON contains(lower(content), lower(benchmark.text)))
SELECT qid, id, coalesce(nullif(chapter, ''), 'Unknown') AS chapter, coalesce(nullif(subject, ''), 'Unknown') AS subject,
substring(content, 1, 500) AS excerpt, CAST(0.7 AS DOUBLE) AS similarity, CAST(rn AS INTEGER) AS rn FROM hits WHERE rn <= 3""")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return retrieval.substring_search(corpus(spark, sf_dir), items)


def tiered_sql(chapters: tuple, keywords: tuple) -> str:
    return f"""WITH {CORPUS}, c(ord, term) AS (VALUES {values(list(enumerate(chapters)))}), k(ord, term) AS (VALUES {values(list(enumerate(keywords)))}),
t1 AS (SELECT id, chapter, 0.9::DOUBLE AS relevance, ord, row_number() OVER (PARTITION BY ord ORDER BY length(content), id) AS rn FROM corpus JOIN c ON contains(lower(chapter), lower(term))),
t2 AS (SELECT id, chapter, 0.8::DOUBLE AS relevance, ord, row_number() OVER (PARTITION BY ord ORDER BY length(content), id) AS rn FROM corpus JOIN k ON contains(lower(content), lower(term))),
main AS (SELECT id, arg_min(chapter, seq) AS chapter, arg_min(relevance, seq) AS relevance, min(seq) AS seq FROM (
  SELECT id, chapter, relevance, ord * 2 + rn AS seq FROM t1 WHERE rn <= 2 UNION ALL SELECT id, chapter, relevance, 100 + ord * 2 + rn FROM t2 WHERE rn <= 2) GROUP BY id),
spare AS (SELECT id, chapter, 0.4::DOUBLE AS relevance, 200 + row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '0'), id) AS seq FROM corpus
  WHERE contains(lower(subject), 'en') AND (SELECT count(*) FROM main) < 3 QUALIFY row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '0'), id) <= 3),
found AS (SELECT id, arg_min(chapter, seq) AS chapter, arg_min(relevance, seq) AS relevance, min(seq) AS seq FROM (SELECT * FROM main UNION ALL SELECT * FROM spare) GROUP BY id),
diverse AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY relevance DESC, seq) AS rn FROM found),
kept AS (SELECT id, chapter, relevance, row_number() OVER (ORDER BY relevance DESC, seq) AS pos FROM diverse WHERE rn = 1 OR relevance > 0.8)
SELECT CAST(pos AS INTEGER) AS pos, id, chapter, relevance FROM kept WHERE pos <= 8"""


@query(tiered_sql(CHAPTERS, KEYWORDS))
def tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.tiered_search(corpus(spark, sf_dir), KEYWORDS, CHAPTERS, "en")


@query(tiered_sql(("no such chapter",), ("no such word anywhere",)))
def tiered_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing matches, so that three texts of the subject stand in."""
    return retrieval.tiered_search(corpus(spark, sf_dir), ["no such word anywhere"], ["no such chapter"], "en")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("chapter"), F.when(F.col("label") % 2 == 0, "Science").otherwise("History").alias("subject"), (F.col("vec_id") % 2).cast("string").alias("grade"), "embedding")


#: The query vector of the catalog's searches, a fixed pattern over 64 dimensions.
PROBE = [((i * 7) % 13 - 6) / 40 for i in range(64)]
PROBE_SQL = "[((i * 7) % 13 - 6)::DOUBLE / 40 FOR i IN range(0, 64)]"
VECTORS = "v AS (SELECT vec_id AS id, label AS chapter, CASE WHEN label % 2 = 0 THEN 'Science' ELSE 'History' END AS subject, CAST(vec_id % 2 AS VARCHAR) AS grade, embedding::DOUBLE[] AS e FROM embeddings)"


@query(f"""WITH {VECTORS}, s AS (SELECT id, chapter, round(list_cosine_similarity(e, {PROBE_SQL}), 6) AS similarity FROM v WHERE chapter IN (1, 2, 3, 4, 5))
SELECT id, chapter, similarity FROM s WHERE similarity > 0.1 ORDER BY similarity DESC, id LIMIT 8""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_topk(vectors(spark, sf_dir), PROBE, 8, 0.1, [1, 2, 3, 4, 5])


@query(f"""WITH {VECTORS}, s AS (SELECT id, chapter, lower(subject) AS subject, round(list_cosine_similarity(e, {PROBE_SQL}), 6) AS similarity FROM v WHERE grade = '1'),
t AS (SELECT *, CASE WHEN contains(subject, 'Sci') AND similarity > 0.65 THEN 1 WHEN contains(subject, 'sci') AND similarity > 0.65 THEN 2 WHEN contains(subject, 'sci') AND similarity > 0.05 THEN 3 END AS stage FROM s)
SELECT id, chapter, similarity, stage FROM t WHERE stage = (SELECT min(stage) FROM t) ORDER BY similarity DESC, id LIMIT 8""")
def staged_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.staged_vector_search(vectors(spark, sf_dir), PROBE, "Sci", "1", threshold=0.65, relaxed=0.05)


@query(f"""WITH {CORPUS}, k(ord, keyword) AS (VALUES {values(list(enumerate(KEYWORDS)))}), hits AS (
  SELECT ord, keyword, id, chapter IN ('src1', 'src2', 'src3') AS strict FROM corpus JOIN k ON contains(lower(content), lower(keyword)) WHERE grade = '1' AND contains(lower(subject), 'en')),
open AS (SELECT *, bool_or(strict) OVER (PARTITION BY ord) AS any_strict FROM hits),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY id) AS rn FROM open WHERE strict OR NOT any_strict),
once AS (SELECT id, arg_min(keyword, ord) AS keyword, min(ord * 100 + rn) AS seq FROM ranked WHERE rn <= 6 GROUP BY id)
SELECT CAST(row_number() OVER (ORDER BY seq) AS INTEGER) AS pos, id, keyword, 0.6::DOUBLE AS similarity FROM once ORDER BY seq LIMIT 6""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_search(corpus(spark, sf_dir), KEYWORDS, "en", "1", ["src1", "src2", "src3"])


@query(f"""WITH {VECTORS}, {CORPUS}, a AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) - 1 AS r1, s AS s1 FROM (SELECT id, round(list_cosine_similarity(e, {PROBE_SQL}), 6) AS s FROM v) QUALIFY r1 < 60),
b AS (SELECT id, row_number() OVER (ORDER BY length(content), id) - 1 AS r2 FROM corpus WHERE contains(lower(content), 'the') QUALIFY r2 < 60),
f AS (SELECT coalesce(a.id, b.id) AS id, r1, r2, round(coalesce(1.0::DOUBLE / (61 + r1), 0) + coalesce(1.0::DOUBLE / (61 + r2), 0), 9) AS rrf_score, CASE WHEN r2 IS NOT NULL THEN 0.6::DOUBLE ELSE s1 END AS similarity,
CASE WHEN r2 IS NOT NULL THEN 'keyword' ELSE 'vector' END AS source FROM a FULL JOIN b ON a.id = b.id)
SELECT id, rrf_score, similarity, source, CAST(row_number() OVER (ORDER BY rrf_score DESC, r1 NULLS LAST, r2 NULLS LAST) AS INTEGER) AS pos FROM f""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of 60: nearest vectors, and the shortest texts of all that have a word."""
    near = vectors(spark, sf_dir).select("id", F.round(cosine("embedding", F.array(*map(F.lit, PROBE))), 6).alias("similarity"), F.lit(1).alias("one"))
    near = retrieval.first_rows(near, ["one"], [F.desc("similarity"), "id"], 60, "rank").select("id", (F.col("rank") - 1).alias("rank"), "similarity")
    hits = corpus(spark, sf_dir).where(tx.contains(F.col("content"), "the")).select("id", F.length("content").alias("chars"), F.lit(1).alias("one"))
    hits = retrieval.first_rows(hits, ["one"], ["chars", "id"], 60, "rank").select("id", (F.col("rank") - 1).alias("rank"), F.lit(0.6).alias("similarity"))
    return retrieval.rrf_fusion(near, hits)


#: Requests against stored names; the last one matches nothing.
REQUESTED = ("Part 12", "part  7", "PART 1 & 2", "zebra crossing")


@query(f"""WITH r(ord, requested) AS (VALUES {values(list(enumerate(REQUESTED)))}),
clean AS (SELECT ord, requested, lower(trim(regexp_replace(replace(replace(regexp_replace(trim(requested), '\\s+', ' ', 'g'), ' & ', ' and '), '&', ' and '), '\\s+', ' ', 'g'))) AS req FROM r),
names AS (SELECT norm, max(name) AS name FROM (SELECT p_name AS name, lower(trim(regexp_replace(replace(replace(regexp_replace(trim(p_name), '\\s+', ' ', 'g'), ' & ', ' and '), '&', ' and '), '\\s+', ' ', 'g'))) AS norm FROM part WHERE p_name <> '') GROUP BY norm),
hits AS (SELECT ord, requested, name, norm, CASE WHEN req = norm THEN 1 WHEN contains(norm, req) OR contains(req, norm) THEN 2
  WHEN len(list_intersect([w FOR w IN list_distinct(string_split(req, ' ')) IF w NOT IN ('and', 'of', 'the', 'in', 'a')], [w FOR w IN list_distinct(string_split(norm, ' ')) IF w NOT IN ('and', 'of', 'the', 'in', 'a')])) >= 2 THEN 3 END AS tier FROM clean, names),
best AS (SELECT ord, requested, name, tier, row_number() OVER (PARTITION BY ord ORDER BY tier, norm) AS rn FROM hits WHERE tier IS NOT NULL)
SELECT ord, requested, name, tier FROM best WHERE rn = 1 UNION ALL SELECT ord, requested, requested, 0 FROM r WHERE NOT EXISTS (SELECT 1 FROM best)""")
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.resolve_names(read_table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), REQUESTED)


DICTIONARY = (("carbon", "Chemistry"), ("acid", "Chemistry"), ("force", "Physics"), ("eye", "Physics"), ("that", "Grammar"), ("tion", "Suffixes"), ("thing", "Grammar"))


@query(f"""WITH d(term, chapter) AS (VALUES {values(list(DICTIONARY))}), q AS (SELECT item_id AS qid, substring(trim(text), 1, 500) AS question FROM benchmark),
hits AS (SELECT qid, list_sort(list(DISTINCT chapter))[1:5] AS chapters FROM q JOIN d ON contains(lower(question), term) GROUP BY qid)
SELECT q.qid, array_to_string([w FOR w IN regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+') IF regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN ({", ".join(f"'{w}'" for w in tx.QUESTION_STOP_WORDS)})], ' ') AS keywords,
coalesce(array_to_string(chapters, '|'), '') AS chapters, regexp_matches(question, '[\\x{{0900}}-\\x{{097F}}]') AS has_devanagari FROM q LEFT JOIN hits ON q.qid = hits.qid""")
def query_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame(list(DICTIONARY), "term string, chapter string")
    return retrieval.analyze_questions(read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question")), d)


# ---- ingestion


@query("""WITH w AS (SELECT doc_id AS id, [x FOR x IN regexp_split_to_array(text, '[ \\t\\n\\r\\f]+') IF x <> ''] AS ws FROM documents),
k AS (SELECT id, ws, unnest(range(0, CASE WHEN len(ws) < 50 THEN 0 WHEN len(ws) <= 500 THEN 1 ELSE CAST(ceil((len(ws) - 500) / 425.0) AS BIGINT) + 1 END)) AS k FROM w),
c AS (SELECT id, k, ws[k * 425 + 1 : k * 425 + 500] AS part FROM k)
SELECT id, CAST(k AS INTEGER) AS k, md5(array_to_string(part, ' ')) AS digest, CAST(len(part) AS INTEGER) AS words FROM c WHERE len(part) >= 50""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.chunk_rows(corpus(spark, sf_dir).select("id", F.col("content").alias("text")))
    return rows.select("id", "k", F.md5("chunk").alias("digest"), F.size(F.split("chunk", " ")).alias("words"))


@query("""SELECT page_id, md5(trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), chr(0), ''), '\\n\\s*\\n\\s*\\n\\s*', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'))) AS digest FROM pages""")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", F.md5(tx.clean_text(tx.strip_tags(F.col("html")))).alias("digest"))


@query("""SELECT min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY trim(regexp_replace(regexp_replace(lower(text), '\\$[^$]*\\$', '', 'g'), '\\s+', ' ', 'g'))""")
def dedup_exact_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_texts(corpus(spark, sf_dir), tx.comparison_text(F.col("content")))


# ---- duplicates within requests of fifty vectors

ITEMS = "items AS (SELECT vec_id // 50 AS grp, vec_id % 50 AS idx, (label * 7 % 5)::DOUBLE AS score, embedding::DOUBLE[] AS e FROM embeddings)"
PAIRS = "pairs AS (SELECT a.grp, a.idx AS i, b.idx AS j, a.score AS si, b.score AS sj, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM items AS a JOIN items AS b ON a.grp = b.grp AND a.idx < b.idx)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 50").alias("grp"), (F.col("vec_id") % 50).alias("idx"), (F.col("label") * 7 % 5).cast("double").alias("score"), "embedding")


@query(f"WITH {ITEMS}, {PAIRS} SELECT grp, i, j, similarity FROM pairs WHERE similarity >= 0.3")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.similar_pairs(items(spark, sf_dir), 0.3)


@query(f"""WITH RECURSIVE {ITEMS}, {PAIRS}, near AS (SELECT grp, i, list({{'j': j, 'sj': sj}} ORDER BY j) AS js FROM pairs WHERE similarity >= 0.2 GROUP BY grp, i),
step AS (SELECT grp, -1::BIGINT AS i, []::BIGINT[] AS gone FROM (SELECT DISTINCT grp FROM items) UNION ALL
  SELECT s.grp, s.i + 1, CASE WHEN n.js IS NULL OR list_contains(s.gone, s.i + 1) THEN s.gone ELSE list_concat(s.gone,
    [x.j FOR x IN n.js IF NOT list_contains(s.gone, x.j) AND x.j < coalesce(list_min([y.j FOR y IN n.js IF NOT list_contains(s.gone, y.j) AND y.sj > it.score]), 1000000)],
    CASE WHEN list_min([y.j FOR y IN n.js IF NOT list_contains(s.gone, y.j) AND y.sj > it.score]) IS NULL THEN [] ELSE [s.i + 1] END) END
  FROM step AS s LEFT JOIN near AS n ON n.grp = s.grp AND n.i = s.i + 1 LEFT JOIN items AS it ON it.grp = s.grp AND it.idx = s.i + 1 WHERE s.i < 49)
SELECT items.grp, items.idx FROM items JOIN step ON step.grp = items.grp AND step.i = 49 WHERE NOT list_contains(step.gone, items.idx)""")
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.greedy_dedup(items(spark, sf_dir), 0.2)


# ---- quotas

#: What a customer asks for: a subject, difficulty, profile and format by its key, up to thirteen questions, sometimes a level.
SECTION_VALUES = {"subject": ("Physics", "History", "Maths", "English", "hindi"), "difficulty": ("easy", "medium", "hard"), "profile": ("balanced", "competitive", "easy_test", "cbse_standard", "unknown"), "format": ("mcq", "short_answer", "assertion_reason", "long_answer")}
SECTION_STEPS = {"subject": 1, "difficulty": 1, "profile": 5, "format": 3}
SECTIONS_SQL = "SELECT c_custkey AS sec, " + ", ".join(f"{list(v)}[c_custkey // {SECTION_STEPS[c]} % {len(v)} + 1] AS {c}" for c, v in SECTION_VALUES.items()) + ", c_custkey % 13 + 1 AS quantity, CASE WHEN c_custkey % 6 = 0 THEN 'apply' END AS levels FROM customer"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda c: F.get(F.array(*map(F.lit, SECTION_VALUES[c])), F.expr(f"int(c_custkey div {SECTION_STEPS[c]} % {len(SECTION_VALUES[c])})"))
    return read_table(spark, sf_dir, "customer").select(k.alias("sec"), *[pick(c).alias(c) for c in SECTION_VALUES], (k % 13 + 1).alias("quantity"), F.when(k % 6 == 0, "apply").alias("levels"))


PROFILE_ROWS = values([(p, i, t, s) for p, shares in quota.PROFILES.items() for i, (t, s) in enumerate(shares)])
DISTRIBUTION = f"""sections AS ({SECTIONS_SQL}), profiles(profile, ord, qtype, share) AS (VALUES {PROFILE_ROWS}),
based AS (SELECT s.sec, s.difficulty, s.quantity, s.format, lower(s.subject) IN ({", ".join(f"'{x}'" for x in quota.NOT_NUMERICAL)}) AS plain, p.ord, p.qtype, p.share::DOUBLE AS share,
  max(CASE WHEN p.qtype = 'numerical' THEN p.share::DOUBLE END) OVER (PARTITION BY s.sec) AS num FROM sections AS s JOIN profiles AS p ON p.profile = CASE WHEN s.profile IN (SELECT profile FROM profiles) THEN s.profile ELSE 'balanced' END),
split AS (SELECT *, CASE WHEN plain AND qtype IN ('conceptual', 'application') THEN share + num * 0.5::DOUBLE WHEN plain AND qtype = 'numerical' THEN 0::DOUBLE ELSE share END AS s FROM based),
moved AS (SELECT *, CASE WHEN difficulty = 'hard' AND qtype = 'recall' THEN greatest(0.05::DOUBLE, s - 0.10::DOUBLE) WHEN difficulty = 'hard' AND qtype IN ('application', 'numerical') THEN s + 0.05::DOUBLE
  WHEN difficulty = 'easy' AND qtype = 'recall' THEN s + 0.10::DOUBLE WHEN difficulty = 'easy' AND qtype IN ('application', 'numerical') THEN greatest(0.05::DOUBLE, s - 0.05::DOUBLE) ELSE s END AS m FROM split
  WHERE NOT plain OR qtype <> 'numerical' OR difficulty IN ('hard', 'easy')),
placed AS (SELECT sec, quantity, format, CASE WHEN plain AND qtype = 'numerical' THEN 9 ELSE ord END AS ord, qtype, m FROM moved),
whole AS (SELECT sec, list_reduce(list(m ORDER BY ord), lambda a, x: a + x) AS whole FROM placed GROUP BY sec), dist AS (SELECT p.sec, quantity, format, ord, qtype, m / whole AS share FROM placed AS p JOIN whole ON whole.sec = p.sec)"""


@query(f"WITH {DISTRIBUTION} SELECT sec, CAST(ord AS INTEGER) AS ord, qtype, round(share, 9) AS share FROM dist")
def plan_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.distributions(sections(spark, sf_dir)).select("sec", "ord", "qtype", F.round("share", 9).alias("share"))


#: Shares of a section in order of share, floors and one more each, and then, type by type, what an empty one takes from the
#: fullest: the steps of apportionment after shares(sec, ord, qtype, share) and totals(sec, total).
APPORTION = """floors AS (SELECT s.sec, total, qtype, floor(total * share)::BIGINT AS n, row_number() OVER (PARTITION BY s.sec ORDER BY share DESC, ord) AS nth FROM shares AS s JOIN totals AS t ON t.sec = s.sec),
ones AS (SELECT sec, total, qtype, nth, n + CASE WHEN nth <= total - sum(n) OVER (PARTITION BY sec) THEN 1 ELSE 0 END AS n FROM floors),
lists AS (SELECT sec, total, list(qtype ORDER BY nth) AS types, list(CAST(n AS BIGINT) ORDER BY nth) AS ns FROM ones GROUP BY sec, total),
steps AS (SELECT sec, types, ns, 1 AS k, total >= len(types) AS fair FROM lists UNION ALL SELECT sec, types, CASE WHEN fair AND ns[k] = 0 AND list_max(ns) > 1 THEN
  [CASE WHEN i = list_position(ns, list_max(ns)) THEN ns[i] - 1 WHEN i = k THEN 1 ELSE ns[i] END FOR i IN range(1, len(ns) + 1)] ELSE ns END, k + 1, fair FROM steps WHERE k <= len(ns)),
counts AS (SELECT sec, unnest(types) AS qtype, unnest(ns) AS n FROM steps WHERE k = len(ns) + 1)"""


@query(f"""WITH RECURSIVE p(ord, qtype, share) AS (VALUES {values([(i, t, s) for i, (t, s) in enumerate(quota.PROFILES["balanced"])])}),
totals AS (SELECT c_nationkey::BIGINT AS sec, count(*) % 9 AS total FROM customer GROUP BY c_nationkey), shares AS (SELECT sec, ord, qtype, share::DOUBLE AS share FROM totals, p), {APPORTION}
SELECT sec, qtype, n FROM counts WHERE n > 0""")
def apportion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question types shared out over totals of 0 to 8, so that types without a question take one."""
    totals = read_table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("sec")).agg((F.count("*") % 9).alias("total"))
    shares = totals.select("sec").crossJoin(F.broadcast(quota.profile_rows(totals).where("profile = 'balanced'").drop("profile")))  # five rows
    return quota.apportioned(shares, totals)


PLAN = f"""{DISTRIBUTION}, totals AS (SELECT DISTINCT sec, quantity::BIGINT AS total FROM dist WHERE format <> 'assertion_reason'), shares AS (SELECT sec, ord, qtype, share FROM dist WHERE format <> 'assertion_reason'), {APPORTION},
own AS (SELECT sec, format, nullif(levels, '') AS levels, quantity::BIGINT AS quantity FROM sections), named(qtype, levels) AS (VALUES {values(list(quota.LEVELS.items()))}),
plan AS (SELECT sec, 'assertion_reason' AS qtype, quantity AS n, 'assertion_reason' AS format, coalesce(levels, '{quota.LEVELS["assertion_reason"]}') AS levels FROM own WHERE format = 'assertion_reason' UNION ALL
  SELECT c.sec, c.qtype, c.n, CASE WHEN c.qtype = 'assertion_reason' THEN 'assertion_reason' WHEN c.qtype = 'numerical' AND own.format <> 'mcq' THEN 'short_answer' ELSE own.format END, coalesce(own.levels, named.levels)
  FROM counts AS c JOIN own ON own.sec = c.sec JOIN named ON named.qtype = c.qtype WHERE c.n > 0)"""


@query(f"WITH RECURSIVE {PLAN} SELECT sec, qtype, n, format, levels FROM plan")
def generation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.generation_plan(sections(spark, sf_dir))


@query(f"WITH RECURSIVE {PLAN} SELECT qtype, sum(n)::BIGINT AS n FROM plan GROUP BY qtype")
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.plan_summary(quota.generation_plan(sections(spark, sf_dir)))


@query("""WITH r AS (SELECT o_orderkey AS req, CAST(o_orderkey % 61 AS BIGINT) AS total FROM orders), w AS (SELECT req, least(ceil(total * 1.30::DOUBLE)::BIGINT, total + 15) AS n FROM r),
b AS (SELECT req, n, unnest(range(1, CAST(ceil(n / 12.0) AS BIGINT) + 1)) AS batch FROM w WHERE n > 0) SELECT req, batch, least(12, n - 12 * (batch - 1)) AS size FROM b""")
def batch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.batches(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("req"), (F.col("o_orderkey") % 61).alias("total")))


@query("""WITH r AS (SELECT l_orderkey AS req, l_partkey * 10 + l_linenumber AS batch, CAST(12 AS BIGINT) AS requested, CAST(l_quantity AS BIGINT) AS n, l_extendedprice AS x FROM lineitem),
u AS (SELECT req, batch, requested, sum(n)::BIGINT AS n FROM r GROUP BY req, batch, requested),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY req ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM u) SELECT * FROM s WHERE before < requested + 5""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("req"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("batch"), F.lit(12).cast("long").alias("requested"), F.col("l_quantity").cast("long").alias("n"))
    return quota.batches_needed(rows.groupBy("req", "batch", "requested").agg(F.sum("n").alias("n")))


@query("""SELECT doc_id AS id, least(CAST(doc_id % 15 AS BIGINT), CASE doc_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 8 WHEN 2 THEN 7 ELSE 5 END) AS quantity FROM documents""")
def chapter_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.get(F.array(*[F.lit(x) for x in quota.CAPS]), (F.col("doc_id") % 4).cast("int"))
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), quota.capped(F.col("doc_id") % 15, level).cast("long").alias("quantity"))


# ---- gates and answers


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as generated questions, four words of each as options."""
    words = F.split("text", " ")
    pick = F.array(*[F.concat(F.lit(f"{c}) "), F.coalesce(F.get(words, F.lit(i)), F.lit("none"))) for i, c in enumerate("ABCD")])
    return read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("req"), F.col("turn").alias("pos"), "text", F.when(F.col("role") == "assistant", "mcq").when(F.col("role") == "user", "essay").otherwise("short_answer").alias("format"),
        F.when(F.col("turn") % 5 != 4, pick).alias("options"), F.when(F.col("turn") % 3 == 0, "b").when(F.col("turn") % 3 == 1, "B) x").otherwise("C)").alias("correct_answer"), F.reverse("text").alias("explanation"),
        F.lit("2").alias("marks"), F.lit("apply").alias("bloom_level"), F.col("role").alias("chapter"),
    )


@query("""WITH q AS (SELECT conv_id AS req, turn AS pos, trim(text) AS text, CASE WHEN role = 'system' THEN 'short_answer' ELSE 'mcq' END AS format, turn % 5 <> 4 AS has, turn % 3 AS a, trim(reverse(text)) AS explanation FROM conversations),
n AS (SELECT *, length(text) < 15 AS short, trim(regexp_replace(regexp_replace(lower(text), '\\$[^$]*\\$', '', 'g'), '\\s+', ' ', 'g')) AS norm FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY req, short, norm ORDER BY pos) AS nth FROM n)
SELECT coalesce(CASE WHEN short THEN 'short' WHEN nth > 1 THEN 'duplicate' WHEN length(explanation) < 30 THEN 'vague' WHEN format = 'mcq' AND NOT has THEN 'options' WHEN format = 'mcq' AND a = 0 THEN 'answer' END, 'kept') AS reason, format, 'apply' AS bloom_level, 'medium' AS difficulty, 1 AS marks, count(*) AS n FROM r GROUP BY 1, 2""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.quality_gate(questions(spark, sf_dir), "physics").groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason"), "format", "bloom_level", "difficulty", "marks").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT conv_id AS req, turn AS pos, trim(text) AS text, string_split(text, ' ') AS w, CASE WHEN role = 'system' THEN 'short_answer' ELSE 'mcq' END AS format, turn % 5 <> 4 AS has, turn % 3 AS a, trim(reverse(text)) AS explanation FROM conversations),
n AS (SELECT *, length(text) < 15 AS short, trim(regexp_replace(regexp_replace(lower(text), '\\$[^$]*\\$', '', 'g'), '\\s+', ' ', 'g')) AS norm FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY req, short, norm ORDER BY pos) AS nth FROM n)
SELECT req, pos, CASE WHEN format <> 'mcq' THEN ['b', 'B) x', 'C)'][a + 1] WHEN a = 1 THEN 'B) ' || coalesce(w[2], 'none') ELSE 'C) ' || coalesce(w[3], 'none') END AS answer,
CASE WHEN format = 'mcq' THEN 'A) ' || coalesce(w[1], 'none') || '|B) ' || coalesce(w[2], 'none') || '|C) ' || coalesce(w[3], 'none') || '|D) ' || coalesce(w[4], 'none') END AS options
FROM r WHERE NOT short AND nth = 1 AND length(explanation) >= 30 AND (format <> 'mcq' OR (has AND a > 0))""")
def gate_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and options of the questions that pass, as the gate has mended them."""
    kept = gate.quality_gate(questions(spark, sf_dir), "physics").where("drop_reason is null")
    return kept.select("req", "pos", F.col("correct_answer").alias("answer"), F.array_join("options", "|").alias("options"))


@query("""SELECT doc_id AS id, round(greatest(0.1::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN length(text) > 80 AND length(text) < 400 THEN 0.2::DOUBLE ELSE 0::DOUBLE END + 0.3::DOUBLE * (doc_id % 10 / 10.0::DOUBLE))), 9) AS confidence FROM documents""")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.round(gate.confidence(F.col("text"), F.col("doc_id") % 10 / F.lit(10.0)), 9).alias("confidence"))


@query("""WITH s AS (SELECT doc_id AS id, text, [x FOR x IN string_split(text, '. ') IF length(x) > 20] AS ss FROM documents)
SELECT id, md5(CASE WHEN len(ss) >= 2 THEN array_to_string([trim(x) FOR x IN ss[1:2]], '. ') || '.' ELSE substring(text, 1, 250) END) AS digest FROM s""")
def fallback_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(gate.fallback_answer(F.col("text"))).alias("digest"))


@query(f"""WITH {CORPUS}, hits AS (SELECT item_id AS qid, id, chapter, content, row_number() OVER (PARTITION BY item_id ORDER BY id) AS pos FROM corpus JOIN benchmark ON contains(lower(content), lower(benchmark.text)))
SELECT qid, string_agg('[' || pos || '] ' || chapter || ': ' || substring(content, 1, 400), chr(10) || chr(10) ORDER BY pos) AS context FROM hits WHERE pos <= 5 GROUP BY qid""")
def answer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    hits = retrieval.containing(corpus(spark, sf_dir).select("id", "chapter", "content"), "content", asked, "question")
    hits = hits.select("qid", "id", "chapter", F.substring("content", 1, 400).alias("content"))
    return gate.build_context(retrieval.first_rows(hits, ["qid"], ["id"], 5, "pos"))


@query(f"""WITH {CORPUS}, h AS (SELECT item_id AS qid, count(*) AS hits FROM corpus JOIN benchmark ON contains(lower(content), lower(benchmark.text)) GROUP BY item_id)
SELECT item_id AS qid, coalesce(hits, 0) AS hits, CASE WHEN hits IS NULL THEN 'no matching text' END AS message, CASE WHEN hits IS NULL THEN 0.1::DOUBLE END AS confidence FROM benchmark LEFT JOIN h ON h.qid = item_id""")
def no_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    hits = retrieval.containing(corpus(spark, sf_dir).select("id", "content"), "content", asked, "question")
    return gate.with_no_results(asked, hits)


@query("""SELECT conv_id AS req, turn AS pos, CASE WHEN turn % 4 = 1 AND role <> 'user' AND conv_id % 7 <> 3 THEN 'fixed' ELSE text END AS correct_answer, role AS explanation, CASE WHEN conv_id % 7 = 3 THEN 'needs_review' ELSE 'verified' END AS validation_status,
CASE WHEN turn % 4 = 1 AND conv_id % 7 <> 3 THEN 'wrong' END AS validation_notes FROM conversations""")
def apply_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("req"), F.col("turn").alias("pos"), F.col("text").alias("correct_answer"), F.col("role").alias("explanation"))
    verdicts = rows.select("req", (F.col("pos") + 1).alias("index"), (F.col("pos") % 4 != 1).alias("valid"), F.when(F.col("explanation") == "user", "").otherwise("fixed").alias("fixed_correct_answer"), F.lit(None).cast("string").alias("fixed_explanation"), F.lit("wrong").alias("notes"))
    return gate.apply_verdicts(rows, verdicts, rows.where("req % 7 = 3").select("req"))


@query("""SELECT item_id AS qid, CASE WHEN length(trim(text)) < 3 THEN 'too_short' WHEN length(trim(text)) > 200 THEN 'too_long' ELSE 'ok' END AS status FROM benchmark""")
def question_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), gate.question_status(F.col("text"), 3, 200, False).alias("status"))


@query("""SELECT item_id, substring(md5(lower(text)), 1, 12) AS short_key, substring(sha256(lower(trim(text))), 1, 16) AS long_key FROM benchmark""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select("item_id", tx.short_key(F.col("text")).alias("short_key"), tx.long_key(F.col("text")).alias("long_key"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NOT NULL AND json_valid(props) AS valid FROM events""")
def event_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(F.try_parse_json("props").isNotNull(), F.lit(False)).alias("valid"))


#: Formulas around a word w and what they become, written down by hand.
FORMULAS = (
    ("x^2 + w_1 = $z^{10}$", "x<super>2</super> + w<sub>1</sub> = z<super>10</super>", "x^2 + w_1 = z^10"),
    (r"$\frac{w}{b}$ & \sqrt{x} < 3", "(w/b) &amp; √(x) &lt; 3", "(w/b) & √(x) < 3"),
    (r"\alpha \times \sin{w} \text{cm}", "α × sinw cm", "α × sinw cm"),
    ("plain <b>w</b> > text", "plain <b>w</b> &gt; text", "plain <b>w</b> > text"),
    (r"\frac{\sqrt{w}}{3}", "frac√(w)3", "frac√(w)3"),
    (r"{w}^{a_1} \Unkno \theta_{\pi}", "w<super>a<sub>1</sub></super> Unkno θ<sub>π</sub>", "w^a_1 Unkno θ_π"),
)


def formula_sql(i: int) -> str:
    return "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN replace('{f[i]}', 'w', w)" for k, f in enumerate(FORMULAS)) + " END"


@query(f"SELECT doc_id AS id, {formula_sql(1)} AS markup, {formula_sql(2)} AS plain FROM (SELECT doc_id, upper(substring(md5(text), 1, 5)) AS w FROM documents)")
def formula_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas that hold a word of each document's own."""
    word = F.upper(F.substring(F.md5("text"), 1, 5))
    kinds = F.array(*[F.lit(f[0]) for f in FORMULAS])
    rows = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.replace(F.get(kinds, (F.col("doc_id") % 6).cast("int")), F.lit("w"), word).alias("f"))
    return rows.select("id", tx.formula_markup(F.col("f")).alias("markup"), tx.formula_plain(F.col("f")).alias("plain"))


@query("""WITH q AS (SELECT conv_id AS req, turn, turn % 3 AS a, string_split(text, ' ') AS w FROM conversations WHERE turn % 5 <> 4), o AS (SELECT req, turn + 1 AS number, a, w, unnest([1, 2, 3, 4]) AS k FROM q)
SELECT req, number, substring('ABCD', k, 1) AS label, k = CASE a WHEN 2 THEN 3 ELSE 2 END AS correct FROM o""")
def option_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.option_rows(questions(spark, sf_dir)).select("req", "number", "label", "correct")


@query("""WITH c AS (SELECT conv_id AS req, turn // 5 AS line, turn % 5 AS c, 'Q' || (turn + 1) || '. ' || CASE turn % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'B) x' ELSE 'C)' END AS cell FROM conversations)
SELECT req, line, """ + ", ".join(f"coalesce(max(cell) FILTER (c = {i}), '') AS c{i}" for i in range(5)) + " FROM c GROUP BY req, line")
def answer_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.answer_grid(questions(spark, sf_dir))


# ---- the store: orders as tests, line items as their questions


@query("""WITH k AS (SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS positions, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS id, coalesce(positions, '') AS positions, coalesce(n, 0) AS n FROM orders LEFT JOIN k ON l_orderkey = o_orderkey""")
def parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    out = store.with_children(tests, read_table(spark, sf_dir, "lineitem"), "id", "l_orderkey", "l_linenumber")
    return out.select("id", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("positions"), F.size("children").cast("long").alias("n"))


@query("SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS marks FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey = 7) GROUP BY l_orderkey")
def owner_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.owned_by(read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey", F.col("o_custkey") == 7)
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("marks"))


@query("SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN 'saved' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return store.updated(rows, F.col("o_custkey") == 7, "o_orderstatus", "saved").drop("o_custkey")


@query(f"WITH {CORPUS} SELECT id, chapter FROM corpus WHERE NOT coalesce(contains(lower(subject), 'e') AND grade = '1', false)")
def delete_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.without_subject(corpus(spark, sf_dir), "E", "1").select("id", "chapter")


@query("""SELECT conv_id AS test_id, count(*) AS total_questions, CAST(sum(CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS total_marks,
CASE WHEN conv_id % 2 = 0 THEN '01234567-89ab-cdef-0123-456789abcdef' ELSE '00000000-0000-0000-0000-000000000000' END AS owner FROM conversations GROUP BY conv_id""")
def save_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parents of drafts made of conversations, a turn a question."""
    q = F.struct("turn", "text", F.when(F.col("turn") % 2 == 0, 2).alias("marks"))
    rows = read_table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("test_id")).agg(F.array_sort(F.collect_list(q)).alias("questions"))
    parents, _ = store.drafts(rows.withColumns({"owner": F.when(F.col("test_id") % 2 == 0, "01234567-89ab-cdef-0123-456789abcdef").otherwise("x"), "title": F.lit("t")}))
    return parents.select("test_id", "owner", F.col("total_questions").cast("long").alias("total_questions"), F.col("total_marks").cast("long").alias("total_marks"))


@query("""SELECT o_orderkey AS test_id, sha256('quiz|' || o_orderkey) AS quiz_id, '/quiz/' || sha256('quiz|' || o_orderkey) AS link, 60 AS duration_minutes, 3 AS tab_switch_limit FROM orders""")
def quiz_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.quiz_links(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("test_id"), F.lit(10).alias("total_marks")))
    return rows.select("test_id", "quiz_id", "link", "duration_minutes", "tab_switch_limit")


@query("""SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')""")
def rejected_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type") == "click", "reject").when(F.col("event_type") == "purchase", "edit").otherwise("approve")
    return store.rejected(read_table(spark, sf_dir, "events").select("event_id", "event_type", action.alias("action"))).drop("action")


@query("""SELECT CASE WHEN o_orderkey % 5 >= 3 THEN 'limit_reached' ELSE 'ok' END AS status, count(*) AS n FROM orders GROUP BY 1""")
def feedback_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("test_id"), (F.col("o_orderkey") % 5).alias("iteration"))
    return store.feedback_status(rows).groupBy("status").agg(F.count("*").alias("n"))


# ---- time


@query("""WITH RECURSIVE e AS (SELECT user_id || '|' || event_type AS key, CAST(epoch(ts) AS BIGINT) AS t FROM events), n AS (SELECT key, t, row_number() OVER (PARTITION BY key ORDER BY t) AS k FROM e),
r AS (SELECT key, k, t AS stored, 0::BIGINT AS hits, 1::BIGINT AS misses FROM n WHERE k = 1 UNION ALL
SELECT n.key, n.k, CASE WHEN n.t - r.stored < 86400 THEN r.stored ELSE n.t END, r.hits + CASE WHEN n.t - r.stored < 86400 THEN 1 ELSE 0 END, r.misses + CASE WHEN n.t - r.stored < 86400 THEN 0 ELSE 1 END FROM r JOIN n ON n.key = r.key AND n.k = r.k + 1)
SELECT key, max(hits) AS hits, max(misses) AS misses FROM r GROUP BY key""")
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), ev.whole_seconds(F.col("ts")).alias("at"))
    return ev.cache_replay(rows, 86_400)


@query("""SELECT user_id AS "user", time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1""")
def over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.over_limit(read_table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), "ts"), 1, "1 day")


# ---- further surfaces


@query(f"""WITH {VECTORS}, s AS (SELECT id, CAST(chapter AS VARCHAR) AS chapter, round(list_cosine_similarity(e, {PROBE_SQL}), 6) AS similarity FROM v WHERE contains(lower(subject), 'hist') AND grade = '0' AND chapter IN (1, 3, 5))
SELECT id, chapter, similarity FROM s WHERE similarity > 0.02 ORDER BY similarity DESC, id LIMIT 7""")
def match_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL table function over the vectors."""
    vectors(spark, sf_dir).createOrReplaceTempView("match_rows")
    retrieval.register_match_function(spark, "match_rows")
    vector = "array(" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in PROBE) + ")"
    return spark.sql(f"SELECT * FROM match_chunks({vector}, 'Hist', '0', array('1', '3', '5'), 0.02D, 7)")


@query("""SELECT conv_id AS req, turn AS pos, round(least(length(text) / 200.0::DOUBLE, 1.0::DOUBLE) * 2 + CASE WHEN length(text) > 20 THEN 2 ELSE 0 END + CASE WHEN turn % 5 <> 4 THEN 1 ELSE 0 END
+ CASE WHEN turn % 3 = 1 THEN 1 ELSE 0 END + 1.0::DOUBLE, 9) AS score FROM conversations""")
def item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = dedup.item_score(F.col("text"), F.col("explanation"), F.col("options"), F.col("correct_answer"), F.col("bloom_level"), F.col("chapter"), F.col("format"))
    return questions(spark, sf_dir).select("req", "pos", F.round(score, 9).alias("score"))


@query("""SELECT user_id AS qid, count(*) AS n, round(avg(event_id % 10 / 10.0::DOUBLE), 3) AS mean, round(avg(event_id % 10 / 10.0::DOUBLE) FILTER (event_id % 7 <= 3), 6) AS top FROM events GROUP BY user_id""")
def relevance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), (F.col("event_id") % 7).alias("pos"), (F.col("event_id") % 10 / F.lit(10.0)).alias("similarity"))
    return stats.relevance_summary(rows)


@query("SELECT doc_id AS id, " + " OR ".join(f"contains(upper(text), upper('{k}'))" for k in tx.RETRYABLE) + " AS again FROM documents")
def retryable_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("id", tx.retryable(F.col("content")).alias("again"))


@query("SELECT count(*) AS deleted FROM documents WHERE contains(lower(lang), 'e') AND doc_id % 3 = 1")
def deleted_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.deleted_count(corpus(spark, sf_dir), "E", "1")


@query("""SELECT CAST(json_object('custKey', c_custkey, 'cName', c_name, 'nationKey', c_nationkey) AS VARCHAR) AS json FROM customer""")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust_key"), "c_name", F.col("c_nationkey").alias("nation_key")))


@query(f"""SELECT c_custkey AS req, 'Write ' || (c_custkey % 9) || ' mcq questions on ' || c_mktsegment || '. Difficulty: hard.' || chr(10) || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '{gate.TYPE_RULES['numerical']}' || chr(10) ELSE '' END || '{gate.DIFFICULTY_RULES['hard']}' || chr(10) || '{gate.FORMAT_RULES['mcq']}' || CASE WHEN c_custkey % 5 = 0 THEN chr(10) || 'The teacher asks: fewer' ELSE '' END || chr(10) || chr(10) || 'Use only this text:' || chr(10) ||
CASE WHEN c_custkey % 2 = 0 THEN substring(c_name, 1, 1000) ELSE 'No text is given.' END || chr(10) || chr(10) || 'Answer with one JSON object that has the key questions.' AS prompt FROM customer""")
def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer")
    asked = rows.select(F.col("c_custkey").alias("req"), F.col("c_mktsegment").alias("subject"), F.lit("hard").alias("difficulty"), (F.col("c_custkey") % 9).alias("n"), F.lit("mcq").alias("form"), F.when(F.col("c_custkey") % 3 == 0, "numerical").alias("qtype"), F.when(F.col("c_custkey") % 5 == 0, "fewer").otherwise("string").alias("feedback"))
    return gate.build_prompts(asked, rows.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("req"), F.col("c_name").alias("context")))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.orphans(read_table(spark, sf_dir, "customer").select("c_custkey"), read_table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


@query("""SELECT conv_id AS test_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS INTEGER) AS position, text, CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END AS marks FROM conversations""")
def draft_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The children of the drafts in save_draft."""
    q = F.struct("turn", "text", F.when(F.col("turn") % 2 == 0, 2).alias("marks"))
    rows = read_table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("test_id")).agg(F.array_sort(F.collect_list(q)).alias("questions"))
    return store.drafts(rows.withColumns({"owner": F.lit("x"), "title": F.lit("t")}))[1]


@query(f"""WITH {CORPUS} SELECT DISTINCT chapter AS name FROM corpus WHERE grade = '1' AND chapter IS NOT NULL AND contains(lower(subject), 'en')""")
def candidate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.candidate_names(corpus(spark, sf_dir), ["src1"], "en", "1")


@query(f"""WITH {CORPUS} SELECT DISTINCT 'part ' || chapter AS name FROM corpus WHERE grade = '1' AND contains(chapter, 'src1')""")
def candidate_names_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No name is stored for the subject, so names of the grade count that hold the long words of the request in order."""
    return retrieval.candidate_names(corpus(spark, sf_dir).withColumn("chapter", F.concat(F.lit("part "), "chapter")), ["Part of SRC1"], "no such subject", "1")


#: Texts and vectors of one id together, for searches that use both.
BOTH = "both_ AS (SELECT c.id, c.chapter, c.subject, c.grade, c.content, v.e FROM corpus AS c LEFT JOIN v ON v.id = c.id)"


def texts_and_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).join(read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")


@query(f"""WITH {CORPUS}, {VECTORS}, {BOTH}, own AS (SELECT * FROM both_ WHERE grade = '1'), r(ord, requested) AS (VALUES (0, 'SRC1'), (1, 'src 7')),
bulk AS (SELECT DISTINCT chapter AS name FROM own WHERE contains(lower(subject), 'en') AND chapter IS NOT NULL),
cand AS (SELECT name FROM bulk UNION SELECT chapter FROM own, r WHERE chapter ILIKE CASE ord WHEN 0 THEN '%SRC1%' ELSE '%src%' END AND (SELECT count(*) FROM bulk) < 3),
hits AS (SELECT ord, requested, name, CASE WHEN lower(requested) = lower(name) THEN 1 WHEN contains(lower(name), lower(requested)) OR contains(lower(requested), lower(name)) THEN 2 END AS tier FROM r, cand),
best AS (SELECT ord, name FROM hits WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ord ORDER BY tier, lower(name)) = 1),
names AS (SELECT DISTINCT name FROM (SELECT name FROM best UNION ALL SELECT requested FROM r WHERE NOT EXISTS (SELECT 1 FROM best))),
sims AS (SELECT id, lower(subject) AS subject, round(list_cosine_similarity(e, {PROBE_SQL}), 6) AS similarity FROM own WHERE chapter IN (SELECT name FROM names)),
staged AS (SELECT id, similarity, CASE WHEN contains(subject, 'en') AND similarity > 0.65 THEN 1 WHEN contains(subject, 'en') AND similarity > 0.3 THEN 3 END AS stage FROM sims),
a AS (SELECT id, similarity AS s1, row_number() OVER (ORDER BY similarity DESC, id) - 1 AS r1 FROM staged WHERE stage = (SELECT min(stage) FROM staged) QUALIFY r1 < 8),
k(ord, keyword) AS (SELECT 0, 'the' UNION ALL SELECT 1, 'ment' UNION ALL SELECT 1 + row_number() OVER (ORDER BY name), name FROM names),
found AS (SELECT ord, keyword, id, coalesce(chapter IN (SELECT name FROM names), false) AS strict FROM own JOIN k ON contains(lower(content), lower(keyword)) WHERE contains(lower(subject), 'en')),
open_ AS (SELECT *, bool_or(strict) OVER (PARTITION BY ord) AS any_strict FROM found), ranked AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY id) AS rn FROM open_ WHERE strict OR NOT any_strict),
once AS (SELECT id, min(ord * 100 + rn) AS seq FROM ranked WHERE rn <= 6 GROUP BY id), b AS (SELECT id, row_number() OVER (ORDER BY seq) - 1 AS r2 FROM once QUALIFY r2 < 6),
f AS (SELECT coalesce(a.id, b.id) AS id, r1, r2, round(coalesce(1.0::DOUBLE / (61 + r1), 0) + coalesce(1.0::DOUBLE / (61 + r2), 0), 9) AS rrf_score, CASE WHEN r2 IS NOT NULL THEN 0.6::DOUBLE ELSE s1 END AS similarity,
CASE WHEN r2 IS NOT NULL THEN 'keyword' ELSE 'vector' END AS source FROM a FULL JOIN b ON a.id = b.id)
SELECT id, rrf_score, similarity, source, CAST(row_number() OVER (ORDER BY rrf_score DESC, r1 NULLS LAST, r2 NULLS LAST) AS INTEGER) AS pos FROM f QUALIFY pos <= 10""")
def retrieve_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.retrieve_context(texts_and_vectors(spark, sf_dir), PROBE, ["SRC1", "src 7"], ["the, ment", "of"], "en", "1")


@query("""SELECT conv_id AS req, CAST(turn AS INTEGER) AS pos, md5(text) AS digest, CASE WHEN role = 'user' THEN NULL ELSE turn::DOUBLE END AS marks, chr(92) || 'alpha' AS topic FROM conversations WHERE conv_id % 3 <> 2""")
def parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with fences, commas too many, lone backslashes and marks as text; those of every third are cut off and unreadable."""
    one = F.concat(F.lit("{"), F.regexp_replace(F.to_json(F.struct("text")), r"^\{|\}$", ""), F.lit(', "marks": '), F.when(F.col("role") == "user", F.concat(F.lit('"'), F.col("turn").cast("string"), F.lit('"'))).otherwise(F.col("turn").cast("string")), F.lit(', "topic": "\\alpha",}'))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", one.alias("one")).alias("q"))
    text = F.concat(F.lit('```json\n{"questions": [\n'), F.array_join(F.transform(F.array_sort(F.collect_list("q")), lambda q: q["one"]), ",\n"), F.lit(",]}\n```"))
    raw = rows.groupBy(F.col("conv_id").alias("req")).agg(text.alias("answer"))
    raw = raw.withColumn("answer", F.when(F.col("req") % 3 == 2, F.expr("substring(answer, 1, length(answer) - 7)")).otherwise(F.col("answer")))
    return gate.parse_answers(raw).select("req", "pos", F.md5("text").alias("digest"), "marks", "topic")


@query("""SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN NULL ELSE md5(text) END AS digest FROM conversations""")
def repaired_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects behind braces that are none, in fences, before other objects, with commas too many and between braces in strings."""
    one = F.to_json(F.struct("text", F.lit("} or {").alias("other")))
    forms = [
        F.concat(F.lit("Fill {this}: ```json "), one, F.lit("```")), F.concat(one, F.lit("\n``` see {x}")), F.concat(F.lit("Here: "), one, F.lit(' and {"b": 2}')), F.concat(F.expr("substring(one, 1, length(one) - 1)"), F.lit(", }")),
        F.concat(F.lit("see {x}, then "), one), F.concat(F.lit("```\n"), one, F.lit("\n```")), F.concat(F.lit("{"), one),
    ]
    rows = read_table(spark, sf_dir, "conversations").withColumn("one", one)
    kind = (F.col("turn") % 7).cast("int")
    chosen = F.coalesce(*[F.when(kind == i, f) for i, f in enumerate(forms)])
    return rows.select("conv_id", "turn", F.md5(F.get_json_object(tx.repaired_json(chosen), "$.text")).alias("digest"))


@query("""SELECT doc_id AS id, md5(CASE WHEN length(coalesce(trim(substring(text, 1, doc_id % 20)), '')) < 10 THEN substring(text, 1, 200) ELSE substring(text, 1, doc_id % 20) END) AS digest FROM documents""")
def answer_or_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").withColumn("answer", F.expr("substring(text, 1, int(doc_id % 20))"))
    return rows.select(F.col("doc_id").alias("id"), F.md5(gate.answer_or_prefix(F.col("answer"), F.col("text"))).alias("digest"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '10' ELSE CAST(c_custkey % 12 AS VARCHAR) END AS grade, replace(c_name || ' ' || c_mktsegment, ' ', '_') || '.pdf' AS file FROM customer""")
def names_of_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.when(F.col("c_custkey") % 3 == 0, "Class none").otherwise(F.concat(F.lit("Class "), (F.col("c_custkey") % 12).cast("string"), F.lit("A 7")))
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), tx.class_number(grade).alias("grade"), tx.file_name(F.concat_ws(" ", "c_name", "c_mktsegment"), "pdf").alias("file"))


@query("""WITH f AS (SELECT c_custkey AS form_id, c_custkey % 13 AS a, c_custkey % 7 AS b FROM customer), r AS (SELECT form_id, 0 AS i, 'Force' AS topic, 'x' AS sub, a * 5 AS q, 'Hard' AS d FROM f UNION ALL
  SELECT form_id, 1, CASE WHEN b = 0 THEN '' ELSE c END, '', b, 'Mixed' FROM f, (SELECT 'Light' AS c) UNION ALL SELECT form_id, 2, 'Sound', 'y', 3, 'odd' FROM f WHERE a > 6), kept AS (SELECT * FROM r WHERE topic <> ''),
t AS (SELECT form_id, sum(q)::BIGINT AS total FROM kept GROUP BY form_id)
SELECT kept.form_id, CAST(kept.form_id % 12 AS VARCHAR) AS grade, total, CASE WHEN total > 50 THEN 'too_many' ELSE 'ok' END AS status, kept.topic AS chapter, nullif(sub, '') AS topic, q::BIGINT AS quantity,
CASE d WHEN 'Hard' THEN 'hard' ELSE 'medium' END AS difficulty, 'mcq' AS format, 1 AS marks FROM kept JOIN t ON t.form_id = kept.form_id""")
def form_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("c_custkey") % 13, F.col("c_custkey") % 7
    row = lambda topic, sub, n, d: F.struct(topic.alias("topic"), F.lit(sub).alias("subtopic"), n.cast("int").alias("quantity"), F.lit(d).alias("difficulty"))
    more = F.when(a > 6, F.array(row(F.lit("Sound"), "y", F.lit(3), "odd"))).otherwise(F.array().cast("array<struct<topic:string,subtopic:string,quantity:int,difficulty:string>>"))
    rows = F.concat(F.array(row(F.lit("Force"), "x", a * 5, "Hard"), row(F.when(b == 0, "").otherwise("Light"), "", b, "Mixed")), more)
    forms = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("form_id"), F.concat(F.lit("Class "), (F.col("c_custkey") % 12).cast("string")).alias("class_grade"), rows.alias("rows"))
    return render.form_requests(forms)


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN extract(microsecond FROM ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(extract(microsecond FROM ts) % 1000000 AS VARCHAR), 6, '0') END AS iso, strftime(ts, '%d/%m/%Y') AS printed,
CASE d WHEN 0 THEN '' WHEN 1 THEN '1 day, ' ELSE d || ' days, ' END || (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS up
FROM (SELECT *, u // 86400 AS d, u % 86400 AS s FROM (SELECT event_id, ts, CAST(floor(epoch(ts)) - floor(epoch((SELECT min(ts) FROM events))) AS BIGINT) AS u FROM events))""")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.join(F.broadcast(rows.agg(F.min("ts").alias("first"))))  # one row
    return rows.select("event_id", tx.iso_time(F.col("ts")).alias("iso"), tx.printed_date(F.col("ts")).alias("printed"), tx.uptime(F.col("first"), F.col("ts")).alias("up"))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE md5(text) END AS digest FROM documents""")
def data_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as data URIs, as bare base64 and as neither, and back."""
    code = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", "")
    uri = F.when(F.col("doc_id") % 5 == 4, "data:x;base64,?*").when(F.col("doc_id") % 2 == 0, code).otherwise(F.concat(F.lit("data:text/plain;base64,"), code))
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(tx.data_uri_bytes(uri)).alias("digest"))


CACHE_SQL = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS instance, event_type AS key, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT, event_id) AS k FROM events),
r AS (SELECT instance, k, [key] AS recent, [key] AS first_, 0::BIGINT AS rh, 0::BIGINT AS re, 0::BIGINT AS fh, 0::BIGINT AS fe FROM e WHERE k = 1 UNION ALL
SELECT e.instance, e.k, CASE WHEN list_contains(recent, key) THEN list_append(list_filter(recent, lambda x: x <> key), key) WHEN len(recent) >= 2 THEN list_append(recent[2:], key) ELSE list_append(recent, key) END,
  CASE WHEN list_contains(first_, key) THEN first_ WHEN len(first_) >= 2 THEN list_append(first_[2:], key) ELSE list_append(first_, key) END,
  rh + CASE WHEN list_contains(recent, key) THEN 1 ELSE 0 END, re + CASE WHEN NOT list_contains(recent, key) AND len(recent) >= 2 THEN 1 ELSE 0 END,
  fh + CASE WHEN list_contains(first_, key) THEN 1 ELSE 0 END, fe + CASE WHEN NOT list_contains(first_, key) AND len(first_) >= 2 THEN 1 ELSE 0 END FROM r JOIN e ON e.instance = r.instance AND e.k = r.k + 1)
"""


@query(CACHE_SQL + """SELECT instance, max(rh) AS recent_hits, max(k) - max(rh) AS recent_misses, max(re) AS recent_evicted, max(fh) AS first_hits, max(k) - max(fh) AS first_misses, max(fe) AS first_evicted FROM r GROUP BY instance""")
def bounded_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of two answers for each user, under both rules; nothing grows too old."""
    rows = read_table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("instance"), ev.whole_seconds(F.col("ts")).alias("at"), F.col("event_id").cast("long").alias("seq"), F.col("event_type").alias("key"))
    named = lambda kind: [F.col(c).alias(f"{kind}_{c}") for c in ("hits", "misses", "evicted")]
    return ev.bounded_cache(rows, 2, 1 << 40).select("instance", *named("recent")).join(ev.bounded_cache(rows, 2, 1 << 40, recent=False).select("instance", *named("first")), "instance")


# ---- tests of questions, from request to draft


def stand_in_generator(prompt: str) -> str:
    """Seven questions whatever is asked: two are dropped by the gate, one repeats another, one nearly does."""
    long = "because the text says so in so many words"
    one = lambda text, marks, why=long: f'{{"text": "{text}", "format": "mcq", "options": ["A) one", "B) two", "C) three", "D) four"], "correct_answer": "b) x", "explanation": "{why}", "marks": {marks}, "bloom_level": "apply", "chapter": "c", "topic": "t"}}'
    texts = [("Which gas do green leaves take in during sunlight?", "1"), ("How many planets circle the nearest star of ours", "5"), ("too short", "1"), ("which gas do  green leaves take in during sunlight?", "1"), ("How many planets circle the nearest star of ours now", '"2"')]
    return "```json\n" + '{"questions": [' + ", ".join(one(*t) for t in texts) + ", " + one("What makes the tides rise and fall twice each day?", "1", "brief") + ", " + one("Why does iron rust faster in salty than pure water?", "3") + ",]}\n```"


def stand_in_validator(prompt: str) -> str:
    """The second answer is wrong; a single question can't be validated."""
    return '{"validations": [{"index": 1, "valid": true}, {"index": 2, "valid": false, "fixed_correct_answer": "C) three", "fixed_explanation": "", "notes": "wrong"}]}' if "2. " in prompt else "sorry"


@query("""WITH r AS (SELECT c_custkey AS req, c_custkey % 6 + 1 AS n, CASE WHEN c_custkey % 5 >= 3 THEN 'limit_reached' WHEN c_custkey % 4 = 0 THEN 'no_content' ELSE 'preview' END AS status FROM customer)
SELECT req, status, CASE WHEN status = 'preview' THEN least(3, n) ELSE 0 END::BIGINT AS total_questions, CASE WHEN status = 'preview' THEN least(3, n) + CASE WHEN n >= 3 THEN 2 ELSE 0 END ELSE 0 END::BIGINT AS total_marks,
CASE WHEN status <> 'preview' THEN '' WHEN n = 1 THEN 'B) two:needs_review' WHEN n = 2 THEN 'B) two:verified,C) three:verified' ELSE 'B) two:verified,C) three:verified,B) two:verified' END AS answers FROM r""")
def build_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer")
    asked = rows.select(F.col("c_custkey").alias("req"), F.col("c_name").alias("title"), F.lit("x").alias("owner"), F.col("c_mktsegment").alias("subject"), F.lit("medium").alias("difficulty"), F.lit("mcq").alias("form"), (F.col("c_custkey") % 6 + 1).alias("n"), (F.col("c_custkey") % 5).alias("iteration"))
    contexts = rows.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("req"), F.col("c_name").alias("context"))
    outcomes, tests, made = assembly.build_test(asked, contexts, [stand_in_generator], [stand_in_validator])
    answers = made.groupBy(F.col("test_id").alias("req")).agg(F.array_sort(F.collect_list(F.struct("position", F.concat_ws(":", "correct_answer", "validation_status").alias("a")))).alias("l"))
    tests = tests.select(F.col("test_id").alias("req"), F.col("total_questions").cast("long").alias("total_questions"), F.col("total_marks").cast("long").alias("total_marks"))
    return outcomes.join(tests, "req", "left").join(answers, "req", "left").select("req", "status", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total_questions", "total_marks")], F.coalesce(F.array_join("l.a", ","), F.lit("")).alias("answers"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 3 AS b, CASE WHEN o_orderkey % 7 = 2 THEN 'saved' ELSE o_orderstatus END AS status, o_totalprice FROM orders)
SELECT 'kept' AS part, status, 'b' || b AS batch, count(*) AS n FROM o WHERE o_totalprice >= 1000 AND NOT (b = 2 OR o_totalprice < 30000) GROUP BY ALL
UNION ALL SELECT 'rejects', o_orderstatus, 'b' || (o_orderkey % 3), count(*) FROM orders WHERE o_totalprice < 1000 OR o_totalprice IS NULL GROUP BY ALL""")
def repeated_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended in three batches, one of them twice; rows deleted, a whole batch among them, and updated, each twice."""
    work = Workspace(spark, "writes")
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    path, rejects = f"{work.path}/orders", f"{work.path}/rejects"
    for b in (0, 1, 2, 1):
        tables.append(rows.where(F.col("id") % 3 == b), F.col("o_totalprice") >= 1000, path, rejects, f"b{b}")
    for _ in range(2):
        tables.delete_rows(spark, path, (F.col("batch") == "b2") | (F.col("o_totalprice") < 30_000))
        tables.update_rows(spark, path, F.col("id") % 7 == 2, "status", "saved")
    counted = lambda at, part: spark.read.schema("id long, status string, o_totalprice double, batch string").parquet(at).groupBy(F.lit(part).alias("part"), "status", "batch").agg(F.count("*").alias("n"))
    return counted(path, "kept").unionByName(counted(rejects, "rejects"))


@query("""WITH k AS (SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS positions FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS id, coalesce(positions, '') AS positions FROM orders LEFT JOIN k ON l_orderkey = o_orderkey""")
def laid_out_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent_child over tables that lie in buckets by the key: no exchange."""
    work = Workspace(spark, "layout")
    lie = lambda rows, key: tables.laid_out(rows, key, f"{key}_{uuid.uuid4().hex}", f"{work.path}/{key}", 8)
    parents = lie(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey"), "id").select("id")
    children = lie(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")
    return store.with_children(parents, children, "id", "l_orderkey", "l_linenumber").select("id", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("positions"))


@query("""SELECT 'duplicate' AS kind, CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'orphan', CAST(l_partkey * 2 AS VARCHAR), count(*) FROM lineitem WHERE l_partkey * 2 NOT IN (SELECT p_partkey FROM part) GROUP BY 2""")
def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") * 2).alias("part"))
    return tables.violations(rows, "id", "part", read_table(spark, sf_dir, "part"), "p_partkey")


#: Requests made of the items of benchmark: a subject, a grade, two chapters or none, two words as topics and a vector.
ASKED = f"""{CORPUS}, {VECTORS}, {BOTH},
asked AS (SELECT item_id AS req, CASE item_id % 3 WHEN 0 THEN 'EN' WHEN 1 THEN 'fr' ELSE 'e' END AS subject, CAST(item_id % 3 AS VARCHAR) AS grade, CASE WHEN item_id % 5 = 0 THEN [] ELSE ['SRC' || (item_id % 25), 'src ' || (item_id % 7)] END AS chapters,
  [trim(x) FOR x IN string_split(array_to_string(string_split(text, ' ')[1:2], ', '), ',') IF length(trim(x)) >= 3] AS topics, e AS q FROM benchmark LEFT JOIN v ON v.id = item_id),
names AS (SELECT DISTINCT grade, lower(subject) AS subject, chapter FROM corpus WHERE chapter IS NOT NULL),
each AS (SELECT req, subject, grade, unnest(chapters) AS c, unnest(range(len(chapters))) AS ord FROM asked),
named AS (SELECT req, ord, chapter, CASE WHEN lower(c) = lower(chapter) THEN 1 ELSE 2 END AS tier FROM each JOIN names ON names.grade = each.grade AND contains(names.subject, lower(each.subject)) AND (contains(lower(chapter), lower(c)) OR contains(lower(c), lower(chapter)))),
best AS (SELECT req, ord, chapter FROM named QUALIFY row_number() OVER (PARTITION BY req, ord ORDER BY tier, lower(chapter)) = 1),
lists AS (SELECT req, list_sort(list(DISTINCT chapter)) AS cs FROM best GROUP BY req),
r AS (SELECT a.req, lower(a.subject) AS subject, grade, topics, q, coalesce(cs, chapters) AS cs FROM asked AS a LEFT JOIN lists ON lists.req = a.req),
sims AS (SELECT r.req, b.id, round(list_cosine_similarity(b.e, r.q), 6) AS s FROM r JOIN both_ AS b ON b.grade = r.grade AND contains(lower(b.subject), r.subject) AND (len(cs) = 0 OR list_contains(cs, b.chapter)) WHERE b.e IS NOT NULL AND r.q IS NOT NULL),
staged AS (SELECT *, max(s) OVER (PARTITION BY req) AS top FROM sims WHERE s > 0.3),
a AS (SELECT req, id, s AS s1, row_number() OVER (PARTITION BY req ORDER BY s DESC, id) - 1 AS r1 FROM staged WHERE top <= 0.65 OR s > 0.65 QUALIFY r1 < 8),
words AS (SELECT req, unnest(list_concat(topics, cs)[1:6]) AS w, unnest(range(least(6, len(topics) + len(cs)))) AS ord FROM r),
found AS (SELECT r.req, ord, b.id, len(cs) = 0 OR list_contains(cs, b.chapter) AS strict FROM r JOIN words ON words.req = r.req JOIN corpus AS b ON b.grade = r.grade AND contains(lower(b.subject), r.subject) AND contains(lower(b.content), lower(w)) WHERE length(w) >= 2),
opened AS (SELECT *, bool_or(coalesce(strict, false)) OVER (PARTITION BY req, ord) AS any_strict FROM found),
ranked AS (SELECT *, row_number() OVER (PARTITION BY req, ord ORDER BY id) AS rn FROM opened WHERE strict OR NOT any_strict),
once AS (SELECT req, id, min(ord * 100 + rn) AS seq FROM ranked WHERE rn <= 6 GROUP BY req, id),
b AS (SELECT req, id, row_number() OVER (PARTITION BY req ORDER BY seq) - 1 AS r2 FROM once QUALIFY r2 < 6),
f AS (SELECT coalesce(a.req, b.req) AS req, coalesce(a.id, b.id) AS id, r1, r2, round(coalesce(1.0::DOUBLE / (61 + r1), 0) + coalesce(1.0::DOUBLE / (61 + r2), 0), 9) AS rrf_score, CASE WHEN r2 IS NOT NULL THEN 0.6::DOUBLE ELSE s1 END AS similarity,
  CASE WHEN r2 IS NOT NULL THEN 'keyword' ELSE 'vector' END AS source FROM a FULL JOIN b ON a.id = b.id AND a.req = b.req),
hits AS (SELECT req, id, rrf_score, similarity, source, CAST(row_number() OVER (PARTITION BY req ORDER BY rrf_score DESC, r1 NULLS LAST, r2 NULLS LAST) AS INTEGER) AS pos FROM f)"""


def asked_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("req"), F.col("embedding").alias("vector"))
    k, words = F.col("item_id"), F.slice(F.split("text", " "), 1, 2)
    chapters = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("SRC"), (k % 25).cast("string")), F.concat(F.lit("src "), (k % 7).cast("string"))))
    rows = read_table(spark, sf_dir, "benchmark").select(k.alias("req"), F.when(k % 3 == 0, "EN").when(k % 3 == 1, "fr").otherwise("e").alias("subject"), (k % 3).cast("string").alias("grade"), chapters.alias("chapters"), F.array(F.array_join(words, ", ")).alias("topics"))
    return rows.join(near, "req", "left")


@query(f"WITH {ASKED} SELECT * FROM hits WHERE pos <= 10")
def retrieve_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items at once: names, vectors and keywords of each, in one scan of the texts."""
    return many.retrieve_contexts(texts_and_vectors(spark, sf_dir), asked_of_items(spark, sf_dir), Workspace(spark, "retrieve"))


def stand_in_batch(prompt: str, of_second: bool = False) -> str:
    """As many questions as follow from the topic and the batch in the prompt; sometimes none, and for some topics an error."""
    topic, batch = int(re.search(r"topic (\d+)", prompt)[1]), re.search(r"batch (\d+) of", prompt)
    b = int(batch[1]) if batch else 1
    n = (topic + b) % 5 if of_second else (topic * 7 + b * 3) % 13 - 2
    if topic % 10 == 0 and not of_second:
        raise ValueError("no such model")
    one = '{{"text": "What is number {} of batch {} of topic {}?", "format": "mcq", "options": ["A) 1", "B) 2", "C) 3", "D) 4"], "correct_answer": "A) 1", "explanation": "it is the first one in the list of the text"}}'
    return '{"questions": [' + ", ".join(one.format(i, b, topic) for i in range(n)) + "]}"


def stand_in_batch_again(prompt: str) -> str:
    return stand_in_batch(prompt, True)


@query("""WITH RECURSIVE r AS (SELECT c_custkey AS req, (c_custkey % 4 + 1) * least(c_custkey % 11 + 1, CASE WHEN c_custkey % 2 = 0 THEN 8 ELSE 10 END) AS requested FROM customer),
t AS (SELECT req, requested, CAST(ceil(least(ceil(requested * 1.30::DOUBLE)::BIGINT, requested + 15) / 12.0) AS BIGINT) AS batches FROM r),
s AS (SELECT req, requested, batches, 0::BIGINT AS rounds, 0::BIGINT AS first_, 0::BIGINT AS second_ FROM t UNION ALL SELECT req, requested, batches, rounds + 1, first_ + got, second_ + CASE WHEN got = 0 THEN (req + rounds + 1) % 5 ELSE 0 END FROM (
  SELECT *, CASE WHEN req % 10 = 0 THEN 0 ELSE greatest(0, (req * 7 + (rounds + 1) * 3) % 13 - 2) END AS got FROM s WHERE rounds < batches AND first_ + second_ < requested + 5))
SELECT req, max(first_) AS of_first, max(second_) AS of_second, max(rounds) FILTER (first_ + second_ > 0) IS NOT NULL AS some FROM s GROUP BY req""")
def generation_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test for each customer, of one to four sections: how many questions came of either generator."""
    k, level = F.col("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, "medium").otherwise("easy")
    rows = read_table(spark, sf_dir, "customer").select(k.alias("req"), F.concat(F.lit("topic "), k.cast("string")).alias("subject"), level.alias("difficulty"), F.lit("mcq").alias("form"), (k % 11 + 1).alias("quantity"), F.explode(F.sequence(F.lit(0).cast("long"), k % 4)).alias("sec"))
    asked = rows.where("sec = 0").drop("sec", "quantity").join(generation.targets(rows), "req")
    made = generation.in_rounds(asked, asked.select("req", F.col("subject").alias("context")), [stand_in_batch, stand_in_batch_again], Workspace(spark, "rounds"))
    n = made.groupBy("req").agg(F.count_if(F.col("source") == 0).alias("of_first"), F.count_if(F.col("source") == 1).alias("of_second"))
    return asked.select("req").join(n, "req", "left").select("req", F.coalesce("of_first", F.lit(0)).alias("of_first"), F.coalesce("of_second", F.lit(0)).alias("of_second"), F.col("of_first").isNotNull().alias("some"))


@query(f"""WITH {ASKED}, n AS (SELECT DISTINCT req FROM hits)
SELECT r.req, CASE WHEN r.req % 7 >= 3 THEN 'limit_reached' WHEN n.req IS NULL THEN 'no_content' ELSE 'preview' END AS status, CASE WHEN r.req % 7 < 3 AND n.req IS NOT NULL THEN least(3, r.req % 4 + 1) ELSE 0 END::BIGINT AS total_questions FROM r LEFT JOIN n ON n.req = r.req""")
def build_test_from_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests for the items of benchmark whose texts are retrieved; two sections each, one of them capped."""
    asked = asked_of_items(spark, sf_dir).withColumns({"title": F.lit("t"), "owner": F.lit("x"), "difficulty": F.lit("medium"), "form": F.lit("mcq"), "iteration": F.col("req") % 7})
    one = lambda sec, n: F.struct(F.lit(sec).alias("sec"), F.lit("medium").alias("difficulty"), F.lit("balanced").alias("profile"), F.lit("mcq").alias("format"), n.cast("long").alias("quantity"), F.lit(None).cast("string").alias("levels"))
    parts = asked.select("req", F.inline(F.array(one(0, F.col("req") % 4), one(1, F.lit(1)))))
    outcomes, tests, _ = assembly.build_test(asked, None, [stand_in_generator], [stand_in_validator], parts, texts_and_vectors(spark, sf_dir))
    return outcomes.join(tests.select(F.col("test_id").alias("req"), "total_questions"), "req", "left").select("req", "status", F.coalesce("total_questions", F.lit(0)).cast("long").alias("total_questions"))


@query("""SELECT conv_id AS id, 'owner' || conv_id AS teacher_id, string_agg(turn || ':' || text, '|' ORDER BY turn) AS questions FROM conversations WHERE conv_id = 1 GROUP BY conv_id""")
def get_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    tests = rows.select(F.col("conv_id").alias("id"), F.concat(F.lit("owner"), F.col("conv_id").cast("string")).alias("teacher_id")).distinct()
    found = store.get_test(tests, rows.select(F.col("conv_id").alias("test_id"), F.col("turn").alias("position"), "text"), 1, "owner1")
    return found.select("id", "teacher_id", F.array_join(F.transform("questions", lambda q: F.concat_ws(":", q["position"].cast("string"), q["text"])), "|").alias("questions"))


@query("""WITH f AS (SELECT l_orderkey AS test_id, l_linenumber AS q, l_linenumber % 3 AS a FROM lineitem), o AS (SELECT o_orderkey AS test_id, o_orderkey % 5 AS iteration FROM orders WHERE o_orderkey % 5 < 3 AND EXISTS (SELECT 1 FROM f WHERE f.test_id = o_orderkey)),
t AS (SELECT test_id, count(*) AS training FROM f WHERE a < 2 GROUP BY test_id), r AS (SELECT test_id, string_agg(CAST(q AS VARCHAR), ',' ORDER BY q) AS rejected FROM (SELECT DISTINCT test_id, q FROM f WHERE a = 0) GROUP BY test_id)
SELECT o.test_id, o.iteration + 1 AS iteration, o.test_id AS previous_test_id, coalesce(training, 0) AS training, coalesce(rejected, '') AS rejected FROM o LEFT JOIN t ON t.test_id = o.test_id LEFT JOIN r ON r.test_id = o.test_id""")
def apply_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("test_id"), F.col("o_custkey").alias("owner"), (F.col("o_orderkey") % 5).alias("iteration"))
    action = F.when(F.col("l_linenumber") % 3 == 0, "reject").when(F.col("l_linenumber") % 3 == 1, "edit").otherwise("approve")
    told = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("test_id"), F.col("l_linenumber").alias("question_id"), action.alias("action"), F.col("l_returnflag").alias("comment"))
    training, ids, again = store.apply_feedback(asked, told)
    out = again.join(training.groupBy("test_id").agg(F.count("*").alias("training")), "test_id", "left").join(ids, "test_id", "left")
    rejected = F.coalesce(F.array_join(F.transform("rejected", lambda q: q.cast("string")), ","), F.lit(""))
    return out.select("test_id", "iteration", "previous_test_id", F.coalesce("training", F.lit(0)).cast("long").alias("training"), rejected.alias("rejected"))
