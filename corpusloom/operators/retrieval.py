"""Lexical and vector retrieval, fusion and name resolution. A batch of questions is one job, never a job a question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import contains, has_devanagari, normalize_name, question_words, word_pattern
from ..functions.vectors import cosine
from ..sources.tables import Workspace
from .many import retrieve_contexts
from .names import best_names, name_matches
from .patterns import AUTOMATON_CHARS, matched_terms

#: Term tables up to this many rows are copied to every task; larger ones are joined by their anchors in a shuffle.
BATCH_ROWS = 5_000
#: Characters of terms up to which all terms are one automaton.
ONE_PASS = AUTOMATON_CHARS
#: Literals up to this many are searched in one pass over the texts, without a join.
LITERALS = 64
#: Words of an anchor, at most.
ANCHOR = 3


def literals(like: DataFrame, values: Sequence, column: str) -> DataFrame:
    """(ord, column) of values given by the caller."""
    return like.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], f"ord int, {column} string")


def with_literals(rows: DataFrame, text: str, values: Sequence[str], column: str) -> DataFrame:
    """rows without text, once for each of the values that the text contains, whatever the case, plus ord and the value.

    The text is lowered once and searched for all values in one pass; more than LITERALS values are a table of terms.
    """
    if len(values) > LITERALS:
        return containing(rows, text, literals(rows, values, column), column).drop(text)
    others = [c for c in rows.columns if c != text]
    terms = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(v).alias(column), F.lower(F.lit(v)).alias("low")) for i, v in enumerate(values)])
    if not values:
        return rows.select(*others, F.lit(0).alias("ord"), F.lit("").alias(column)).limit(0)
    low = rows.select(*others, F.lower(text).alias("_low"))
    return low.select(*others, F.inline(F.filter(terms, lambda t: F.col("_low").contains(t["low"])))).drop("low")


def anchor(low: Column) -> Column:
    """(words, name) of the longest run of at most ANCHOR words that lie whole within a term, null if none does.

    A text that contains the term has the same words next to each other, as white space bounds them in the term itself.
    """
    words = F.split(low, r"\s+")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    n = F.least(F.size(inner), F.lit(ANCHOR))
    runs = F.transform(F.sequence(F.lit(0), F.size(inner) - n), lambda i: F.array_join(F.slice(inner, i + 1, n), " "))
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("size"), r.alias("run"))))["run"]
    return F.when(n > 0, F.struct(n.alias("words"), F.xxhash64(n, longest).alias("name")))


def containing(rows: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """rows joined to the terms (a table with a column `term`) that the text contains, whatever the case.

    Up to ONE_PASS characters of terms are compiled into one automaton, and each text is read once for all of them. Beyond
    that, terms are looked up by anchors, runs of their own whole words: the distinct runs of a text and the anchors meet in
    an equi-join of 64-bit names, and only pairs that share one are compared; terms of fewer than three words have no
    anchor and stay with the automaton. Texts and terms are lowered once, and only keys travel with the runs.
    """
    asked = terms.withColumn("_term", F.lower(term)).withColumn("_anchor", anchor(F.col("_term")))
    asked = asked.withColumns({"_words": F.coalesce("_anchor.words", F.lit(0)), "_name": F.col("_anchor.name")}).drop("_anchor")
    counts = asked.groupBy("_words").agg(F.count("*").alias("n"), F.sum(F.length("_term")).alias("chars")).collect()  # at most ANCHOR + 1 rows
    if sum(r.chars or 0 for r in counts) <= ONE_PASS:
        asked = asked.withColumn("_words", F.lit(0))
        sizes = {0: sum(r.n for r in counts)} if counts else {}
    else:
        sizes = {r["_words"]: r.n for r in counts}
    low = rows.withColumn("_low", F.lower(text))
    loose = asked.where("_words = 0")
    loose = matched_terms(low, "_low", loose, "_term").join(loose, "_term") if sizes.get(0) else None
    widths = sorted(w for w in sizes if w)
    found = None
    if widths:
        own = [c for c, t in rows.dtypes if "map<" not in t]
        keyed = low.withColumn("_key", F.xxhash64(*own))
        words = keyed.select("_key", F.split("_low", r"\s+").alias("_ws"))
        run = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size("_ws") - w, F.lit(0))), lambda i: F.xxhash64(F.lit(w), F.array_join(F.slice("_ws", i + 1, w), " ")))
        names = words.select("_key", F.explode(F.array_distinct(F.concat(*[run(w) for w in widths]))).alias("_name"))
        anchors = asked.where("_words > 0")
        few = sum(n for w, n in sizes.items() if w) <= BATCH_ROWS
        near = names.join(F.broadcast(anchors) if few else anchors, "_name").select("_key", *terms.columns, "_term").distinct()
        found = keyed.join(near, "_key").where(F.col("_low").contains(F.col("_term"))).drop("_key")
    columns = [*rows.columns, *terms.columns]
    parts = [p.select(*columns) for p in (found, loose) if p is not None]
    if not parts:
        return rows.join(terms, F.lit(False)).select(*columns)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def first_rows(rows: DataFrame, by: Sequence[str], order: Sequence, n: int, rank: str = "rn") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def keyword_topk(corpus: DataFrame, keywords: Sequence[str], n: int = 2) -> DataFrame:
    """The n shortest texts that contain each keyword: keyword, id, chars, rn."""
    hits = with_literals(corpus.select("id", "content", F.length("content").alias("chars")), "content", keywords, "keyword")
    return first_rows(hits, ["keyword"], ["chars", "id"], n).select("keyword", "id", "chars", "rn")


def substring_search(corpus: DataFrame, questions: DataFrame, n: int = 3, prefix: int = 500) -> DataFrame:
    """For questions(qid, question) the first n texts by id that contain the whole question; empty names become Unknown."""
    hits = containing(corpus.select("id", "chapter", "subject", "content"), "content", questions.select("qid", "question"), "question")
    hits = first_rows(hits.select("qid", "id", "chapter", "subject", F.substring("content", 1, prefix).alias("excerpt")), ["qid"], ["id"], n)
    name = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))
    return hits.select("qid", "id", name("chapter").alias("chapter"), name("subject").alias("subject"), "excerpt", F.lit(0.7).alias("similarity"), "rn")


def tiered_search(corpus: DataFrame, keywords: Sequence[str], chapters: Sequence[str], fallback_subject: str, most: int = 8, seed: str = "0") -> DataFrame:
    """Texts in tiers: chapter matches (0.9), keyword matches (0.8), and texts of a subject (0.4) if fewer than three came.

    At most three chapters and five keywords count, two of the shortest texts each; a text keeps the first tier that
    found it; a chapter keeps its best text and any above 0.8; the best `most` remain. All tiers come from one plan: the
    fallback joins a count of one row instead of a second job.
    """
    base = corpus.select("id", "chapter", F.length("content").alias("chars"))
    short = lambda hits: first_rows(hits, ["ord"], ["chars", "id"], 2)
    columns = ["id", "chapter", "relevance", "seq"]
    tier1 = short(with_literals(base.withColumn("name", F.col("chapter")), "name", chapters[:3], "term"))
    tier1 = tier1.select("id", "chapter", F.lit(0.9).alias("relevance"), (F.col("ord") * 2 + F.col("rn")).alias("seq"))
    tier2 = short(with_literals(corpus.select("id", "chapter", F.length("content").alias("chars"), "content"), "content", keywords[:5], "term"))
    tier2 = tier2.select("id", "chapter", F.lit(0.8).alias("relevance"), (100 + F.col("ord") * 2 + F.col("rn")).alias("seq"))
    once = lambda rows: rows.groupBy("id").agg(F.min_by(F.struct("chapter", "relevance", "seq"), "seq").alias("s")).select("id", "s.*")
    main = once(tier1.unionByName(tier2))
    spare = corpus.where(contains(F.col("subject"), fallback_subject)).select("id", "chapter").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(seed))), "id").limit(3)
    spare = first_rows(spare.withColumn("one", F.lit(1)), ["one"], [F.md5(F.concat(F.col("id").cast("string"), F.lit(seed))), "id"], 3)
    spare = spare.join(F.broadcast(main.agg(F.count("*").alias("n"))), F.col("n") < 3).select("id", "chapter", F.lit(0.4).alias("relevance"), (200 + F.col("rn")).alias("seq"))
    found = once(main.unionByName(spare)).select(*columns)  # some twenty rows, whatever the corpus
    found = first_rows(found, ["chapter"], [F.desc("relevance"), "seq"], 1 << 30).where("rn = 1 or relevance > 0.8").drop("rn")
    found = found.orderBy(F.desc("relevance"), "seq").limit(most)
    return first_rows(found.withColumn("one", F.lit(1)), ["one"], [F.desc("relevance"), "seq"], most, "pos").select("pos", "id", "chapter", "relevance")


def vector_topk(corpus: DataFrame, query: Sequence[float], k: int = 8, threshold: float = 0.65, chapters: Sequence | None = None) -> DataFrame:
    """id, chapter, similarity of the k nearest texts above a strict threshold; no or empty chapters mean all."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    rows = corpus.where(F.col("chapter").isin(*chapters)) if chapters else corpus
    near = rows.select("id", "chapter", F.round(cosine(F.col("embedding"), vector), 6).alias("similarity"))
    return near.where(F.col("similarity") > threshold).orderBy(F.desc("similarity"), "id").limit(k)


def staged_vector_search(corpus: DataFrame, query: Sequence[float], subject: str, grade: str, chapters: Sequence | None = None, k: int = 8, threshold: float = 0.65, relaxed: float = 0.3, compat: bool = False) -> DataFrame:
    """vector_topk within a subject and grade, by stages: the name as given, in lower case, then the relaxed threshold.

    Similarities are computed once; a row belongs to the first stage that admits it and only rows of the first stage with
    rows remain. With compat, stages 1 and 3 compare the lower-cased column with the name as given, so that they miss
    names with capitals; otherwise every stage compares in lower case.
    """
    vector = F.array(*[F.lit(float(x)) for x in query])
    rows = corpus.where(F.col("grade") == grade)
    rows = rows.where(F.col("chapter").isin(*chapters)) if chapters else rows
    near = rows.select("id", "chapter", F.lower("subject").alias("subject"), F.round(cosine(F.col("embedding"), vector), 6).alias("similarity"))
    given, low = (subject if compat else subject.lower()), subject.lower()
    stage = F.when(F.col("subject").contains(given) & (F.col("similarity") > threshold), 1).when(F.col("subject").contains(low) & (F.col("similarity") > threshold), 2)
    stage = stage.when(F.col("subject").contains(given) & (F.col("similarity") > relaxed), 3)
    staged = near.withColumn("stage", stage).where("stage is not null")
    first = F.broadcast(staged.agg(F.min("stage").alias("first")))  # one row
    return staged.join(first, F.col("stage") == F.col("first")).orderBy(F.desc("similarity"), "id").limit(k).select("id", "chapter", "similarity", "stage")


def keyword_search(corpus: DataFrame, keywords: Sequence[str], subject: str, grade: str, chapters: Sequence[str] | None = None, n: int = 6) -> DataFrame:
    """id, keyword, similarity 0.6, pos: per keyword n texts of the subject, grade and chapters, or of all chapters if there are none.

    Of the first six keywords those of two characters and more count; a text keeps its first keyword; n texts remain.
    """
    words = [w.strip() for w in keywords[:6] if len(w.strip()) >= 2]
    if not words:
        return corpus.sparkSession.createDataFrame([], "pos int, id long, keyword string, similarity double")
    strict = F.col("chapter").isin(*chapters) if chapters else F.lit(True)
    own = corpus.where((F.col("grade") == grade) & contains(F.col("subject"), subject)).select("id", "content", F.coalesce(strict, F.lit(False)).alias("strict"))
    hits = first_rows(with_literals(own, "content", words, "keyword"), ["ord", "strict"], ["id"], n)  # at most 2 n a keyword
    hits = hits.withColumn("any_strict", F.max("strict").over(Window.partitionBy("ord"))).where("strict or not any_strict")
    hits = hits.groupBy("id").agg(F.min(F.struct("ord", "rn", "keyword")).alias("s")).select("id", "s.*").orderBy("ord", "rn").limit(n)
    out = first_rows(hits.withColumn("one", F.lit(1)), ["one"], ["ord", "rn"], n, "pos")
    return out.select("pos", "id", "keyword", F.lit(0.6).alias("similarity"))


def rrf_fusion(first: DataFrame, second: DataFrame, k: int = 60) -> DataFrame:
    """id, rrf_score, similarity, source, pos of two lists (id, rank from 0, similarity): sums of 1 / (k + rank + 1).

    An id in both lists carries the second list's columns. Ties go to the first list's order, then the second's.
    """
    a = first.select("id", F.col("rank").alias("r1"), F.lit(None).cast("int").alias("r2"), F.col("similarity").alias("s1"), F.lit(None).cast("double").alias("s2"))
    b = second.select("id", F.lit(None).cast("int").alias("r1"), F.col("rank").alias("r2"), F.lit(None).cast("double").alias("s1"), F.col("similarity").alias("s2"))
    both = a.unionByName(b).groupBy("id").agg(*[F.max(c).alias(c) for c in ("r1", "r2", "s1", "s2")])
    part = lambda r: F.coalesce(F.lit(1.0) / (k + F.col(r) + 1), F.lit(0.0))
    both = both.select("id", "r1", "r2", F.round(part("r1") + part("r2"), 9).alias("rrf_score"), F.coalesce("s2", "s1").alias("similarity"), F.when(F.col("r2").isNotNull(), "keyword").otherwise("vector").alias("source"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("rrf_score"), F.asc_nulls_last("r1"), F.asc_nulls_last("r2"))  # two result lists
    return both.select("id", "rrf_score", "similarity", "source", F.row_number().over(order).alias("pos"))


def resolve_names(stored: DataFrame, requested: Sequence[str]) -> DataFrame:
    """requested, name, tier for names(name): equal once normalized (1), one within the other (2), two significant words shared (3).

    Per request the best tier wins, then the least normalized name. Requests without a match go, unless none has one:
    then all come back as they are, with tier 0. Requests and names meet by inverted indexes, see names.name_matches.
    """
    return resolved(stored, literals(stored, requested, "requested"))


def resolved(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """The same for a table asked(ord, requested); ord must be unique."""
    asks = asked.select(F.col("ord").alias("_ask"), F.lit(0).alias("scope"), "requested")
    best = best_names(name_matches(stored.select(F.lit(0).alias("scope"), "name"), asks))
    best = best.join(asked, F.col("_ask") == F.col("ord")).select("ord", "requested", "name", "tier")
    none = asked.join(F.broadcast(best.agg(F.count("*").alias("n"))), F.col("n") == 0).select("ord", "requested", F.col("requested").alias("name"), F.lit(0).alias("tier"))  # one row
    return best.unionByName(none)


def candidate_names(corpus: DataFrame, requested: Sequence[str], subject: str, grade: str) -> DataFrame:
    """Names stored for a subject and grade; if fewer than three, also names of the grade that a request's words match in order."""
    own = corpus.where((F.col("grade") == grade) & F.col("chapter").isNotNull())
    bulk = own.where(contains(F.col("subject"), subject)).select(F.col("chapter").alias("name")).distinct()
    patterns = F.array(*[word_pattern(normalize_name(F.lit(r))) for r in requested]).cast("array<string>")
    wide = own.select(F.col("chapter").alias("name")).distinct().withColumn("patterns", patterns).where("exists(patterns, p -> name ilike p)").select("name")
    return bulk.unionByName(wide.join(F.broadcast(bulk.agg(F.count("*").alias("n"))), F.col("n") < 3).select("name")).distinct()


def analyze_questions(questions: DataFrame, dictionary: DataFrame, most: int = 5) -> DataFrame:
    """qid, keywords, chapters and has_devanagari for questions(qid, question), with a dictionary(term, chapter).

    A chapter counts if its term stands anywhere in the lowered question, as a keyword or not; the first `most` by name
    stay. All terms are found in one pass.
    """
    asked = questions.select("qid", F.substring(F.trim("question"), 1, 500).alias("question"))
    hits = matched_terms(asked.select("qid", F.lower("question").alias("low")), "low", dictionary, "term")
    chapters = hits.join(dictionary, F.col("_term") == F.col("term")).groupBy("qid").agg(F.slice(F.array_sort(F.collect_set("chapter")), 1, most).alias("chapters"))
    out = asked.join(chapters, "qid", "left")
    return out.select("qid", F.array_join(question_words(F.col("question")), " ").alias("keywords"), F.coalesce(F.array_join("chapters", "|"), F.lit("")).alias("chapters"), has_devanagari(F.col("question")).alias("has_devanagari"))


def retrieve_context(corpus: DataFrame, query: Sequence[float], chapters: Sequence[str], topics: Sequence[str], subject: str, grade: str, most: int = 10) -> DataFrame:
    """Names resolved, a vector and a keyword list, fused: id, rrf_score, similarity, source, pos of the first `most`; see many.retrieve_contexts."""
    one = corpus.sparkSession.createDataFrame([(0, subject, grade, list(chapters), list(topics), [float(x) for x in query])], "req int, subject string, grade string, chapters array<string>, topics array<string>, vector array<double>")
    return retrieve_contexts(corpus, one, Workspace(corpus.sparkSession, "retrieve"), most=most).drop("req")


def register_match_function(spark: SparkSession, view: str, name: str = "match_chunks") -> None:
    """A SQL table function over a view (id, chapter, subject, grade, embedding): name(vector, subject, grade, chapters, threshold, k).

    Subjects are compared in lower case by containment; null or no chapters mean all; the threshold is strict; the k most
    similar come back, ties by id.
    """
    dot = "aggregate(zip_with(c.embedding, match_vector, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"
    length = lambda v: f"sqrt(aggregate(transform({v}, x -> CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), 0D, (s, x) -> s + x))"
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(match_vector ARRAY<DOUBLE>, match_subject STRING, match_grade STRING, match_chapters ARRAY<STRING>, match_threshold DOUBLE, match_count INT)
RETURNS TABLE (id BIGINT, chapter STRING, similarity DOUBLE)
RETURN SELECT id, chapter, similarity FROM (
  SELECT id, chapter, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS rn FROM (
    SELECT CAST(c.id AS BIGINT) AS id, CAST(c.chapter AS STRING) AS chapter, round(try_divide({dot}, {length("c.embedding")} * {length("match_vector")}), 6) AS similarity
    FROM {view} AS c
    WHERE lower(c.subject) LIKE concat('%', lower(match_subject), '%') AND c.grade = match_grade
      AND (coalesce(size(match_chapters), 0) = 0 OR array_contains(match_chapters, CAST(c.chapter AS STRING))))
  WHERE similarity > match_threshold)
WHERE rn <= match_count""")


def suggestions(like: DataFrame, values: Sequence[str], n: int = 3, seed: int = 0) -> DataFrame:
    """n of the given questions, drawn by a seed."""
    return like.sparkSession.createDataFrame([(list(values),)], "v array<string>").select(F.explode(F.slice(F.shuffle("v", F.lit(seed)), 1, n)).alias("suggestion"))
