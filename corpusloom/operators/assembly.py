"""Whole tests, from request to draft, for a table of requests at once: texts, prompts in rounds, gate, duplicates, verdicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..providers import embedded, generated
from ..sources.tables import Workspace
from . import dedup, gate, generation, store
from .many import retrieve_contexts

MOST_ITERATIONS, SIMILAR = 3, 0.82
#: Texts of a request's context, and characters of each.
TEXTS, PREFIX = 15, 400

Model = Callable[[str], str]


def verdict_prompts(questions: DataFrame) -> DataFrame:
    """req and prompt that asks for a verdict on each of questions(req, pos, text, options, correct_answer, explanation)."""
    one = F.concat_ws("\n", F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), F.col("text")), F.array_join(F.coalesce("options", F.array().cast("array<string>")), "\n"), F.concat(F.lit("Answer: "), "correct_answer"), F.concat(F.lit("Why: "), "explanation"))
    lists = questions.groupBy("req").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("one")))).alias("all"))  # the questions of one test
    return lists.select("req", F.concat(F.lit("Check each answer. Reply with one JSON object that has the key validations.\n\n"), F.array_join(F.col("all.one"), "\n\n")).alias("prompt"))


def found_contexts(corpus: DataFrame, requests: DataFrame, work: Workspace, texts: int = TEXTS, prefix: int = PREFIX, **how) -> DataFrame:
    """req and context for requests(req, subject, grade, chapters, topics): the beginnings of the texts that retrieval finds."""
    hits = work.keep(retrieve_contexts(corpus, requests, work, most=texts, **how).select("req", "id", "pos"))
    parts = corpus.select(F.col("id").cast("long").alias("id"), "chapter", F.substring("content", 1, prefix).alias("content")).join(hits, "id")
    return gate.build_context(parts.withColumnRenamed("req", "qid"), texts, prefix).withColumnRenamed("qid", "req")


def sections_of(requests: DataFrame, sections: DataFrame | None) -> DataFrame:
    """The sections of requests, or one for each of n questions."""
    if sections is not None:
        return sections.join(requests.select("req", "subject"), "req")
    return requests.select("req", F.lit(0).alias("sec"), "subject", "difficulty", F.lit("balanced").alias("profile"), F.col("form").alias("format"), F.col("n").alias("quantity"), F.lit(None).cast("string").alias("levels"))


def build_test(requests: DataFrame, contexts: DataFrame | None, generators: Sequence[Model], validators: Sequence[Model], sections: DataFrame | None = None, corpus: DataFrame | None = None, most: int = MOST_ITERATIONS, similar: float = SIMILAR, work: Workspace | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tests for requests(req, title, owner, subject, difficulty, form, n, iteration and maybe feedback), whose parts are
    sections(req, sec, difficulty, profile, format, quantity, levels) or else one of n questions, with contexts(req, context).
    Without contexts they are found in a corpus, for requests that also have grade, chapters and topics.

    Three tables come back. outcomes(req, status): limit_reached at `most` iterations, no_content without a context,
    failed if no question came of it, else preview. tests and questions as in store.drafts, whose test_id is req; questions
    also carry their id, options, answer, explanation, level, chapter, format and validation status.

    Quantities are capped by difficulty; with some to spare they are generated in rounds, see generation.in_rounds. Of near
    duplicates the better one stays; the first questions of each request, as many as asked for, are validated, take the
    fixes, and make the draft. Requests run side by side, and nothing of a request is in another's plan. Answers, the
    questions chosen and those checked are written to `work`, so each is computed once; it can be closed when the three
    tables have been read.
    """
    work = work or Workspace(requests.sparkSession, "tests")
    open_ = requests.where(F.coalesce(F.col("iteration") < most, F.lit(True)))
    contexts = work.keep(found_contexts(corpus, open_, work) if contexts is None else contexts.select("req", "context"))
    with_text = contexts.where("context is not null and context <> ''").select("req", F.lit(True).alias("has_text")).distinct()
    parts = sections_of(requests, sections)
    state = requests.join(generation.targets(parts), "req", "left").join(generation.plan_texts(parts), "req", "left").join(with_text, "req", "left")
    state = work.keep(state.select("*", F.when(F.col("iteration") >= most, "limit_reached").when(F.col("has_text").isNull(), "no_content").alias("refused")))
    going = state.where("refused is null")
    made = work.keep(generation.numbered(generation.in_rounds(going, contexts, generators, work)))
    score = dedup.item_score(F.col("text"), F.col("explanation"), F.col("options"), F.col("correct_answer"), F.col("bloom_level"), F.col("chapter"), F.col("format"))
    items = work.keep(embedded(made.select(F.col("req").alias("grp"), F.col("pos").cast("long").alias("idx"), score.alias("score"), "text"), "text").drop("text"))
    kept = dedup.greedy_dedup(items, similar).select(F.col("grp").alias("req"), F.col("idx").cast("int").alias("pos"))
    chosen = made.join(kept, ["req", "pos"]).join(going.select("req", "requested"), "req")
    chosen = work.keep(chosen.withColumn("pos", F.row_number().over(Window.partitionBy("req").orderBy("pos")) - 1).where("pos < requested").drop("requested"))
    verdicts, failed = gate.parse_verdicts(work.keep(generated(verdict_prompts(chosen), validators)))
    checked = work.keep(gate.apply_verdicts(chosen, verdicts, failed))
    fields = ["pos", "id", "text", "options", "correct_answer", "explanation", "marks", "difficulty", "bloom_level", "chapter", "topic", "format", "validation_status", "validation_notes"]
    lists = checked.groupBy("req").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("questions"))  # the questions of one test
    tests, _ = store.drafts(going.select("req", "owner", "title").join(lists, "req").select(F.col("req").alias("test_id"), "owner", "title", "questions"))
    questions = checked.select(F.col("req").alias("test_id"), F.col("pos").alias("position"), *fields[1:])
    some = checked.select("req", F.lit(True).alias("made")).distinct()
    outcomes = state.join(some, "req", "left").select("req", F.coalesce("refused", F.when(F.col("made"), "preview").otherwise("failed")).alias("status"))
    return outcomes, tests, questions
