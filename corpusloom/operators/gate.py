"""Gates and answers: what a generated question must meet, verdicts on it, confidence and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparison_text, repaired_json

# Formats, levels that suit a difficulty and the one given otherwise, hedging words, and the options of assertions.
FORMATS = ("mcq", "short_answer", "long_answer", "assertion_reason", "case_based")
LEVELS = {"easy": ("remember", "understand"), "medium": ("understand", "apply"), "hard": ("apply", "analyze"), "very_hard": ("analyze", "evaluate", "create")}
DEFAULT_LEVEL = {"easy": "remember", "medium": "apply", "hard": "analyze", "very_hard": "analyze"}
HEDGES = ("plausible", "likely", "probably", "seems", "might be")
MATHS = ("mathematics", "maths", "math")
ASSERTION_OPTIONS = (
    "A) Both A and R are true and R is the correct explanation of A",
    "B) Both A and R are true but R is NOT the correct explanation of A",
    "C) A is true but R is false",
    "D) A is false but R is true",
)

ANSWER = "struct<questions:array<struct<text:string,format:string,options:array<string>,correct_answer:string,explanation:string,marks:double,difficulty:string,bloom_level:string,chapter:string,topic:string>>>"


def parse_answers(raw: DataFrame) -> DataFrame:
    """req and its questions with pos for raw(req, answer), the text of a generator; unreadable answers give no rows."""
    parsed = raw.select("req", F.from_json(repaired_json(F.col("answer")), ANSWER).alias("a"))
    return parsed.select("req", F.posexplode("a.questions").alias("pos", "q")).where("q is not null").select("req", "pos", "q.*")


def matched_option(options: Column, answer: Column) -> Column:
    """The answer itself if it is an option, else the first option with its first two characters, whatever their case."""
    head = lambda c: F.upper(F.substring(c, 1, 2))
    alike = F.filter(options, lambda o: head(o) == head(answer))
    return F.when(F.array_contains(options, answer), answer).when((F.length(answer) >= 2) & (F.size(alike) > 0), F.get(alike, F.lit(0)))


def by_difficulty(difficulty: Column, values: dict[str, Column]) -> Column:
    """The value of a difficulty; the medium one for what is none."""
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return F.coalesce(F.try_element_at(table, difficulty), values["medium"])


def quality_gate(questions: DataFrame, subject: str | Column, difficulty: str | Column = "medium") -> DataFrame:
    """questions(req, pos, text, format, options, correct_answer, explanation, marks, bloom_level, chapter) with their columns
    repaired and drop_reason, null for those that pass. Marks that are not a number of at least 1 become 1, as does a number
    given as text. Subject and difficulty are the same for all questions, or columns.

    In order: short (under 15 characters), duplicate of an earlier one of the request that was not short, vague (explanation
    under 30 characters), hedged (in mathematics), options (multiple choice without four), answer (none of the options).
    """
    trimmed = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = questions.withColumns({"text": trimmed("text"), "correct_answer": trimmed("correct_answer"), "explanation": trimmed("explanation"), "chapter": trimmed("chapter")})
    rows = rows.withColumn("_short", F.length("text") < 15)
    again = Window.partitionBy("req", "_short", "_norm").orderBy("pos")
    rows = rows.withColumn("_norm", comparison_text(F.col("text"))).withColumn("_nth", F.row_number().over(again))
    subject, difficulty = (F.lit(x) if isinstance(x, str) else x for x in (subject, difficulty))
    form = F.when(F.col("format").isin(*FORMATS), F.col("format")).otherwise("mcq")
    level = F.lower(F.trim(F.coalesce("bloom_level", F.lit(""))))
    fits = F.array_contains(by_difficulty(difficulty, {k: F.array(*map(F.lit, v)) for k, v in LEVELS.items()}), level)
    level = F.when(fits, level).otherwise(by_difficulty(difficulty, {k: F.lit(v) for k, v in DEFAULT_LEVEL.items()}))
    marks = F.lit(None).cast("double") if dict(questions.dtypes)["marks"] == "string" else F.col("marks").cast("double")
    rows = rows.withColumns({"format": form, "difficulty": difficulty, "bloom_level": level, "marks": F.when(marks >= 1, marks.cast("int")).otherwise(1)})
    four = F.coalesce(F.size("options") == 4, F.lit(False))
    defaults = F.array(*map(F.lit, ASSERTION_OPTIONS))
    options = F.when((F.col("format") == "assertion_reason") & ~four, defaults).otherwise(F.col("options"))
    rows = rows.withColumn("options", options)
    found = matched_option(F.col("options"), F.col("correct_answer"))
    answer = F.when(F.col("format") == "assertion_reason", F.coalesce(found, F.get("options", F.lit(0)))).when(F.col("format") == "mcq", F.coalesce(found, F.col("correct_answer"))).otherwise(F.col("correct_answer"))
    hedged = F.lower(subject).isin(*MATHS) & F.lower("explanation").rlike("|".join(HEDGES))
    reason = (
        F.when(F.col("_short"), "short").when(F.col("_nth") > 1, "duplicate").when(F.length("explanation") < 30, "vague").when(hedged, "hedged")
        .when((F.col("format") == "mcq") & ~F.coalesce(F.size("options") == 4, F.lit(False)), "options").when((F.col("format") == "mcq") & found.isNull(), "answer")
    )
    rows = rows.withColumn("drop_reason", reason).withColumn("correct_answer", answer)
    rows = rows.withColumn("options", F.when(F.col("format").isin("mcq", "assertion_reason"), F.col("options")))
    return rows.withColumn("id", F.sha2(F.concat_ws("|", F.col("req").cast("string"), F.col("pos").cast("string"), "text"), 256)).drop("_short", "_norm", "_nth")


VERDICT = "struct<validations:array<struct<index:int,valid:boolean,fixed_correct_answer:string,fixed_explanation:string,notes:string>>>"


def parse_verdicts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """verdicts(req, index, valid, fixed_correct_answer, fixed_explanation, notes) of raw(req, answer), and the requests whose
    answer can't be read."""
    parsed = raw.select("req", F.from_json(repaired_json(F.col("answer")), VERDICT)["validations"].alias("v"))
    return parsed.select("req", F.inline("v")), parsed.where("v is null").select("req")


def apply_verdicts(questions: DataFrame, verdicts: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """questions(req, pos, correct_answer, explanation, ...) with verdicts(req, index from 1, valid, fixed_correct_answer,
    fixed_explanation, notes): what is not valid takes the fixes that are not empty, and its notes.

    Every question of a request that was validated is verified, the fixed ones too; those of the requests in failed(req),
    whose validation failed, stay as they are and need review. Verdicts beyond the list go unused; of several on one
    question one counts.
    """
    v = verdicts.select("req", (F.col("index") - 1).alias("pos"), F.coalesce("valid", F.lit(True)).alias("valid"), "fixed_correct_answer", "fixed_explanation", "notes").dropDuplicates(["req", "pos"])
    out = questions.join(v, ["req", "pos"], "left")
    if failed is None:
        out = out.withColumn("failed", F.lit(False))
    else:
        out = out.join(failed.select("req").distinct().withColumn("failed", F.lit(True)), "req", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    bad = F.coalesce(~F.col("valid"), F.lit(False)) & ~F.col("failed")
    fix = lambda new, old: F.when(bad, F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old))).otherwise(F.col(old))
    fixed = {"correct_answer": fix("fixed_correct_answer", "correct_answer"), "explanation": fix("fixed_explanation", "explanation")}
    own = [fixed[c].alias(c) if c in fixed else F.col(c) for c in questions.columns if c not in ("validation_status", "validation_notes")]
    return out.select(*own, F.when(F.col("failed"), "needs_review").otherwise("verified").alias("validation_status"), F.when(bad, F.col("notes")).alias("validation_notes"))


def confidence(answer: Column, top: Column) -> Column:
    """0.5, 0.2 more for an answer of 81 to 399 characters, 0.3 times the mean relevance of the first three; between 0.1 and 1."""
    n = F.length(answer)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), 0.5 + F.when((n > 80) & (n < 400), 0.2).otherwise(0.0) + 0.3 * F.coalesce(top, F.lit(0.0))))


def fallback_answer(content: Column) -> Column:
    """The first two sentences of more than 20 characters if there are two, else the first 250 characters."""
    sentences = F.filter(F.split(content, r"\. "), lambda s: F.length(s) > 20)
    return F.when(F.size(sentences) >= 2, F.concat(F.array_join(F.transform(F.slice(sentences, 1, 2), lambda s: F.trim(s)), ". "), F.lit("."))).otherwise(F.substring(content, 1, 250))


def answer_or_prefix(answer: Column, content: Column, n: int = 200) -> Column:
    """The answer, or the first n characters of the text where the answer has fewer than 10."""
    return F.when(F.length(F.coalesce(F.trim(answer), F.lit(""))) < 10, F.substring(content, 1, n)).otherwise(answer)


def question_status(question: Column, least: int = 3, most: int = 500, truncate: bool = True) -> Column:
    n = F.length(F.trim(F.coalesce(question, F.lit(""))))
    return F.when(n < least, "too_short").when(n > most, "truncated" if truncate else "too_long").otherwise("ok")


def build_context(hits: DataFrame, n: int = 5, prefix: int = 400) -> DataFrame:
    """qid and one text of the first n hits(qid, pos, chapter, content), numbered, with a blank line between them."""
    part = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.coalesce(F.nullif("chapter", F.lit("")), F.lit("Unknown")), F.lit(": "), F.substring("content", 1, prefix))
    rows = hits.where(F.col("pos") <= n).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("parts"))
    return rows.select("qid", F.array_join(F.col("parts.part"), "\n\n").alias("context"))


def with_no_results(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Every question: its number of hits, or a fixed answer with confidence 0.1 if there are none."""
    n = hits.groupBy("qid").agg(F.count("*").alias("hits"))
    out = questions.join(n, "qid", "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))
    return out.select("qid", "hits", F.when(F.col("hits") == 0, "no matching text").alias("message"), F.when(F.col("hits") == 0, 0.1).alias("confidence"))


# What a prompt asks for by type of question, by difficulty and by format.
TYPE_RULES = {
    "recall": "Ask for facts that the text states: a definition, a name, a list.",
    "conceptual": "Ask for reasons, differences or consequences; no question may be a bare definition.",
    "application": "Put each question into a situation of daily life to which an idea of the text applies.",
    "numerical": "Each question must be calculated from given values; the explanation shows every step.",
    "assertion_reason": "Each text is an assertion (A) and a reason (R); the options are the four standard ones.",
}
DIFFICULTY_RULES = {
    "easy": "One idea of the text, no reasoning in steps.",
    "medium": "Understanding is needed, and up to two ideas together.",
    "hard": "Several steps or ideas in an unfamiliar setting; wrong options must be tempting.",
}
FORMAT_RULES = {"mcq": "Give exactly four options; the answer repeats one of them.", "assertion_reason": "Use the four standard options; vary the right one."}


def rule(column: Column, rules: dict[str, str], other: str | None = None) -> Column:
    """The rule for a column's value; without one that of `other`, or nothing."""
    table = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    return F.coalesce(F.try_element_at(table, column), F.lit(rules[other]) if other else F.lit(None).cast("string"))


def build_prompts(requests: DataFrame, contexts: DataFrame, prefix: int = 1000) -> DataFrame:
    """req and prompt for requests(req, subject, difficulty, n, form) with contexts(req, context), cut to prefix characters.

    Columns qtype, plan, feedback, batch and batches may follow; what they ask for, and the rules of the difficulty and the
    form, stand in the prompt as lines of their own. The feedback "string" is none.
    """
    rows = requests.join(contexts, "req", "left")
    has = lambda c: F.col(c) if c in requests.columns else F.lit(None)
    head = F.format_string("Write %d %s questions on %s. Difficulty: %s.", F.col("n").cast("int"), F.col("form"), F.col("subject"), F.col("difficulty"))
    feedback = F.nullif(F.nullif(has("feedback").cast("string"), F.lit("string")), F.lit(""))
    maths = F.when(F.lower("subject").isin(*MATHS), "Set formulas between dollar signs.")
    again = F.when(has("batch").cast("int") > 1, F.format_string("This is batch %d of %d: repeat nothing of those before.", has("batch").cast("int"), has("batches").cast("int")))
    plan = F.concat(F.lit("Over the whole test:\n"), has("plan").cast("string"))
    rules = F.concat_ws("\n", plan, rule(has("qtype").cast("string"), TYPE_RULES), rule(F.col("difficulty"), DIFFICULTY_RULES, "medium"), rule(F.col("form"), FORMAT_RULES), maths, F.concat(F.lit("The teacher asks: "), feedback), again)
    body = F.coalesce(F.nullif(F.substring("context", 1, prefix), F.lit("")), F.lit("No text is given."))
    return rows.select("req", F.concat_ws("\n\n", head, rules, F.concat(F.lit("Use only this text:\n"), body), F.lit("Answer with one JSON object that has the key questions.")).alias("prompt"))
