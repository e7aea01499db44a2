"""What a printed paper shows: numbered questions, lettered options with the right one marked, and the grid of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import class_number, formula_markup, is_correct, option_label, option_text


def option_rows(questions: DataFrame, answers: bool = True, text_too: bool = True) -> DataFrame:
    """req, number, label, option, correct for questions(req, pos, options, correct_answer); text_too as in is_correct."""
    rows = questions.select("req", (F.col("pos") + 1).alias("number"), "correct_answer", F.posexplode("options").alias("k", "raw"))
    label = option_label(F.col("k") + 1)
    correct = is_correct(F.col("raw"), label, F.col("correct_answer"), text_too) if answers else F.lit(False)
    return rows.select("req", "number", label.alias("label"), option_text(formula_markup(F.col("raw"))).alias("option"), correct.alias("correct"))


def question_rows(questions: DataFrame) -> DataFrame:
    marks = F.coalesce("marks", F.lit(1))
    unit = F.when(marks == 1, " mark]").otherwise(" marks]")
    return questions.select("req", (F.col("pos") + 1).alias("number"), formula_markup(F.col("text")).alias("text"), F.concat(F.lit("["), marks.cast("string"), unit).alias("marks_label"))


def answer_grid(questions: DataFrame, columns: int = 5) -> DataFrame:
    """req, line and cells c0, c1, ... with "Q" number ". " and the whole answer of questions(req, pos, correct_answer); cells
    of a line that no question fills are empty."""
    cell = F.concat(F.lit("Q"), (F.col("pos") + 1).cast("string"), F.lit(". "), formula_markup(F.col("correct_answer")))
    rows = questions.select("req", F.expr(f"pos div {columns}").cast("long").alias("line"), (F.col("pos") % columns).alias("c"), cell.alias("cell"))
    return rows.groupBy("req", "line").agg(*[F.coalesce(F.max(F.when(F.col("c") == i, F.col("cell"))), F.lit("")).alias(f"c{i}") for i in range(columns)])


def form_requests(forms: DataFrame) -> DataFrame:
    """forms(form_id, class_grade, rows array of struct topic, subtopic, quantity, difficulty) as sections with total and status.

    Rows without a topic go; labels map to difficulties, medium by default; more than 50 questions, or no topic, is an error.
    """
    # Difficulty labels of the form.
    known = F.create_map(*[F.lit(x) for kv in (("Easy", "easy"), ("easy", "easy"), ("Medium", "medium"), ("medium", "medium"), ("Hard", "hard"), ("hard", "hard"), ("Mixed", "medium"), ("mixed", "medium"), ("Very Hard", "very_hard"), ("very_hard", "very_hard")) for x in kv])
    rows = F.filter("rows", lambda r: F.coalesce(r["topic"], F.lit("")) != "")
    total = F.aggregate(rows, F.lit(0).cast("long"), lambda a, r: a + r["quantity"])
    status = F.when(F.size(rows) == 0, "no_topic").when(total > 50, "too_many").otherwise("ok")
    out = forms.select("form_id", class_number(F.col("class_grade")).alias("grade"), total.alias("total"), status.alias("status"), F.explode_outer(rows).alias("r"))
    return out.select("form_id", "grade", "total", "status", F.col("r.topic").alias("chapter"), F.nullif("r.subtopic", F.lit("")).alias("topic"), F.col("r.quantity").cast("long").alias("quantity"), F.coalesce(F.try_element_at(known, F.coalesce("r.difficulty", F.lit(""))), F.lit("medium")).alias("difficulty"), F.lit("mcq").alias("format"), F.lit(1).alias("marks"))
