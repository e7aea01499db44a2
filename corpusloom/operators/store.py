"""The relational store around questions: parents and children, owners, updates and deletes by rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains


#: Rows that one task joins, so that its memory does not grow with the tables.
TASK_ROWS = 250_000


def with_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, order: str) -> DataFrame:
    """Every parent with its children's `order` column, in order, as one array; parents without children have an empty one."""
    lists = children.groupBy(F.col(child_key).alias(key)).agg(F.array_sort(F.collect_list(order)).alias("children"))
    return parents.join(lists, key, "left").withColumn("children", F.coalesce("children", F.array().cast(lists.schema["children"].dataType)))


def owned_by(children: DataFrame, parents: DataFrame, child_key: str, key: str, owner: Column) -> DataFrame:
    """Children whose parent meets the owner predicate (EXISTS)."""
    return children.join(parents.where(owner).select(F.col(key).alias(child_key)), child_key, "left_semi")


def exactly_one(rows: DataFrame, where: Column) -> DataFrame:
    """The single row that meets a predicate; none or several are an error."""
    found = rows.where(where).limit(2)
    n = found.count()
    if n != 1:
        raise LookupError(f"one row expected, {'none' if n == 0 else 'several'} found")
    return found


def updated(rows: DataFrame, where: Column, column: str, value) -> DataFrame:
    return rows.withColumn(column, F.when(where, F.lit(value)).otherwise(F.col(column)))


def without_subject(corpus: DataFrame, subject: str, grade: str) -> DataFrame:
    """Rows that DELETE ... WHERE subject ILIKE %subject% AND grade = grade leaves; where the predicate is null a row stays."""
    return corpus.where(~F.coalesce(contains(F.col("subject"), subject) & (F.col("grade") == grade), F.lit(False)))


def deleted_count(corpus: DataFrame, subject: str, grade: str) -> DataFrame:
    return corpus.agg(F.count_if(contains(F.col("subject"), subject) & (F.col("grade") == grade)).alias("deleted"))


def drafts(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parent and child rows for requests(test_id, owner, title, questions array of struct with text and marks); positions count from 0."""
    children = requests.select("test_id", F.posexplode("questions").alias("position", "q")).select("test_id", "position", F.col("q.text").alias("text"), F.coalesce("q.marks", F.lit(1)).alias("marks"))
    total = F.aggregate(F.transform("questions", lambda q: F.coalesce(q["marks"], F.lit(1))), F.lit(0), lambda a, x: a + x)
    valid = F.col("owner").rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    owner = F.when(valid, F.col("owner")).otherwise("00000000-0000-0000-0000-000000000000")
    return requests.select("test_id", owner.alias("owner"), "title", F.lit("draft").alias("status"), F.size("questions").alias("total_questions"), total.alias("total_marks")), children


def quiz_links(tests: DataFrame, minutes: int = 60, tab_limit: int = 3) -> DataFrame:
    """A quiz for each test(test_id, total_marks) and its link."""
    quiz = F.sha2(F.concat(F.lit("quiz|"), F.col("test_id").cast("string")), 256)
    return tests.select(quiz.alias("quiz_id"), "test_id", F.lit(minutes).alias("duration_minutes"), F.col("total_marks").alias("max_marks"), F.lit(tab_limit).alias("tab_switch_limit"), F.lit("active").alias("status"), F.concat(F.lit("/quiz/"), quiz).alias("link"))


def get_test(tests: DataFrame, questions: DataFrame, test_id, owner: str) -> DataFrame:
    """The test of an id and owner with its questions in order as one array; none, or several, are an error."""
    found = exactly_one(tests, (F.col("id") == test_id) & (F.col("teacher_id") == owner))
    own = questions.where(F.col("test_id") == test_id).withColumnRenamed("test_id", "_test")
    fields = [c for c in own.columns if c not in ("_test", "position")]
    lists = own.groupBy("_test").agg(F.array_sort(F.collect_list(F.struct("position", *fields))).alias("questions"))
    empty = F.array().cast(lists.schema["questions"].dataType)
    return found.join(lists, F.col("id") == F.col("_test"), "left").drop("_test").withColumn("questions", F.coalesce("questions", empty))


def apply_feedback(requests: DataFrame, feedback: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What teachers' feedback(test_id, question_id, action, comment) on requests(test_id, owner, iteration, ...) leads to.

    Training rows for what was rejected or edited; the rejected ids by test; and the requests again, one iteration on, with
    the test they follow as previous_test_id. Tests at `most` iterations, and those without feedback, take no part. Rows are dealt by
    test to as many tasks as there are TASK_ROWS of them.
    """
    parts = max(1, *(-(-rows.count() // TASK_ROWS) for rows in (requests, feedback)))
    below = requests.where(F.col("iteration") < most).repartition(parts, "test_id")
    open_tests = below.join(feedback.select("test_id").repartition(parts, "test_id").distinct(), "test_id", "left_semi")
    chosen = rejected(feedback).repartition(parts, "test_id").join(below.select("test_id", "owner"), "test_id")  # it has feedback, as it is some
    training = chosen.select("test_id", "owner", "question_id", F.coalesce("comment", F.lit("")).alias("teacher_feedback"), "action")
    ids = chosen.where("action = 'reject'").groupBy("test_id").agg(F.array_sort(F.collect_set("question_id")).alias("rejected"))
    again = open_tests.withColumn("iteration", F.col("iteration") + 1).withColumn("previous_test_id", F.col("test_id"))
    return training, ids, again


def rejected(feedback: DataFrame) -> DataFrame:
    """Feedback that rejects or edits a question."""
    return feedback.where(F.col("action").isin("reject", "edit"))


def feedback_status(requests: DataFrame, most: int = 3) -> DataFrame:
    """requests(test_id, iteration): another round is allowed below `most`."""
    return requests.select("test_id", "iteration", F.when(F.col("iteration") >= most, "limit_reached").otherwise("ok").alias("status"))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, key: str) -> DataFrame:
    """Children without a parent: what a foreign key would refuse."""
    return children.join(parents.select(F.col(key).alias(child_key)), child_key, "left_anti")
