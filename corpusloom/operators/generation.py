"""Questions in rounds: a batch for every open request, until it has enough or its batches are used up."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import quota
from ..providers import generated
from ..sources.tables import Workspace
from . import gate

#: A request is done once it has so many questions more than asked for.
SPARE = 5


def targets(sections: DataFrame) -> DataFrame:
    """req, requested, wanted and batches for sections(req, quantity, difficulty): quantities capped by difficulty and summed, with
    what is asked for beyond that, in batches of twelve."""
    rows = sections.groupBy("req").agg(F.sum(quota.capped(F.col("quantity").cast("long"), F.col("difficulty"))).alias("requested"))
    rows = rows.withColumn("wanted", quota.wanted(F.col("requested")))
    return rows.withColumn("batches", F.ceil(F.col("wanted") / quota.BATCH).cast("int"))


def plan_texts(sections: DataFrame) -> DataFrame:
    """req and its plan in words for sections(req, sec, subject, difficulty, profile, format, quantity, levels): questions by type,
    format and level, in a line each."""
    own = sections.withColumns({"sec": F.struct("req", "sec"), "quantity": quota.capped(F.col("quantity").cast("long"), F.col("difficulty"))})
    lines = quota.generation_plan(own).groupBy(F.col("sec.req").alias("req"), "qtype", "format", "levels").agg(F.sum("n").alias("n"))
    line = F.concat_ws(" ", F.col("n").cast("string"), F.col("qtype"), F.lit("as"), F.col("format"), F.concat(F.lit("("), "levels", F.lit(")")))
    return lines.groupBy("req").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("plan"))  # a few lines a request


def in_rounds(requests: DataFrame, contexts: DataFrame, generators: Sequence[Callable[[str], str]], work: Workspace) -> DataFrame:
    """Questions that passed the gate, with req, batch and source (which generator), for requests(req, subject, difficulty, form,
    requested, wanted, batches and maybe feedback, plan) with contexts(req, context).

    In round r every request that has batches left and fewer than requested + 5 questions gets the prompt of its batch r. The
    first generator answers; requests of which no question came of that, because it failed or nothing could be read or
    passed, ask the next one. What passed is appended, and totals grow. A round is a few jobs over the requests still
    open, and there are as many rounds as the largest request has batches. Each answer is written before it is read,
    so nothing is asked twice, whatever is lost.

    Duplicates count within an answer only. Requests without batches have no questions; req must be unique; no requests
    give none.
    """
    columns = [c for c in ("subject", "difficulty", "form", "feedback", "plan") if c in requests.columns]
    state = work.keep(requests.select("req", *columns, "requested", "wanted", "batches", F.lit(0).cast("long").alias("have")))
    passed: list[DataFrame] = []
    r = 0
    while True:
        r += 1
        size = F.least(F.lit(quota.BATCH).cast("long"), F.col("wanted") - quota.BATCH * (r - 1))
        going = state.where((F.col("batches") >= r) & (F.col("have") < F.col("requested") + SPARE)).withColumns({"n": size, "batch": F.lit(r)})
        if going.isEmpty():
            break
        asks, new = work.keep(gate.build_prompts(going, contexts)), []
        for g, generator in enumerate(generators):
            answers = work.keep(generated(asks, [generator]))
            parsed = gate.parse_answers(answers).drop("difficulty").join(going.select("req", "subject", F.col("difficulty").alias("wanted")), "req")
            good = gate.quality_gate(parsed, F.col("subject"), F.col("wanted")).where("drop_reason is null").drop("subject", "wanted", "drop_reason")
            new.append(work.keep(good.withColumns({"batch": F.lit(r), "source": F.lit(g)})))
            work.drop(answers)
            if g < len(generators) - 1:
                asks = asks.join(new[-1].select("req").distinct(), "req", "left_anti")
                if asks.isEmpty():
                    break
        counts = reduce(DataFrame.unionByName, new).groupBy("req").agg(F.count("*").alias("more"))
        before, state = state, work.keep(state.join(counts, "req", "left").withColumn("have", F.col("have") + F.coalesce("more", F.lit(0))).drop("more"))
        work.drop(before)
        passed += new
    if not passed:
        raw = requests.select("req", F.lit(None).cast("string").alias("answer")).where("false")
        empty = gate.quality_gate(gate.parse_answers(raw).drop("difficulty"), "", "medium").drop("drop_reason")
        return empty.withColumns({"batch": F.lit(0), "source": F.lit(0)})
    return reduce(DataFrame.unionByName, passed)


def numbered(questions: DataFrame) -> DataFrame:
    """The questions of all batches of a request with one pos from 0, and ids that follow from it."""
    rows = questions.withColumn("pos", F.row_number().over(Window.partitionBy("req").orderBy("batch", "pos")) - 1)
    return rows.withColumn("id", F.sha2(F.concat_ws("|", F.col("req").cast("string"), F.col("pos").cast("string"), "text"), 256))
