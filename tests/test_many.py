"""Retrieval for many requests, names, patterns and generation in rounds, against plain loops."""

import json
import math
import random
import re
import sys

import numpy as np
import pytest
from corpusloom.functions.text import NAME_STOP_WORDS
from corpusloom.operators import assembly, generation, many, names, patterns, retrieval
from corpusloom.sources.tables import Workspace
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- names


def normal(name):
    return re.sub(r"\s+", " ", re.sub(r"\s+", " ", name.strip()).replace(" & ", " and ").replace("&", " and ")).strip().lower()


def tier_of(asked, stored):
    a, b = normal(asked), normal(stored)
    words = lambda x: set(x.split(" ")) - set(NAME_STOP_WORDS)
    return 1 if a == b else 2 if a in b or b in a else 3 if len(words(a) & words(b)) >= 2 else None


def some_names(seed, n):
    r = random.Random(seed)
    words = ["light", "force", "and", "of", "the", "acids", "Bases", "salts", "a", "in", "motion", "heat", "eye", "Human", "x", "no", "électricité", "&"]
    return ["  ".join(r.choice(words) for _ in range(r.randint(1, 4))) if r.random() < 0.3 else " ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(n)]


def test_name_matches_as_all_pairs(spark):
    stored = [(s, n) for i, n in enumerate(some_names(1, 60)) for s in ("p", "q")[: i % 2 + 1]] + [("p", None), ("p", ""), (None, "heat")]
    asked = [(i, "pq"[i % 2], n) for i, n in enumerate([*some_names(2, 40), "li", "t", "", "force light", "nothing alike zzz"])] + [(90, "p", None), (91, None, "heat")]
    found = names.name_matches(spark.createDataFrame(stored, "scope string, name string"), spark.createDataFrame(asked, "_ask int, scope string, requested string"))
    want = {(i, t, normal(n), n) for i, s, q in asked for z, n in stored if q is not None and n and s is not None and s == z and (t := tier_of(q, n))}
    assert {tuple(r) for r in found.collect()} == want
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_many_names_without_a_nested_loop(spark):
    stored = spark.range(3000).select(F.concat(F.lit("chapter "), F.col("id").cast("string"), F.lit(" of book "), (F.col("id") % 50).cast("string")).alias("name"))
    asked = spark.range(300).select(F.col("id").alias("ord"), F.concat(F.lit("Chapter "), (F.col("id") * 10).cast("string"), F.lit(" of Book "), (F.col("id") * 10 % 50).cast("string")).alias("requested"))
    found = retrieval.resolved(stored, asked)
    assert found.where("tier = 1").count() == found.count() == 300
    assert "Cartesian" not in plan(names.name_matches(stored.select(F.lit(0).alias("scope"), "name"), asked.select(F.col("ord").alias("_ask"), F.lit(0).alias("scope"), "requested")))


# ---- patterns


def test_terms_within_texts(spark, monkeypatch):
    r = random.Random(3)
    texts = [(i, "".join(r.choice("abc ") for _ in range(r.randint(0, 60)))) for i in range(80)] + [(100, None), (101, ""), (101, "abc")]
    terms = ["".join(r.choice("abc ") for _ in range(r.randint(1, 4))) for _ in range(50)] + ["", "abc", "abc", None, "zz"]
    rows = spark.createDataFrame(texts, "id int, text string").withColumn("terms", F.lit("x"))
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    want = sorted((i, t) for i, x in texts if x is not None for t in {t for t in terms if t is not None} if t in x)
    for most in (4_000_000, 20):
        monkeypatch.setattr(patterns, "AUTOMATON_CHARS", most)
        assert sorted((x.id, x._term) for x in patterns.matched_terms(rows, "text", table, "term").collect()) == want
    assert patterns.matched_terms(rows, "text", table.limit(0), "term").count() == 0


def test_short_terms_take_no_nested_loop(spark):
    rows = spark.createDataFrame([(i, f"Word{i} and more words of the text {i}") for i in range(200)], "id int, content string")
    terms = spark.createDataFrame([(i, f"word{i}") for i in range(10_000)], "ord int, keyword string")
    found = retrieval.containing(rows, "content", terms, "keyword")
    assert sorted((r.id, r.ord) for r in found.collect()) == sorted((i, j) for i in range(200) for j in range(200) if f"word{j} " in f"word{i} " or (str(i).startswith(str(j))))
    assert "NestedLoop" not in plan(found)


# ---- retrieval


def some_corpus(seed, n):
    r = random.Random(seed)
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        v = rng.normal(size=8)
        v = v if r.random() < 0.7 else np.round(rng.normal(size=2)[0]) * np.ones(8)
        chapter = r.choice([None, "Light", "Light and Shadow", "Acids & Bases", "Heat", "the eye", ""])
        rows.append((i, chapter, r.choice(["Science", "social science", "Maths", None]), r.choice(["9", "10", None]), None if r.random() < 0.05 else " ".join(r.choice(words) for _ in range(12)).title(), None if r.random() < 0.1 else [float(x) for x in v]))
    return rows


def some_requests(seed, n):
    r = random.Random(seed)
    rng = np.random.default_rng(seed + 100)
    chapters = ["light", "acids and bases", "Eye", "shadow light", "unknown", "Heat", "x"]
    return [(i, r.choice(["science", "Maths", "SOCIAL", "none", "sci"]), r.choice(["9", "10", "11"]), None if r.random() < 0.1 else r.sample(chapters, r.randint(0, 3)), [", ".join(f"w{r.randint(0, 45)}" for _ in range(r.randint(1, 3))) for _ in range(r.randint(0, 4))], None if r.random() < 0.1 else [float(x) for x in rng.normal(size=8)]) for i in range(n)]


def like(name, request):
    long = [w for w in normal_case(request).split(" ") if len(w) > 2][:3]
    return re.search(".*".join(map(re.escape, [w.lower() for w in long])), name.lower()) is not None


def normal_case(name):
    return re.sub(r"\s+", " ", re.sub(r"\s+", " ", name.strip()).replace(" & ", " and ").replace("&", " and ")).strip()


def resolve_one(corpus, subject, grade, chapters):
    stored = {(c, s) for _, c, s, g, _, _ in corpus if c is not None and g == grade}
    bulk = {c for c, s in stored if s is not None and subject.lower() in s.lower()}
    cand = bulk | ({c for c, _ in stored if any(like(c, q) for q in chapters)} if len(bulk) < 3 else set())
    out = []
    for q in chapters:
        hits = sorted((t, normal(c)) for c in cand if c and (t := tier_of(q, c)))
        if hits:
            out.append(max(c for c in cand if c and normal(c) == hits[0][1]))
    return sorted(set(out)) or chapters


def retrieve_one(corpus, subject, grade, chapters, topics, q, k=8, n=6, most=10, threshold=0.65, relaxed=0.3):
    names_ = resolve_one(corpus, subject, grade, chapters or [])
    own = [x for x in corpus if x[3] == grade and x[2] is not None and subject.lower() in x[2].lower()]
    within = lambda x: not names_ or x[1] in names_
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6) if any(a) else None
    sims = [(-s, x[0]) for x in own if q and within(x) and x[5] and (s := cos(x[5], q)) is not None and s > relaxed]
    if any(-s > threshold for s, _ in sims):
        sims = [x for x in sims if -x[0] > threshold]
    near = sorted(sims)[:k]
    words = [p.strip() for t in topics for p in t.split(",") if len(p.strip()) >= 3] + names_
    found = []
    for w in words[:6]:
        if len(w) < 2:
            continue
        hits = [x for x in own if x[4] is not None and w.lower() in x[4].lower()]
        for x in sorted([h for h in hits if within(h)] or hits, key=lambda x: x[0])[:n]:
            if x[0] not in found:
                found.append(x[0])
    score = {}
    for r, (_, i) in enumerate(near):
        score[i] = [score.get(i, [0])[0] + 1 / (61 + r), r, 99]
    for r, i in enumerate(found[:n]):
        old = score.get(i, [0, 99, 99])
        score[i] = [old[0] + 1 / (61 + r), old[1], r]
    return sorted(score, key=lambda i: (-round(score[i][0], 9), score[i][1], score[i][2]))[:most]


SCHEMA = "id long, chapter string, subject string, grade string, content string, embedding array<double>"
ASKED = "req int, subject string, grade string, chapters array<string>, topics array<string>, vector array<double>"


@pytest.mark.parametrize("block,texts", [(1000, 512), (7, 3)])
def test_many_requests_as_one_by_one(spark, monkeypatch, block, texts):
    monkeypatch.setattr(many, "REQUESTS", block)
    monkeypatch.setattr(many, "TEXTS", texts)
    corpus, asked = some_corpus(1, 250), some_requests(2, 40)
    with Workspace(spark) as work:
        got = many.retrieve_contexts(spark.createDataFrame(corpus, SCHEMA).repartition(3), spark.createDataFrame(asked, ASKED).withColumn("n", F.lit("x")), work)
        found = {}
        for r in got.orderBy("req", "pos").collect():
            found.setdefault(r.req, []).append(r.id)
    assert found == {r[0]: w for r in asked if (w := retrieve_one(corpus, *r[1:]))}
    assert found  # not all empty


def test_texts_are_read_once_for_all_requests(spark, tmp_path):
    spark.createDataFrame(some_corpus(1, 100), SCHEMA).write.parquet(f"{tmp_path}/corpus")
    reads = []

    class Counted(Workspace):
        def keep(self, rows):
            reads.append(len(re.findall(r"FileScan parquet \[[^\]]*content", plan(rows))))
            return super().keep(rows)

    with Counted(spark) as work:
        got = many.retrieve_contexts(spark.read.parquet(f"{tmp_path}/corpus"), spark.createDataFrame(some_requests(2, 30), ASKED), work)
        assert sum(reads) == 1 and "content" not in plan(got) and "NestedLoop" not in plan(got) and got.count() > 0


def test_no_requests_and_no_texts(spark):
    corpus, asked = spark.createDataFrame(some_corpus(1, 20), SCHEMA), spark.createDataFrame(some_requests(2, 3), ASKED)
    with Workspace(spark) as work:
        assert many.retrieve_contexts(corpus, asked.limit(0), work).count() == many.retrieve_contexts(corpus.limit(0), asked, work).count() == 0


# ---- generation in rounds


def batch_of(prompt, second=False):
    topic, batch = int(re.search(r"topic (\d+)", prompt)[1]), re.search(r"batch (\d+) of (\d+)", prompt)
    b, size = int(batch[1]) if batch else 1, int(re.search(r"Write (\d+)", prompt)[1])
    if not second and topic % 10 == 3:
        raise ValueError("out of order")
    if not second and topic % 10 == 4:
        return "sorry, no questions"
    n = (topic + b) % 4 if second else {0: 0, 1: 2, 2: size}.get(topic % 3, size)
    one = lambda i: {"text": f"What is {i} of {b} of topic {topic}, {'b' if second else 'a'}?", "format": "mcq", "options": ["A) 1", "B) 2", "C) 3", "D) 4"], "correct_answer": "A) 1", "explanation": "because it is the first one in the list", "marks": 1}
    return json.dumps({"questions": [one(i) for i in range(n)]})


def second_of(prompt):
    return batch_of(prompt, True)


def one_by_one(req, requested, wanted):
    out, sizes = [], [min(12, wanted - 12 * b) for b in range(-(-wanted // 12))]
    for b, size in enumerate(sizes, 1):
        prompt = f"Write {size} mcq questions on topic {req}. This is batch {b} of {len(sizes)}:"
        for m, generate in enumerate((batch_of, second_of)):
            try:
                found = json.loads(generate(prompt))["questions"]
            except Exception:
                found = []
            if found:
                out += [(b, m, q["text"]) for q in found]
                break
        if len(out) >= requested + 5:
            break
    return out


def test_rounds_as_a_loop_over_requests(spark):
    sections = [(i, s, 3 + (i * 5 + s) % 12, "easy") for i in range(40) for s in range(i % 5)]
    parts = spark.createDataFrame(sections, "req int, sec int, quantity int, difficulty string")
    asked = spark.range(40).select(F.col("id").cast("int").alias("req"), F.concat(F.lit("topic "), F.col("id").cast("string")).alias("subject"), F.lit("easy").alias("difficulty"), F.lit("mcq").alias("form")).join(generation.targets(parts), "req")
    with Workspace(spark) as work:
        made = generation.in_rounds(asked, asked.select("req", F.lit("text").alias("context")), [batch_of, second_of], work).collect()
        empty = generation.in_rounds(asked.limit(0), asked.select("req", F.lit("text").alias("context")), [batch_of], work)
        assert empty.count() == 0
    want = []
    for i in range(40):
        requested = sum(min(q, 10) for r, _, q, _ in sections if r == i)
        if requested:
            want += [(i, *x) for x in one_by_one(i, requested, min(math.ceil(requested * 1.3), requested + 15))]
    assert sorted((r.req, r.batch, r.source, r.text) for r in made) == sorted(want)
    assert {r.batch for r in made} >= {1, 2, 3} and {r.source for r in made} == {0, 1}


def judge(prompt):
    return json.dumps({"validations": [{"index": 1, "valid": False, "fixed_correct_answer": "B) 2", "notes": "no"}]})


def test_a_test_from_the_corpus(spark):
    corpus = [(i, "Light", "Science", "9", f"light goes straight on, part {i}", None) for i in range(3)]
    asked = [(1, "t", "x", "topic 2 science", "9", ["light"], ["straight"], 0), (2, "t", "x", "Science", "9", ["light"], ["straight"], 3), (3, "t", "x", "History", "9", [], ["war of"], 0)]
    rows = spark.createDataFrame(asked, "req int, title string, owner string, subject string, grade string, chapters array<string>, topics array<string>, iteration int").withColumns({"difficulty": F.lit("easy"), "form": F.lit("mcq"), "n": F.lit(6)})
    texts = spark.createDataFrame(corpus, SCHEMA).withColumn("subject", F.lit("topic 2 science"))
    with Workspace(spark) as work:
        outcomes, tests, questions = assembly.build_test(rows, None, [batch_of, second_of], [judge], corpus=texts, work=work)
        assert dict(map(tuple, outcomes.collect())) == {1: "preview", 2: "limit_reached", 3: "no_content"}
        assert [r.total_questions for r in tests.collect()] == [questions.count()]
        first = questions.where("position = 0").first()
        assert (first.correct_answer, first.validation_notes) == ("B) 2", "no") and questions.count() <= 6


def test_texts_are_matched_in_blocks_by_keywords():
    """A block of texts by keywords is bounded, whatever the number of keywords; the hits are the same."""
    import pyarrow as pa

    rows = [("1", "s", [], [f"w{i} {o}" for o in range(6)], None) for i in range(1_000)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(600)), "grade": ["1"] * 600, "subject": ["s"] * 600, "chapter": ["c"] * 600, "content": [f"w{i} {i % 6}" for i in range(600)], "embedding": pa.nulls(600, pa.list_(pa.float64()))})
    block, sizes = many.Block(rows, 8, 6, 0.3), []
    add = block.add_texts
    block.add_texts = lambda ids, *other: (sizes.append(len(ids)), add(ids, *other))
    block.add(batch)
    assert max(sizes) * 6 * len(rows) <= 1_000_000 and sum(sizes) == 600
    assert sorted(zip(block.hits()["n"].to_pylist(), block.hits()["id"].to_pylist())) == sorted((i, i) for i in range(600) for _ in range(2))
