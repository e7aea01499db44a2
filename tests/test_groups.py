"""Chunks, elimination in groups, embeddings, repeated writes and laid-out tables against plain versions."""

import random
import sys
import time

import numpy as np
import pytest
from corpusloom.functions.text import repaired_json
from corpusloom.operators import chunking, dedup, store
from corpusloom.providers import embedded
from corpusloom.sources import tables
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def chunked(text, size, overlap, least):
    out, now = [], []
    for paragraph in [p.split() for p in __import__("re").split(r"\n\s*\n", text)]:
        if now and len(now) + len(paragraph) > size:
            if len(now) >= least:
                out.append(now)
            now = now[-overlap:] if len(now) > overlap else []
        now = now + paragraph
        while len(now) > size:
            out.append(now[:size])
            now = now[size - overlap :]
    return [" ".join(c) for c in (out + [now] if len(now) >= least else out)]


def test_chunks_as_by_hand(spark):
    r = random.Random(1)
    texts = ["\n\n".join(" ".join(f"w{r.randint(0, 99)}" for _ in range(r.choice([0, 1, 3, 9, 10, 11, 40]))) for _ in range(r.randint(1, 12))) for _ in range(150)] + ["", " \n\n ", "a"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "id int, text string")
    got = {}
    for x in chunking.chunk_rows(rows, 10, 3, 2).orderBy("id", "k").collect():
        got.setdefault(x.id, []).append(x.chunk)
    assert got == {i: c for i, t in enumerate(texts) if (c := chunked(t, 10, 3, 2))}


def test_a_long_text_takes_linear_time(spark):
    text = lambda n: "\n\n".join(["one two three four five six seven"] * n)
    took = []
    for n in (10_000, 80_000):
        rows = spark.createDataFrame([(1, text(n))], "id int, text string")
        chunking.chunk_rows(rows).count()
        began = time.time()
        assert chunking.chunk_rows(rows).count() == len(chunking.spans_of([7] * n, 500, 75, 50))
        took.append(time.time() - began)
    assert took[1] < 24 * max(took[0], 0.2)


def eliminated(items, threshold):
    """The loop over one group's (idx, score, vector)."""
    gone, items = set(), sorted(items)
    unit = {i: np.array(v) / np.linalg.norm(v) if v is not None and any(v) else None for i, _, v in items}
    for at, (i, si, _) in enumerate(items):
        for j, sj, _ in items[at + 1 :]:
            if i in gone:
                break
            if j in gone or unit[i] is None or unit[j] is None or round(float(unit[i] @ unit[j]), 6) < threshold:
                continue
            gone.add(i if sj > si else j)
    return {i for i, _, _ in items} - gone


@pytest.mark.parametrize("tile", [1024, 5])
def test_elimination_as_the_loop(spark, monkeypatch, tile):
    monkeypatch.setattr(dedup, "TILE", tile)
    rng, rows = np.random.default_rng(3), []
    for g in range(12):
        middle = rng.normal(size=(3, 6))
        for i in range(int(rng.integers(1, 40))):
            v = middle[rng.integers(3)] + 0.5 * rng.normal(size=6)
            rows.append((f"g{g}", i, float(rng.integers(4)), [float(x) for x in v]))
    rows += [("odd", 0, 1.0, None), ("odd", 1, 1.0, [0.0] * 6), ("odd", 2, 1.0, [1.0] * 6), ("odd", 3, 2.0, [1.0] * 6), ("odd", 4, 1.0, [2.0] * 6)]
    items = spark.createDataFrame(rows, "grp string, idx long, score double, embedding array<double>").repartition(5).withColumn("i", F.lit("x"))
    want = {(g, i) for g in {r[0] for r in rows} for i in eliminated([r[1:] for r in rows if r[0] == g], 0.8)}
    assert {tuple(r) for r in dedup.greedy_dedup(items, 0.8).collect()} == want
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    pairs = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[3] and b[3] and any(a[3]) and any(b[3]) and round(float(unit(a[3]) @ unit(b[3])), 6) >= 0.8}
    assert {tuple(r)[:3] for r in dedup.similar_pairs(items, 0.8).collect()} == pairs


def test_a_large_group_is_dealt_into_tiles(spark):
    n = 12_000
    vector = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(1000)) / 500 - 1)
    items = spark.range(n).select(F.lit(1).alias("grp"), F.col("id").alias("idx"), F.lit(1.0).alias("score"), vector.alias("embedding"))
    same = items.unionByName(items.where("idx < 50").withColumn("idx", F.col("idx") + n))  # copies go
    kept = dedup.greedy_dedup(same, 0.9999)
    assert kept.where(F.col("idx") >= n).count() == 0 and kept.count() == n


def test_models_load_once_and_texts_are_encoded_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def load():
        import os

        with open(log, "a") as f:
            f.write(f"load {os.getpid()}\n")

        def encode(texts):
            with open(log, "a") as f:
                f.writelines(f"text {t}\n" for t in texts)
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    rows = spark.createDataFrame([(i, f"t{i % 7}") for i in range(200)] + [(900, None), (901, "")], "id int, text string").repartition(6)
    got = {r.id: r.embedding for r in embedded(rows, "text", load=load).collect()}
    assert len(got) == 202 and got[3] == [2.0, 1.0] and got[900] == got[901] == [0.0, 1.0]
    lines = open(log).read().splitlines()
    loads = [x for x in lines if x.startswith("load")]
    assert len(loads) == len(set(loads)) and sorted(x for x in lines if x.startswith("text")) == sorted(["text ", *(f"text t{i}" for i in range(7))])
    assert embedded(rows, "text", lambda texts: 1 / 0).where("embedding is null").count() == 202


def test_a_batch_put_again_is_there_once(spark, tmp_path, monkeypatch):
    path, rejects = f"{tmp_path}/t", f"{tmp_path}/r"
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, v string")
    put = tables.put_batch

    def dies(part, where, batch):
        put(part, where, batch)
        raise KeyboardInterrupt

    monkeypatch.setattr(tables, "put_batch", dies)
    with pytest.raises(KeyboardInterrupt):  # between the two writes
        tables.append(rows, F.col("id") > 0, path, rejects, "one")
    monkeypatch.setattr(tables, "put_batch", put)
    for _ in range(2):
        assert tuple(tables.append(rows, F.col("id") > 0, path, rejects, "one").first()) == (2, 1)
    tables.append(rows, F.col("id") > 1, path, rejects, "two")
    table = lambda at: sorted(map(tuple, spark.read.parquet(at).collect()), key=str)
    assert table(path) == [(1, "a", "one"), (2, "b", "one"), (2, "b", "two")] and len(table(rejects)) == 3
    for _ in range(2):
        tables.update_rows(spark, path, F.col("id") == 1, "v", "z")
        tables.delete_rows(spark, path, F.col("batch") == "two")
    assert table(path) == [(1, "z", "one"), (2, "b", "one")]
    assert tables.delete_rows(spark, path, F.lit(None).cast("boolean")) == 0
    with pytest.raises(ValueError):
        tables.put_batch(rows, path, "1")


def test_laid_out_tables_join_without_an_exchange(spark, tmp_path):
    parents = tables.laid_out(spark.range(100).withColumn("x", F.lit(1)), "id", "lie_parents", f"{tmp_path}/p", 4)
    children = tables.laid_out(spark.range(300).select((F.col("id") % 120).alias("parent"), F.col("id").alias("n")), "parent", "lie_children", f"{tmp_path}/c", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = store.with_children(parents, children, "id", "parent", "n")
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.count() == 100 and out.where("id = 7").first().children == [7, 127, 247]


def test_violations(spark):
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, None), (None, 5), (None, 7)], "id int, f int")
    parents = spark.createDataFrame([(5,)], "k int")
    assert {tuple(r) for r in tables.violations(rows, "id", "f", parents, "k").collect()} == {("duplicate", "1", 2), ("missing", None, 2), ("orphan", "6", 1), ("orphan", "7", 1)}
    assert tables.violations(rows.limit(0), "id").count() == 0


def test_answers_with_fences_and_loose_braces(spark):
    forms = [
        ('Fill {this}: ```json {"a":1}```', '{"a":1}'), ('{"a":1}\n``` see {x}', '{"a":1}'), ("```json\n{\"a\": [1,]}\n``` {no}", '{"a": [1]}'), ('{"a": "} {"} {"b": 2}', '{"a": "} {"}'), ("{x} {y}", None), (None, None), ("", None),
        ('say {"a": "\\alpha"}', '{"a": "\\\\alpha"}'), ("``` no object ``` then {\"a\": 2}", '{"a": 2}'), ('{"a": {"b": 1}}', '{"a": {"b": 1}}'), ('﻿{"a":1}', '{"a":1}'), ('{{"a": 1}', None),
    ]
    rows = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(forms)], "i int, f string")
    got = {r.i: r.j for r in rows.select("i", repaired_json(F.col("f")).alias("j")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(forms)}


def test_long_and_odd_strings_in_answers(spark):
    """Strings of any length are read, and answers mended as by the plain patterns."""
    import random
    import re

    from corpusloom.functions.text import json_objects, mended_json

    long = '{"a": "' + 'x\\"' * 40_000 + '", "b": [1,],}'
    assert spark.createDataFrame([(long,)], "f string").select(repaired_json(F.col("f"))).first()[0] == long.replace(",]", "]").replace(",}", "}")

    def objects(text):
        parts = re.findall(r'"(?:[^"\\]|\\[\s\S])*"|[{}]|[^"{}]+|"', text[text.find("{") :]) if "{" in text else []
        depth, out, begin = 0, [], 0
        for i, p in enumerate(parts):
            begin = i if p == "{" and not depth else begin
            out += ["".join(parts[begin : i + 1])] if p == "}" and depth == 1 else []
            depth += 1 if p == "{" else -1 if p == "}" and depth else 0
        return out

    def mended(text):
        double = lambda p: re.sub(r'(?<!\\)((?:\\\\)*)\\(?![\\"/bfnrtu])', r"\1\\\\", p)
        return "".join(double(p) if p[0] == '"' else re.sub(r",(\s*[\]}])", r"\1", p) for p in re.findall(r'"(?:[^"\\]|\\[\s\S])*"|[^"]+|"', text))

    rnd = random.Random(3)
    texts = ["".join(rnd.choice('{}[]",, \\nax\n') for _ in range(rnd.randrange(30))) for _ in range(3_000)]
    rows = spark.createDataFrame([(t,) for t in texts], "f string").select("f", json_objects(F.col("f")).alias("o"), mended_json(F.col("f")).alias("m")).collect()
    assert [(r.f, r.o, r.m) for r in rows] == [(t, objects(t), mended(t)) for t in texts]


def test_few_large_batches_come_of_many_groups(spark):
    from corpusloom.operators import dedup

    rows = spark.range(4_000).select((F.col("id") / 4).cast("int").alias("grp"), (F.col("id") % 4).alias("idx"), F.lit(1.0).alias("score"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    sizes = dedup.scored_pairs(rows, 0.8).mapInArrow(lambda batches: (b.select(["i"]) for b in batches), "i long")
    assert sizes.count() == 6_000 and dedup.greedy_dedup(rows).count() == 1_000
    import pyarrow as pa

    small = [pa.RecordBatch.from_pydict({"x": [i]}) for i in range(25_000)]
    assert [b.num_rows for b in dedup.gathered(iter(small))] == [10_000, 10_000, 5_000]


def test_feedback_is_dealt_to_tasks_by_its_rows(spark, monkeypatch):
    from corpusloom.operators import store

    monkeypatch.setattr(store, "TASK_ROWS", 100, raising=False)
    asked = spark.range(600).select(F.col("id").alias("test_id"), F.lit("o").alias("owner"), (F.col("id") % 5).alias("iteration"))
    action = F.when(F.col("id") % 3 == 0, "reject").when(F.col("id") % 3 == 1, "edit").otherwise("approve")
    told = spark.range(1_200).select((F.col("id") % 400).alias("test_id"), F.col("id").alias("question_id"), action.alias("action"), F.lit(None).cast("string").alias("comment"))
    training, ids, again = store.apply_feedback(asked, told)
    assert again.rdd.getNumPartitions() == training.rdd.getNumPartitions() == 12
    rows = [(i % 400, i) for i in range(1_200) if i % 400 % 5 < 3]
    assert sorted((r.test_id, r.question_id, r.teacher_feedback) for r in training.collect()) == sorted((t, q, "") for t, q in rows if q % 3 < 2)
    assert {r.test_id: r.rejected for r in ids.collect()} == {t: [q for u, q in rows if u == t and q % 3 == 0] for t, q in rows if q % 3 == 0}
    assert sorted((r.test_id, r.iteration, r.previous_test_id) for r in again.collect()) == sorted({(t, t % 5 + 1, t) for t, _ in rows})
    assert all(t.count() == 0 for t in store.apply_feedback(asked, told.limit(0)))
