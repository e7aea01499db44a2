"""Readers and writers: corpora from tables, pages and binary files, appends with rejects, and replacement after success."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, fields, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "chunks": "id int, class_grade string, subject string, chapter string, content string, embedding array<float>, created_at timestamp",
    "tests": "id string, teacher_id string, exam_title string, board string, class_grade string, subject string, iteration int, status string, request_payload string, total_questions int, total_marks int, created_at timestamp, updated_at timestamp",
    "questions": "id string, test_id string, text string, options array<string>, correct_answer string, explanation string, marks int, difficulty string, bloom_level string, chapter string, topic string, format string, validation_status string, validation_notes string, position int, created_at timestamp",
    "training_data": "id string, test_id string, teacher_id string, question_id string, question_text string, correct_answer string, teacher_feedback string, action string, created_at timestamp",
    "quizzes": "id string, test_id string, teacher_id string, duration_minutes int, max_marks int, passing_marks int, shuffle_questions boolean, shuffle_options boolean, camera_required boolean, tab_switch_limit int, status string, created_at timestamp",
    "subscriptions": "id string, user_id string, plan_type string, valid_till timestamp, features_allowed struct<tests_per_day:int,max_questions:int,bloom_taxonomy:boolean,file_upload:boolean,quiz_sharing:boolean,blueprint_mode:boolean>, created_at timestamp, updated_at timestamp",
}
DEFAULTS = {
    "tests": {"board": "CBSE", "iteration": 0, "status": "draft"},
    "questions": {"marks": 1, "validation_status": "verified"},
    "quizzes": {"duration_minutes": 60, "shuffle_questions": True, "shuffle_options": True, "camera_required": False, "tab_switch_limit": 3, "status": "active"},
    "subscriptions": {"plan_type": "free"},
}


@dataclass(frozen=True)
class Settings:
    """Options of the library with their defaults; from_conf reads corpus.<name> from the session, from_env CORPUS_<NAME>."""

    chunk_words: int = 500
    overlap_words: int = 75
    least_words: int = 50
    dimension: int = 384
    embedding_batch: int = 32
    per_query: int = 8
    most_chunks: int = 15
    dedup_threshold: float = 0.82
    similarity_threshold: float = 0.65
    relaxed_threshold: float = 0.3
    least_question: int = 3
    most_question: int = 500
    most_questions: int = 50
    most_iterations: int = 3
    cache_entries: int = 500
    cache_seconds: int = 1800
    limit_enabled: bool = True
    limit_requests: int = 100
    limit_seconds: int = 900
    concurrent_requests: int = 10
    attempts: int = 4
    batch_size: int = 12
    overshoot: float = 1.30
    port: int = 5432
    connect_seconds: int = 10
    query_seconds: int = 5
    request_seconds: int = 30
    model: str = ""
    fallback_model: str = ""
    embedding_model: str = ""
    temperature: float = 0.2
    top_p: float = 0.95
    top_k: int = 40
    most_output_tokens: int = 1024
    retries: int = 3
    retry_seconds: float = 1.0
    response_entries: int = 100
    response_seconds: int = 300
    most_response_bytes: int = 1_048_576
    log_level: str = "INFO"
    log_requests: bool = True
    environment: str = "production"

    @classmethod
    def of(cls, found: dict[str, str | None]) -> Settings:
        """From texts by name; an empty text is none."""
        def as_kind(kind: type, v: str):
            return v.strip().lower() in ("true", "1", "yes") if kind is bool else kind(v)

        return cls(**{k: as_kind(type(getattr(cls, k)), v) for k, v in found.items() if v not in (None, "")})

    @classmethod
    def from_conf(cls, spark: SparkSession) -> Settings:
        return cls.of({f.name: spark.conf.get(f"corpus.{f.name}", None) for f in fields(cls)})

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """Environments are production, staging (preview, staging, test) or development."""
        own = cls.of({f.name: env.get(f"CORPUS_{f.name.upper()}") for f in fields(cls)})
        kind = {"production": "production", "prod": "production", "preview": "staging", "staging": "staging", "test": "staging"}
        return replace(own, environment=kind.get(own.environment, "development"))

    def issues(self) -> list[str]:
        """What makes the settings unusable."""
        out = []
        if self.overlap_words >= self.chunk_words:
            out.append("overlap_words must be smaller than chunk_words")
        if self.least_words > self.chunk_words:
            out.append("least_words must not exceed chunk_words")
        if self.least_question > self.most_question:
            out.append("least_question must not exceed most_question")
        if not 1 <= self.port <= 65_535:
            out.append("port must lie between 1 and 65535")
        out += [f"{f} must lie between 0 and 1" for f in ("dedup_threshold", "similarity_threshold", "relaxed_threshold", "top_p") if not 0 <= getattr(self, f) <= 1]
        positive = ("chunk_words", "dimension", "embedding_batch", "per_query", "cache_entries", "cache_seconds", "limit_requests", "limit_seconds", "attempts", "batch_size", "connect_seconds", "query_seconds", "request_seconds", "most_output_tokens", "top_k", "response_entries", "response_seconds", "most_response_bytes")
        return out + [f"{f} must be positive" for f in positive if getattr(self, f) <= 0]

    def warnings(self) -> list[str]:
        """What is allowed but rarely meant."""
        out = []
        if self.per_query > 10:
            out.append("per_query above 10 slows answers down")
        if self.concurrent_requests > 20:
            out.append("concurrent_requests above 20 may exceed what a small deployment allows")
        if self.relaxed_threshold > self.similarity_threshold:
            out.append("relaxed_threshold is stricter than similarity_threshold")
        if self.environment == "production" and not self.limit_enabled:
            out.append("requests have no limit in production")
        return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table documents as a corpus: id, chapter, subject, grade, content."""
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("chapter"), F.col("lang").alias("subject"), (F.col("doc_id") % 3).cast("string").alias("grade"), F.col("text").alias("content"))


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A table over JDBC, read in `parts` ranges of a key at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return reader.options(**options).load()


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """chapter (the file's stem), path and content of binary files."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("chapter"), "path", "content")


def decoded(files: DataFrame, decode: Callable[[bytes], list[str]]) -> DataFrame:
    """files with text: decode gives a file's pages, joined by blank lines. A file that fails has an empty text."""
    names = [c for c in files.columns if c != "content"]

    def one(data: bytes) -> str:
        try:
            return "\n\n".join(decode(data))
        except Exception:  # whatever a broken file makes a decoder raise
            return ""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array([one(x.as_py()) for x in batch["content"]], pa.string())], [*names, "text"])

    return files.mapInArrow(of, T.StructType([*(files.schema[c] for c in names), T.StructField("text", T.StringType())]))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def alive(rows: DataFrame) -> bool:
    return len(rows.limit(1).take(1)) == 1


def with_defaults(rows: DataFrame, table: str) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in DEFAULTS.get(table, {}).items()})


class Workspace:
    """Tables that a job of several steps writes and reads again, in a folder of their own in spark.checkpoint.dir.

    A step that is written is computed once, whatever is lost or read later. Tables go by drop() when nothing reads them any
    more, and all of them with close() or at the end of a with block.
    """

    def __init__(self, spark: SparkSession, name: str = "work"):
        folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = folder or tempfile.mkdtemp("-work")  # one machine runs everything, as in tests
        self.spark, self.path, self.written = spark, f"{folder}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, rows: DataFrame) -> DataFrame:
        """rows, written and read again; the table can be dropped by what comes back."""
        path = f"{self.path}/{self.written}"
        self.written += 1
        rows.write.parquet(path)
        out = self.spark.read.schema(rows.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._workspace_path)

    def close(self) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def once(rows: DataFrame) -> DataFrame:
    """rows computed once and written to a folder of their own in spark.checkpoint.dir, see Workspace: computed again, a model
    may give other answers."""
    return Workspace(rows.sparkSession, "once").keep(rows)


#: The column by which tables that are written in batches are parted.
BATCH = "batch"


def put_batch(rows: DataFrame, path: str, batch: str) -> None:
    """rows become the batch of that name of the table at path; other batches stay, and a batch put twice is there once."""
    if not re.match(r"[A-Za-z][\w-]*\Z", batch):
        raise ValueError("the name of a batch must begin with a letter and go on with letters, digits, _ and -")
    rows.withColumn(BATCH, F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def append(rows: DataFrame, valid: Column, path: str, rejects: str, batch: str | None = None) -> DataFrame:
    """Valid rows are appended to path, others to rejects; ok and failed counts come back. The rows are computed once, and
    rejects are written first, so what is in path has been told apart in full.

    With the name of a batch the write can be repeated: each table takes the rows as that batch in one step, in place of
    what an earlier try has left of it.
    """
    flag = free_name(rows, "valid")
    told = once(rows.withColumn(flag, F.coalesce(valid, F.lit(False))))
    for part, where in ((told.where(~F.col(flag)).drop(flag), rejects), (told.where(flag).drop(flag), path)):
        if batch is None:
            part.write.mode("append").parquet(where)
        else:
            put_batch(part, where, batch)
    return told.agg(F.count_if(flag).alias("ok"), F.count_if(~F.col(flag)).alias("failed"))


def rewritten(spark: SparkSession, path: str, where: Column, change: Callable[[DataFrame], DataFrame]) -> int:
    """The batches of the table at path that hold rows which meet `where` become change(batch); their number comes back.

    The new rows are written beside the table first. Batches change one by one, so a run that ends in between is
    mended by another: batches that are done hold no such rows any more, or change to the same.
    """
    table = spark.read.parquet(path)
    names = [r[BATCH] for r in table.where(where).select(BATCH).distinct().collect()]  # names of batches
    if names:
        with Workspace(spark, "rewrite") as work:
            new = work.keep(change(table.where(F.col(BATCH).isin(names))))
            left = {r[BATCH] for r in new.select(BATCH).distinct().collect()}
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)
            for gone in set(names) - left:
                work._delete(f"{path}/{BATCH}={gone}")
    return len(names)


def delete_rows(spark: SparkSession, path: str, where: Column) -> int:
    """Rows of the batches at path that meet `where` go, whatever else a batch holds; where it is null they stay."""
    met = F.coalesce(where, F.lit(False))
    return rewritten(spark, path, met, lambda rows: rows.where(~met))


def update_rows(spark: SparkSession, path: str, where: Column, column: str, value) -> int:
    """column becomes value in the rows at path that meet `where`."""
    met = F.coalesce(where, F.lit(False)) & ~F.col(column).eqNullSafe(F.lit(value))
    return rewritten(spark, path, met, lambda rows: rows.withColumn(column, F.when(met, F.lit(value)).otherwise(F.col(column))))


def laid_out(rows: DataFrame, key: str, name: str, path: str, buckets: int) -> DataFrame:
    """rows as the table `name` at path, in buckets by key and sorted in each: joins and groups by that key with tables of
    as many buckets read it as it lies, without an exchange."""
    rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


def violations(rows: DataFrame, unique: str, foreign: str | None = None, parents: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """kind, value and n: values of `unique` in several rows or in none (duplicate, missing), and of `foreign` without a parent (orphan).

    Counts are added up in each task first, so a value in very many rows is one row a task; a null foreign key is none.
    """
    own = rows.groupBy(F.col(unique).cast("string").alias("value")).agg(F.count("*").alias("n"))
    bad = own.where("value is null or n > 1").select(F.when(F.col("value").isNull(), "missing").otherwise("duplicate").alias("kind"), "value", "n")
    if foreign is None:
        return bad
    asked = rows.where(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias("_f")).agg(F.count("*").alias("n"))
    lost = asked.join(parents.select(F.col(key).alias("_f")), "_f", "left_anti")
    return bad.unionByName(lost.select(F.lit("orphan").alias("kind"), F.col("_f").cast("string").alias("value"), "n"))


def free_name(rows: DataFrame, name: str) -> str:
    """name, with as many lines under it as make it one that rows don't have."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def replaced(spark: SparkSession, rows: DataFrame, name: str) -> None:
    """The table `name` becomes rows, which may come from it: they are written beside it first, and names change at the end."""
    rows.write.mode("overwrite").saveAsTable(f"{name}__next")
    spark.sql(f"DROP TABLE IF EXISTS {name}__last")
    if table_exists(spark, name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}__last")
    spark.sql(f"ALTER TABLE {name}__next RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {name}__last")


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object a row, with names in camel case; null lists are empty ones."""
    lists = {f.name for f in rows.schema.fields if f.dataType.typeName() == "array"}
    cols = [(F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)) if c in lists else F.col(c)).alias(camel(c)) for c in rows.columns]
    return rows.select(F.to_json(F.struct(*cols)).alias("json"))
