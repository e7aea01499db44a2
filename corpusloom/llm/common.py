"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Has Spark delete the shuffle files of a query once it has ended; what a checkpoint has written no longer needs them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SWITCH = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session in spark.checkpoint.dir, which survives the loss of executors.

    It is the one that the session names; only where none is named and one machine runs everything (tests) a local one is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp("-checkpoint"))
    return context.getCheckpointDir()


def freeing(df: DataFrame) -> DataFrame:
    """df as a query whose shuffle files go once it has ended. Spark reads that switch as a query is made, so it is on for
    that moment and not while the job runs."""
    spark = df.sparkSession
    with SWITCH:
        before = spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
        try:
            return df.select("*")
        finally:
            spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written to the shared folder. The shuffle files behind df go at once, so a job of several cuts
    needs the disk of its largest part only."""
    shared_folder(df.sparkSession)
    return freeing(df).checkpoint()


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as a table of its own in the shared folder, and its path; reading it again reads the columns used."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    freeing(df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes what stored() has written and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def named(column: str) -> Column:
    """A column by its exact name, whatever dots and quotes are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def beside(docs: DataFrame, *names: str) -> Column:
    """The columns of docs other than these in one struct, row, so that none can clash with a column that an operator makes."""
    others = [named(c) for c in docs.columns if c not in names]
    return (F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))).alias("row")


def restored(docs: DataFrame, **own: Column) -> list[Column]:
    """The columns of docs in their order: those named in own as given, the others out of row."""
    return [own[c].alias(c) if c in own else F.col("row").getField(c).alias(c) for c in docs.columns]


def even_join(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows joined with facts, which has one row for each key.

    A second key keeps Spark from reusing the layout of the aggregation behind facts, so both sides are plain shuffles
    and adaptive execution can split the partition of a key that very many rows carry. The hint keeps small facts from
    being broadcast: rounds of joins would leave a table of each on the driver.
    """
    second = F.xxhash64(F.lit("even"), key)
    return rows.withColumn("_second", second).join(facts.withColumn("_second", second).hint("merge"), [key, "_second"]).drop("_second")


#: Rows of a partition in steps over few rows: these run on few partitions, as each task costs the driver memory.
EDGES = 50_000


def parts_of(rows: int, each: int = EDGES) -> int:
    """Partitions for so many rows, `each` of them a partition."""
    return max(1, -(-rows // each))


def gathered(df: DataFrame, each: int = EDGES) -> tuple[DataFrame, int]:
    """df, which cut() has written, on a partition for each `each` rows (never on more than it has), and how many rows it has.

    A step writes as many partitions as shuffles have; those that read few rows from it would start as many tasks again.
    """
    rows = df.coalesce(df.sparkSession.sparkContext.defaultParallelism).count()  # by as many tasks as can run at once
    return df.coalesce(parts_of(rows, each)), rows


def in_stars(edges: DataFrame, parts: int = 1 << 20) -> bool:
    """Whether every node of edges(a, b), b not above a, has one smaller neighbour at most, and none if it is one itself."""
    up = edges.where("a <> b")
    nodes = up.select(F.col("a").alias("node"), F.col("b").alias("up")).unionByName(up.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("up")))
    nodes = nodes.groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.max(F.col("up").isNull()).alias("root")).coalesce(parts)
    return nodes.where("low < high or (root and low is not null)").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component) for every node of edges(a long, b long); component is the smallest node reachable.

    Alternating large-star and small-star steps: each node hands its smallest neighbour on, so stars merge in a number
    of rounds that grows with the logarithm of the longest path. Rounds end when only stars are left; each ends with a
    checkpoint. Loops (a = b) give their node; no edges give no rows. most: how many edges there are at most, if that is known;
    then the first step runs on few partitions too.
    """
    tidy = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, n = gathered(cut(tidy if most is None else tidy.coalesce(parts_of(most))))
    parts = parts_of(n)  # rounds only lose edges
    while not in_stars(now, parts):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).coalesce(parts).select("a", F.least("a", "m").alias("m"))
        large = even_join(both, least, "a").where("b >= a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(parts).distinct().coalesce(parts)
        least = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(parts)
        small = even_join(large, least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(parts)
        now = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct().coalesce(parts))
    ends = now.unionByName(now.select(F.col("b").alias("a"), "b"))
    return ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).coalesce(parts)


class Words(dict):
    """make(word) for each word asked, kept in two generations of at most `most` words: frequent words stay, memory is bounded."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value
