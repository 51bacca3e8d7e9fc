"""What the training-data operators have in common: the shared folder, written stages, connected components."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import ship

#: Rows and bytes of a batch that goes to Python at most, as a batch is in memory several times at once.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Links that one task of components() may write, while there are few.
FEW = 100_000


def _tidy() -> None:
    """Gives back what a worker no longer needs: it lives on after a task, beside others on its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def small_batches(spark: SparkSession) -> None:
    """Before Python runs on executors: they get this package, and the session's limits of batches for Python are lowered
    to ours, where they are higher."""
    ship(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def parts_of(spark: SparkSession, needed: float) -> int:
    """Parts to deal something into: as many as its size needs, and as many as a shuffle has."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(needed))


def streamed(f: Callable, *args) -> Callable:
    """f over a task's batches, for mapInArrow."""

    def run(batches):
        try:
            yield from f(batches, *args)
        finally:
            _tidy()

    return run


def grouped(f: Callable, *args) -> Callable:
    """f over a group's table, for applyInArrow."""

    def run(table):
        try:
            return f(table, *args)
        finally:
            _tidy()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one, on one machine
    only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/plumbline/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Removes everything that this application has written to the shared folder, once its results are stored."""
    _delete(spark, _own_dir(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: it is computed once, and lost executors lose none of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_plumbline_path"] = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes what written() wrote, once nothing reads it any more."""
    path = df.__dict__.get("_plumbline_path")
    if path:
        _delete(df.sparkSession, path)


def _turned(edges: DataFrame, both: bool) -> DataFrame:
    """One star step: every node sends what it is linked with to the smallest of them (both: over all its
    neighbours, those above it; else over the smaller ones)."""
    if both:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = around.join(least, "u")
    if both:
        out = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components by alternating large-star and small-star steps, each step one grouped minimum and a join.

    edges: columns u, v (long). Returns node, component (its smallest node) for every node that has an edge to
    another one. Rounds grow with the logarithm of the longest chain; the links stay distributed, and each round is
    written to the shared folder.
    """
    links = edges.count()
    few = (lambda df: df.coalesce(1 + links // FEW)) if links <= 50 * FEW else (lambda df: df)  # noqa: E731  small files else
    now = written(few(edges.filter(F.col("u") != F.col("v")).select("u", "v").distinct()), name)
    state = None
    while True:
        after = written(few(_turned(_turned(now, True), False)), name)
        dropped(now)
        now = after
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(seen):
            break
        state = tuple(seen)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
