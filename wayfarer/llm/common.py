"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions.session import cut, shared_dir

__all__ = ["BATCH_ROWS", "SMALL_ROWS", "Tables", "bounded", "cut", "known", "release", "shared_dir", "small", "unused", "utf8", "values", "with_ids"]


def utf8(column: str = "text"):
    """A string column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


#: Rows of a few numbers up to which a table is broadcast (some tens of MB on an executor); larger ones are joined by a shuffle.
SMALL_ROWS = 1_000_000


class Tables:
    """Tables that a job writes to the shared folder: computed once, read with their columns pruned, removed when done with."""

    def __init__(self, spark):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def known(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has at most SMALL_ROWS rows."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def small(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder, to be broadcast if it has at most SMALL_ROWS rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def with_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose doc_id is (left_anti: is not) in the first column of ``ids``; null ids are equal."""
    ids = small(ids.select(ids[ids.columns[0]].alias("__id")).distinct())
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__id"]), how)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it while it is a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def values(column):
    """The values of an Arrow column one by one: a batch's texts are never all Python objects at once."""
    return (v.as_py() for v in column)


def release() -> None:
    """Hands memory that a task has freed back to the system: its worker goes on to other stages beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


#: Rows of an Arrow batch at most: texts are long, and a batch is held by the JVM and by Python, for every task at once.
BATCH_ROWS = 2000


def bounded(df: DataFrame) -> None:
    """Sees to it that the session's Arrow batches have at most BATCH_ROWS rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
