"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalcat.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/evalcat-llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd", parts: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the
    lineage, so lost executors cost no recomputation and values that depend on
    task layout (row ids, file names) stay fixed. At most ``parts`` tasks and
    files, for results of few rows: give a number that grows with them."""
    if parts:
        df = df.coalesce(parts)
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_rid(df: DataFrame, name: str = "rid") -> DataFrame:
    """Add a row id that is unique, not dense. Stable once the result is staged."""
    return df.withColumn(name, F.monotonically_increasing_id())


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): null texts are empty, other columns go, so
    that extra columns of any name can't clash with an operator's own."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def sized_partitions(rows: int, per_task: int) -> int:
    """How many tasks ``rows`` rows need at ``per_task`` each."""
    return max(1, -(-int(rows) // per_task))


def learned(rows: DataFrame, learn: Callable[[pa.Table], object]):
    """``learn`` of a bounded number of rows, worked out by one task; None
    without rows. Only the result, which must be small, reaches the driver:
    neither the rows nor what learning leaves in a process's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(pa.Table.from_batches(got)))], pa.binary())], names=["model"])

    found = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def store_of(uri: str):
    """(pyarrow file system, path in it) of a folder or file that all tasks
    share: a URI or an absolute path."""
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """While it holds, Arrow batches for Python have at most ``rows`` rows: for
    jobs whose rows are blocks of many records."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
