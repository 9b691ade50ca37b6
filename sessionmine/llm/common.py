"""Shared folder, staged tables and table reading for the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..operators.shared import shared_folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def staging() -> Iterator[list[str]]:
    """The folders that operators stage inside the block, for an owner who deletes them with
    `release` when nothing reads them any more."""
    mine: list[str] = []
    token = _staged.set(mine)
    try:
        yield mine
    finally:
        _staged.reset(token)


def stage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it again: later steps start from files that
    survive lost executors, and the shuffle files behind them go when the write has ended."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    if _staged.get() is not None:
        _staged.get().append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, folders: list[str], needed: DataFrame | None = None) -> list[str]:
    """Delete staged tables that `needed` doesn't read; returns those that stay."""
    read = needed.inputFiles() if needed is not None else []
    stay = [f for f in folders if any(f.split(":", 1)[-1].lstrip("/") in r for r in read)]
    for f in folders:
        if f not in stay:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return stay


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_batches(batches, text: str = "text", limit: int = 8_000_000):
    """Cut Arrow batches into runs of rows with about `limit` bytes of text, so that the
    memory of a step doesn't follow the number of rows in a batch. Yields (batch, text column)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        sizes = texts.nbytes
        step = max(1, int(batch.num_rows * limit / max(sizes, 1))) if batch.num_rows else 1
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column(part.schema.get_field_index(text))


def slices(batches, text: str = "text", limit: int = 8_000_000):
    """The same with the texts as a Python list."""
    for part, texts in cut_batches(batches, text, limit):
        yield part, texts.to_pylist()
