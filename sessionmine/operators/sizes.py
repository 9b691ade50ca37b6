"""Size checks in front of broadcast hints."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

MAX_BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Look at no more than `max_rows + 1` rows to see whether the table is small."""
    return df.limit(max_rows + 1).count() <= max_rows


def texts_are_small(df: DataFrame, column: str = "text", max_rows: int = MAX_BROADCAST_ROWS,
                    max_chars: int = 4_000_000) -> bool:
    """Whether all words of a text column (a query batch) fit a broadcast table.

    A text has at most one word per two characters, so the total length bounds the words.
    """
    n, chars = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.length(column)), F.lit(0))).first()
    return n <= max_rows and chars <= max_chars


def hint(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast where the size was checked; else Spark picks a shuffle join
    (adaptive execution splits its skewed partitions)."""
    return F.broadcast(df) if small else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a table that comes in fewer splits than there are cores (one small file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


_kept: ContextVar[list[DataFrame] | None] = ContextVar("kept", default=None)


def keep(df: DataFrame) -> DataFrame:
    """Keep a table that several branches of a job read (memory, then executor disk).

    Parts lost with an executor are computed again from their source. Inside `freed()` the
    table is given back at the end of the block.
    """
    if df.isStreaming:
        return df
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    if _kept.get() is not None:
        _kept.get().append(out)
    return out


@contextmanager
def freed() -> Iterator[None]:
    """Own what the jobs in this block keep: it is given back when the block ends, so results
    must be written inside. For jobs that run again and again, such as micro-batches."""
    mine: list[DataFrame] = []
    token = _kept.set(mine)
    try:
        yield
    finally:
        _kept.reset(token)
        for df in mine:
            df.unpersist()
