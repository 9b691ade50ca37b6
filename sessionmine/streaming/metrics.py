"""Counters that jobs and streams leave while they run.

`observe` hangs named counts on a table; Spark takes them along in whatever action runs over
it. A listener collects those of streams, an `Observation` those of one action. Each batch is
one event in a log under its own key, so that a replay counts once; a snapshot sums them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from threading import Condition

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..schemas import METRICS
from ..sources.layers import METRIC_DEFAULTS

NAME = "sessionmine"
COUNTS = ("injections", "gate_kept", "gate_dropped", "advisories")
EVENTS = "source STRING, batch LONG, " + ", ".join(f"{c} LONG" for c in COUNTS)


def counts(df: DataFrame, what: str) -> list[Column]:
    """The counts of a table of `what`: decisions of a gate (`kept`), context packs (`body`; an
    empty one is not shown) or advisories (a row each)."""
    if what == "gate":
        kept = F.coalesce("kept", F.lit(False))
        return [F.count_if(kept).alias("gate_kept"), F.count_if(~kept).alias("gate_dropped")]
    if what == "packs":
        return [F.count_if(F.coalesce("body", F.lit("")) != "").alias("injections")]
    if what == "advisories":
        return [F.count(F.lit(1)).alias("advisories")]
    raise ValueError(f"no counts of {what!r}")


def observed(df: DataFrame, what: str) -> DataFrame:
    """The same rows of a stream; `RunMetrics` hears what was counted in each batch."""
    return df.observe(f"{NAME}.{what}", *counts(df, what))


class RunMetrics(StreamingQueryListener):
    """The log of counts below `path`.

    Register it with `spark.streams.addListener`. What it hears is held until `flush`, one
    small row a batch. Call `flush` now and then, and once at the end; counts of batches that
    were heard of but not flushed are lost with the driver.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.rows: dict[tuple[str, int], dict[str, int]] = {}
        self.ended: set[str] = set()
        self.lock = Condition()

    def add(self, source: str, batch: int, values: dict[str, int]) -> None:
        with self.lock:
            row = self.rows.setdefault((source, batch), {})
            row.update({k: int(v or 0) for k, v in values.items() if k in COUNTS})

    def counted(self, df: DataFrame, what: str, action: Callable[[DataFrame], object]) -> object:
        """Run an action over a table and log what it counted."""
        seen = Observation(f"{NAME}.{what}.{uuid.uuid4().hex}")
        out = action(df.observe(seen, *counts(df, what)))
        self.add(seen._name, 0, seen.get)
        return out

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for name, row in p.observedMetrics.items():
            if name.startswith(f"{NAME}."):
                # The id outlives restarts, so a batch that runs again has the same key.
                self.add(f"{p.id}.{name}", p.batchId, row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.ended.add(str(event.runId))
            self.lock.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Wait until all of an ended stream was heard: its end comes after its batches."""
        with self.lock:
            if not self.lock.wait_for(lambda: str(query.runId) in self.ended, seconds):
                raise TimeoutError(f"the end of stream {query.runId} was not heard; is the listener registered?")

    def flush(self) -> None:
        """Append what was heard since the last time."""
        with self.lock:
            rows, self.rows = self.rows, {}
        if rows:
            events = [(s, b, *[v.get(c, 0) for c in COUNTS]) for (s, b), v in rows.items()]
            try:
                self.spark.createDataFrame(events, EVENTS).coalesce(1).write.mode("append").parquet(self.path)
            except Exception:
                with self.lock:
                    self.rows = {**rows, **self.rows}
                raise


def snapshot(spark: SparkSession, path: str | None = None, libraries: DataFrame | None = None, schema: str | None = None) -> DataFrame:
    """One row of all counters: those of the logged runs, and those of the `libraries` table
    (`streaming.library`). What nobody counted has its default; with several libraries the
    longest streak shows, and `backoff` where one of them backs off."""
    base = spark.createDataFrame([json.dumps({})], "string").select(F.from_json("value", schema or METRICS).alias("m")).select("m.*")
    runs = None
    if path is not None:
        log = spark.read.schema(EVENTS).parquet(path)
        runs = log.groupBy("source", "batch").agg(*[F.max(c).alias(c) for c in COUNTS]).agg(*[F.sum(c).alias(c) for c in COUNTS])
    if libraries is not None:
        libraries = libraries.agg(*[F.sum(c).alias(c) for c in ("reflections", "skipped", "new_cards", "duplicate_cards")],
                                  F.max("empty_streak").alias("empty_streak"), F.max("backoff").alias("backoff"))
    found = {c: df for df in (runs, libraries) if df is not None for c in df.columns}
    return base.select(*[
        F.coalesce(found[c].select(c).scalar() if c in found else F.col(c), F.lit(METRIC_DEFAULTS[c])).cast(base.schema[c].dataType).alias(c)
        for c in base.columns])
