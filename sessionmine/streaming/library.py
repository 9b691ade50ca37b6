"""What the sessions of a library share: counters of reflections and the back-off they lead to.

Reflections that came back empty count across sessions. A first stage keeps a row per library
in a keyed table and gives each turn end the streak that stood at its time; the session stage
(`reflect_trigger(..., shared_streak=True)`) reads these rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..operators.joins import join_null_safe
from ..operators.running import running
from ..operators.shared import is_written
from ..operators.sizes import freed
from .tables import BUCKETS, KeyedTable, Merge

CHUNK_SECONDS = 3600  # rows of one library in an hour are handled together
COUNTERS = ("reflections", "skipped", "new_cards", "duplicate_cards")


def library_table(spark, path: str, buckets: int = BUCKETS) -> KeyedTable:
    """`library, reflections, skipped, new_cards, duplicate_cards, empty_streak, backoff`."""
    return KeyedTable(spark, path, ("library",), buckets)


def with_streaks(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Add `empty_streak`: how many reflections of the row's library (`library, ts, seq, kind,
    created`) came back empty in a row, up to and with this row in the order of ts and seq.

    `stored(library, empty_streak)` says where earlier rows ended. Two running values over
    chunks of time: the empty results so far, and their number at the last fruitful one.
    """
    result = F.col("kind") == "result"
    fruitful = result & (F.coalesce("created", F.lit(0)) > 0)
    empty = F.coalesce(result & ~fruitful, F.lit(False)).cast("long")
    chunk, order = F.floor(F.unix_seconds("ts") / CHUNK_SECONDS), ["ts", "seq"]
    out = running(rows, ["library"], order, chunk, sums={"_empty": empty})
    out = running(out, ["library"], order, chunk, lasts={"_base": F.when(fruitful, F.col("_empty"))})
    if stored is None:
        before = F.lit(0)
    else:
        out = join_null_safe(out, stored.select("library", F.col("empty_streak").alias("_stored")), ["library"], "left")
        before = F.coalesce("_stored", F.lit(0))
    streak = F.col("_empty") - F.coalesce(F.col("_base"), -before)
    return out.withColumn("empty_streak", streak.cast("long")).drop("_empty", "_base", "_stored")


def counter_merge(backoff_after: int = 5) -> Merge:
    """How rows of `with_streaks` change the stored counters of their libraries."""
    def merge(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
        result = F.col("kind") == "result"
        got = F.coalesce("created", F.lit(0))
        n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        rows = batch.groupBy("library").agg(
            F.count_if(result).alias("reflections"), F.count_if(F.col("kind") == "skipped").alias("skipped"),
            n(F.when(result, got)).alias("new_cards"), n(F.when(result, F.coalesce("merged", F.lit(0)))).alias("duplicate_cards"),
            F.max_by("empty_streak", F.struct("ts", "seq")).alias("empty_streak"))
        if stored is not None:
            # The streak goes on already; the counters add up.
            old = stored.select("library", *COUNTERS, F.lit(None).cast("long").alias("empty_streak"))
            rows = rows.unionByName(old).groupBy("library").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.max("empty_streak").alias("empty_streak"))
        return rows.withColumn("backoff", F.col("empty_streak") >= backoff_after)

    return merge


def share_streaks(stream: DataFrame, table: KeyedTable, path: str, checkpoint: str, name: str = "main",
                  backoff_after: int = 5) -> DataStreamWriter:
    """Write the rows of a stream (`library, session_id, ts, seq, kind (turn_end|result|skipped),
    created, merged, ...`) with their streak to `<path>/batch=<id>` and keep `table` up to date.

    A batch's rows are written before the table changes, and never again: a replay takes the
    written ones, and one whose batch is in the table already does nothing. Rows that come
    after later ones were read count when they come.
    """
    merge, spark = counter_merge(backoff_after), table.spark

    def write(batch: DataFrame, batch_id: int) -> None:
        if table.written(name, batch_id):
            return
        folder = f"{path.rstrip('/')}/batch={batch_id}"
        if not is_written(spark, folder):
            with freed():
                batch = batch.persist()
                try:
                    stored = table.rows_of(batch.select("library"))
                    with_streaks(batch, stored).write.mode("overwrite").parquet(folder)
                finally:
                    batch.unpersist()
        table.change(spark.read.parquet(folder), batch_id, merge, name)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
