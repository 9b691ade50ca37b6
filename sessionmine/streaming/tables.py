"""Streams into tables: keyed tables that micro-batches change, and append-only logs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..operators.joins import join_null_safe, with_partition
from ..operators.sizes import freed
from ..plans.failures import MAX_SESSIONS, merge_failures

BUCKETS = 64
Merge = Callable[[DataFrame, DataFrame | None], DataFrame]


@dataclass(frozen=True)
class KeyedTable:
    """A table of one row per key in hash buckets, changed by the batches of streams.

    A change reads the buckets that hold the batch's keys, merges the rows of these keys and
    writes the buckets anew into `<path>/v<version>.<stream>.<batch>/bucket=<b>/`. A version
    counts once Spark has put its `_SUCCESS` there, so an attempt that dies leaves nothing
    behind that is ever read, and a batch that was written is not written again: a replay
    changes nothing. The newest version of each bucket is the table; the one before it stays
    for readers that have listed it already.

    One stream at a time may write. Streams are told apart by name, since each counts its
    batches from 0. Choose `buckets` so that one holds about a file's worth of rows.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = BUCKETS

    def _folder(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _list(self, *parts: str) -> list[str]:
        fs, path = self._folder(*parts)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _versions(self) -> list[tuple[int, str, int, str, list[str]]]:
        """(version, stream, batch, folder, its buckets), oldest first; complete ones only."""
        out = []
        for name in self._list():
            if not name.startswith("v"):
                continue
            number, stream, batch = name[1:].split(".")
            inside = self._list(name)
            if "_SUCCESS" in inside:
                out.append((int(number), stream, int(batch), name, [b for b in inside if b.startswith("bucket=")]))
        return sorted(out)

    def written(self, stream: str, batch_id: int) -> bool:
        return any(s == stream and b >= batch_id for _v, s, b, _n, _bs in self._versions())

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows, or those of some buckets; None where nothing was written yet."""
        newest = {b: name for _v, _s, _b, name, inside in self._versions() for b in inside}
        wanted = None if buckets is None else {f"bucket={b}" for b in buckets}
        paths = [f"{self.path.rstrip('/')}/{name}/{b}" for b, name in sorted(newest.items()) if wanted is None or b in wanted]
        return self.spark.read.parquet(*paths) if paths else None

    def rows_of(self, keys: DataFrame) -> DataFrame | None:
        """The rows of some keys, from their buckets only."""
        stored = self.read(self._touched(keys))
        return None if stored is None else join_null_safe(stored, keys.select(*self.keys).distinct(), list(self.keys), "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect())  # at most `buckets`

    def change(self, batch: DataFrame, batch_id: int, merge: Merge, stream: str = "main") -> bool:
        """Merge a batch (`merge(batch, stored rows of its keys or None)` gives the new rows of
        these keys); False if that was done before."""
        if self.written(stream, batch_id):
            return False
        keys = list(self.keys)
        with freed():
            batch = batch.persist()
            try:
                touched = self._touched(batch)
                if not touched:
                    return True
                stored = self.read(touched)
                own = batch.select(*keys).distinct()
                if stored is None:
                    rows = merge(batch, None)
                else:
                    rows = merge(batch, join_null_safe(stored, own, keys, "left_semi"))
                    rows = rows.unionByName(join_null_safe(stored, own, keys, "left_anti"))
                number = max((v[0] for v in self._versions()), default=-1) + 1
                (rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite")
                 .partitionBy("bucket").parquet(f"{self.path.rstrip('/')}/v{number:08d}.{stream}.{batch_id}"))
            finally:
                batch.unpersist()
        self._clean()
        return True

    def _clean(self) -> None:
        """Delete buckets that two newer versions replace, and attempts that never counted; the
        newest folder of each stream stays, since it tells what was written."""
        versions = self._versions()
        seen: dict[str, int] = {}
        last = {s: name for _v, s, _b, name, _bs in versions}
        for _v, stream, _b, name, inside in reversed(versions):
            old = [b for b in inside if seen.get(b, 0) >= 2]
            for b in inside:
                seen[b] = seen.get(b, 0) + 1
            if old and len(old) == len(inside) and last[stream] != name:
                self._delete(name)
            else:
                for b in old:
                    self._delete(name, b)
        done = {name for *_, name, _bs in versions}
        for name in self._list():
            if name.startswith("v") and name not in done:
                self._delete(name)

    def _delete(self, *parts: str) -> None:
        fs, path = self._folder(*parts)
        fs.delete(path, True)


def change_table(stream: DataFrame, table: KeyedTable, merge: Merge, checkpoint: str, name: str) -> DataStreamWriter:
    """Write a stream into a keyed table; give each checkpoint a `name` of its own."""
    return stream.writeStream.foreachBatch(lambda batch, batch_id: table.change(batch, batch_id, merge, name) and None).option(
        "checkpointLocation", checkpoint)


# ---- failure records -------------------------------------------------------------

def failure_merge(max_sessions: int | None = MAX_SESSIONS, **options) -> Merge:
    """How observations and resolves change the stored failure records.

    A batch holds `fingerprinted` rows; those of `type` 'resolve' (where the column exists)
    resolve their failure. A resolve of a failure that was never seen leaves no record.
    """
    def merge(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
        obs, resolves = batch, None
        if "type" in batch.columns:
            obs, resolves = (batch.filter(F.coalesce(F.col("type") == "resolve", F.lit(False)) == is_).drop("type") for is_ in (False, True))
        rows = merge_failures(obs, resolves, stored, max_sessions=max_sessions, **options)
        return rows.drop("rank", "_all")

    return merge


def failure_table(spark: SparkSession, path: str, scoped: bool = False, buckets: int = BUCKETS) -> KeyedTable:
    """Failure records by fingerprint, `scoped` by scope and partition as well."""
    return KeyedTable(spark, path, ("scope", "partition", "fingerprint") if scoped else ("fingerprint",), buckets)


def upsert_failures(stream: DataFrame, table: KeyedTable, checkpoint: str, name: str = "main", **options) -> DataStreamWriter:
    """Keep a failure table up to date: a micro-batch reads and writes the buckets of its own
    fingerprints, never old observations."""
    return change_table(with_partition(stream), table, failure_merge(**options), checkpoint, name)


# ---- append-only logs -------------------------------------------------------------

def log_batches(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append each micro-batch as its own partition; a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_failures(spark: SparkSession, path: str, **options) -> DataFrame:
    """Failure records from logged observations."""
    return merge_failures(spark.read.parquet(path).drop("batch"), **options)
