"""Token ids in Arrow files of equal-length sequences (operator 8).

Each file is an Arrow IPC file whose batches hold `BATCH` rows of two fixed-size lists, the
ids and the mask (a bit each) of one sequence. Batches and rows have equal sizes, so token t
lies in batch t // (length x BATCH), and a memory-mapped file gives any sequence and mask
without a copy.
Documents follow one another through the sequences in ascending `doc_id`; only the last
sequence of a file is padded (mask 0). Next to it a second Arrow file lists the documents.

Files are written under names of their own by each attempt of a task, and the manifest that
Spark returns names those that count: what a lost or repeated attempt leaves is never read.

Defined results: a null or empty text has the end id only; null ids come first; repeated
rows are all written. An empty table has an empty manifest. Further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut_batches, shared_folder, stage
from .textids import encoder_for

LENGTH = 1024
BATCH = 256
MANIFEST = "part long, file string, n_docs long, n_tokens long, n_sequences long"


class Writer:
    """One file of sequences and the file of its documents. `uri` may be any that pyarrow
    knows (`file:`, `s3:`, `gs:`, `hdfs:`)."""

    def __init__(self, uri: str, vocabulary: int, length: int = LENGTH, batch: int = BATCH):
        self.files, path = fs.FileSystem.from_uri(uri)
        self.files.create_dir(path.rpartition("/")[0], recursive=True)
        self.dtype = np.dtype(np.uint16 if vocabulary <= 1 << 16 else np.uint32)
        self.length, self.room = length, length * batch
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))],
                                metadata={"batch": str(batch)})
        self.out = self.files.open_output_stream(path + ".arrow")
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.docs_out = self.files.open_output_stream(path + ".docs.arrow")
        self.docs_writer = None
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = self.n_sequences = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents in a row: `ids` of all of them, `sizes` of each."""
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        docs = pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(sizes)], names=["doc_id", "start", "n_tokens"])
        if self.docs_writer is None:
            self.docs_writer = pa.ipc.new_file(self.docs_out, docs.schema)
        self.docs_writer.write_batch(docs)
        self.n_docs += len(sizes)
        self.n_tokens += len(ids)
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        if self.n_held >= self.room:
            self._flush(self.n_held // self.room * self.room)

    def _flush(self, n: int) -> None:
        """Write the first n held tokens, padded to whole sequences."""
        tokens = np.concatenate(self.held)
        self.held, self.n_held = [tokens[n:]], len(tokens) - n
        for at in range(0, n, self.room):
            part = tokens[at:min(at + self.room, n)]
            rows = -(-len(part) // self.length)
            ids, mask = np.zeros(rows * self.length, self.dtype), np.zeros(rows * self.length, bool)
            ids[:len(part)], mask[:len(part)] = part, True
            self.writer.write_batch(pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
                 pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
            self.n_sequences += rows

    def close(self) -> None:
        if self.n_held:
            self._flush(self.n_held)
        self.writer.close()
        self.out.close()
        self.docs_writer.close()
        self.docs_out.close()


class Reader:
    """Random access to a file's sequences, masks and documents."""

    def __init__(self, uri: str):
        self.files, path = fs.FileSystem.from_uri(uri)
        local = isinstance(self.files, fs.LocalFileSystem)
        look = pa.memory_map if local else self.files.open_input_file
        self.file = pa.ipc.open_file(look(path + ".arrow"))
        self.docs_file = pa.ipc.open_file(look(path + ".docs.arrow"))
        self.length = self.file.schema.field("ids").type.list_size
        self.room = self.length * int(self.file.schema.metadata[b"batch"])
        self._at, self._batch = -1, None

    def _part(self, i: int) -> pa.RecordBatch:
        if i != self._at:
            self._at, self._batch = i, self.file.get_batch(i)
        return self._batch

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of one sequence, both views of the file (numpy has no bit arrays, so the
        mask is an Arrow array)."""
        rows = self.room // self.length
        part = self._part(i // rows)
        at = i % rows * self.length
        ids, mask = (part.column(c).values.slice(at, self.length) for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def tokens(self, start: int, n: int) -> np.ndarray:
        parts = []
        while n > 0:
            at = start % self.room
            take = min(n, self.room - at)
            parts.append(self._part(start // self.room).column(0).values.slice(at, take).to_numpy(zero_copy_only=True))
            start, n = start + take, n - take
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16)

    def documents(self) -> Iterator[pa.RecordBatch]:
        for i in range(self.docs_file.num_record_batches):
            yield self.docs_file.get_batch(i)


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, length: int = LENGTH) -> DataFrame:
    """Write `docs(doc_id, text)` in ascending order to `folder` (default: a new one in the
    shared folder); returns the manifest (`MANIFEST`), one row a file."""
    folder = folder or shared_folder(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = encoder_for(tokenizer), None
        part_id = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part_id:06d}-{uuid.uuid4().hex}"
        for part, texts in cut_batches(batches, limit=4_000_000):
            if not part.num_rows:
                continue
            out = out or Writer(uri, encoder.tokenizer.get_vocab_size(), length)
            out.add(part.column(0), *encoder.encode(texts, end_id))
        if out:
            out.close()
            row = (part_id, uri, out.n_docs, out.n_tokens, out.n_sequences)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=[x.split()[0] for x in MANIFEST.split(", ")])

    # Rows that share an id, null too, are dealt out by a hash of their text.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("turn", F.xxhash64("text"))
    order = ["doc_id", "turn"]
    return stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, MANIFEST))


def read(manifest: DataFrame, doc_type: str = "long") -> DataFrame:
    """`doc_id, start, n_tokens, ids` of every document, from the files; `start` counts the
    tokens of all documents before it, `ids` are little-endian unsigned 32-bit integers."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(row["file"])
                for docs in reader.documents():
                    starts, sizes = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    ids = [reader.tokens(int(s), int(n)).astype("<u4").tobytes() for s, n in zip(starts, sizes)]
                    yield pa.RecordBatch.from_arrays(
                        [docs.column(0), pa.array(starts + row["before"]), docs.column(2), pa.array(ids, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])

    return files.repartitionByRange(max(1, files.count()), "file").mapInArrow(run, f"doc_id {doc_type}, start long, n_tokens long, ids binary")
