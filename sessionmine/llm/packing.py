"""Packing token sequences with minimum bin slack (operator 4).

Documents are cut into pieces of at most `capacity` tokens. What a window gets depends on
the lengths only, so the plan is made from the histogram of lengths, which has `capacity`
cells whatever the input: the longest length left opens a window, a subset sum over bits
finds the counts of lengths that fill it closest to its capacity, and the window is repeated
while the counts last. Spark ranks the pieces of one length and gives each its place.

Defined results: a null or empty text has the end id only. Repeated rows, null and repeated
ids are documents of their own. An empty table gives an empty result. Further columns of
`docs` are ignored; `place` keeps all columns of `pieces`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut_batches, stage
from .textids import cut_ids, encoder_for

CAPACITY = 2048
#: Pieces of one length that one task ranks, about.
PER_SALT = 100_000


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """`doc_id, start, length, ids, doc_tokens` per piece; `ids` are little-endian unsigned
    32-bit integers, a document's last one is `end_id`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        for part, texts in cut_batches(batches, limit=4_000_000):
            ids, sizes = encoder.encode(texts, end_id)
            p = cut_ids(ids, sizes, capacity)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(p["row"]), p["start"], p["length"], p["ids"], pa.array(sizes).take(p["row"])],
                names=["doc_id", "start", "length", "ids", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")


@dataclass(frozen=True)
class Windows:
    """`times` windows that hold `counts[length]` pieces of each length."""

    counts: dict[int, int]
    times: int


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to `room`.

    Bit s of `reach` tells whether some multiset sums to s. Lengths are taken from the
    longest on, their counts in powers of two; each step's bits are kept to walk back.
    """
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, many = min(counts[length], room // length), 1
        while left > 0 and not reach >> room:
            many = min(many, left)
            steps.append((length, many, reach))
            reach |= (reach << many * length) & full
            left -= many
            many *= 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, many, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + many
            total -= many * length
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Windows]:
    """Windows for all pieces. Each step uses up a length or at least halves its count, so
    there are at most capacity x log2(pieces) steps."""
    left = {length: n for length, n in histogram.items() if n > 0}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fill({k: n for k, n in left.items() if n}, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        for k, n in chosen.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        out.append(Windows(chosen, times))
    return out


def _places(windows: list[Windows]) -> dict[str, np.ndarray]:
    """Runs of ranks of one length: from rank `first` on, `many` pieces go to each window,
    the first window is `window`, the first place in it `offset`."""
    rows, used, window = [], {}, 0
    for w in windows:
        offset = 0
        for length, many in sorted(w.counts.items(), reverse=True):
            rows.append((length, used.get(length, 0), many, window, offset))
            used[length] = used.get(length, 0) + many * w.times
            offset += many * length
        window += w.times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "many", "window", "offset"), table.T))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces(doc_id, start, length, ...)` with `sequence_id` and `offset`.

    Pieces of one length are ranked in salted parts, so that a length which very many share
    is never sorted by one task.
    """
    if not 0 < capacity < 1 << 15:
        raise ValueError("capacity must be below 32768")
    pieces = stage(pieces)
    salts = max(16, pieces.count() // PER_SALT)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    sizes = stage(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "start")
    ranked = (salted.withColumn("_rank", F.row_number().over(within)).join(sizes, ["length", "_salt"])
              .withColumn("_rank", F.col("_rank") + F.col("_before") - 1))
    sent = pieces.sparkSession.sparkContext.broadcast(places)
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        key = p["length"] * (1 << 48) + p["first"]
        for part in batches:
            length, rank = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            i = np.searchsorted(key, length * (1 << 48) + rank, "right") - 1
            nth = rank - p["first"][i]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(part.schema.get_field_index(c)) for c in names], pa.array(p["window"][i] + nth // p["many"][i]),
                 pa.array(p["offset"][i] + nth % p["many"][i] * length)], names=[*names, "sequence_id", "offset"])

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*names, "_rank").mapInArrow(run, schema)
