"""Packing whole documents into few sequences with minimum bin slack (operator 13).

Only documents longer than a sequence are cut, into full pieces behind a first, shorter one.
The plan needs the histogram of piece lengths alone, which has `capacity` cells whatever the
input: the longest length left opens a bin, a subset sum over a bit set finds the fullest
combination of the other lengths that still fits, and the combination is taken away as often
as its pieces last. Spark then numbers the pieces of each length, in salted parts, and looks
up each one's bin and place.

Defined results: a null or empty text is one piece with the end id alone. Repeated rows and
null or repeated ids are documents of their own. An empty table has an empty result. `pack`
keeps all columns of `pieces` (`sequence_id` and `offset` are replaced); `cut` reads `doc_id`
and `text` only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut_batches, stage
from .textids import cut_ids, encoder_for

CAPACITY = 2048
#: Pieces of one length that one task numbers, about.
PER_PART = 100_000


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """`doc_id, piece, start, length, ids` of every piece; `ids` are little-endian unsigned
    32-bit integers, a document's last one is `end_id`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        for part, texts in cut_batches(batches, limit=4_000_000):
            p = cut_ids(*encoder.encode(texts, end_id), capacity, short_first=True)
            yield pa.RecordBatch.from_arrays([part.column(0).take(p.pop("row")), *p.values()], names=["doc_id", *p])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length fill `room` best; of equally full combinations one with
    long pieces.

    `sums` has bit s set where s can be filled. The bits before each length are kept, and the
    best sum is walked back through them.
    """
    sums, limit, before = 1, (1 << room + 1) - 1, []
    for length in sorted((n for n in available if n <= room), reverse=True):
        before.append((length, sums))
        for _ in range(min(available[length], room // length)):
            more = sums | sums << length & limit
            if more == sums:
                break
            sums = more
        if sums >> room:
            break
    best, chosen = sums.bit_length() - 1, {}
    for length, without in reversed(before):
        while not without >> best & 1:
            best -= length
            chosen[length] = chosen.get(length, 0) + 1
    return chosen


def bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a bin, number of such bins) until no piece is left. Each step
    uses up a length or at least halves it: at most capacity x log2(pieces) steps."""
    left, out = {k: n for k, n in histogram.items() if n > 0}, []
    while left:
        longest = max(left)
        rest = {k: n - (k == longest) for k, n in left.items()}
        combination = fullest({k: n for k, n in rest.items() if n}, capacity - longest)
        combination[longest] = combination.get(longest, 0) + 1
        times = min(left[k] // n for k, n in combination.items())
        left = {k: m for k, n in left.items() if (m := n - times * combination.get(k, 0))}
        out.append((combination, times))
    return out


def _lookup(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first number, pieces in a bin, first bin, place in the bin), sorted: the
    pieces of a length from that number on go to consecutive bins."""
    rows, given, bin_no = [], {}, 0
    for combination, times in plan:
        place = 0
        for length in sorted(combination, reverse=True):
            many = combination[length]
            rows.append((length, given.get(length, 0), many, bin_no, place))
            given[length] = given.get(length, 0) + many * times
            place += many * length
        bin_no += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces(doc_id, piece, length, ...)` with `sequence_id` and `offset`."""
    if not 0 < capacity < 1 << 15:
        raise ValueError("capacity must be below 32768")
    pieces = stage(pieces.drop("sequence_id", "offset"))
    parts = max(16, pieces.count() // PER_PART)
    rows = pieces.select(F.struct("*").alias("row"), "length", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).alias("part"))
    sizes = stage(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = _lookup(bins(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "part").orderBy("row.doc_id", "row.piece")
    numbered = rows.withColumn("own", F.row_number().over(own)).join(first, ["length", "part"]).select(
        "row.*", (F.col("own") + F.col("first") - 1).alias("sequence_id"))
    sent = pieces.sparkSession.sparkContext.broadcast(table)  # its size follows the capacity
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, numbers, many, bin_no, place = sent.value.T
        key = (lengths << 48) + numbers
        for part in batches:
            length, number = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("length", "sequence_id"))
            i = np.searchsorted(key, (length << 48) + number, "right") - 1
            nth = number - numbers[i]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(bin_no[i] + nth // many[i]), pa.array(place[i] + nth % many[i] * length)],
                names=[*names, "sequence_id", "offset"])

    return numbered.mapInArrow(run, pieces.schema.add("sequence_id", "long").add("offset", "long"))
