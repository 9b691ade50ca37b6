"""Product codes of vectors by exact matrix products (operator 12).

Vectors become whole numbers and are cut into `PARTS` parts, each with a codebook of its own.
Squared distances to all entries come from |v|^2 - 2 v.c + |c|^2. The products v.c are matrix
products in float64: whole numbers are split into limbs so short that every sum of products
of limbs stays below 2^53, where float64 is exact, and the limb products are put together
again in 64-bit integers. The first smallest distance is the code.

Each round reads the stored vectors once; a task returns one row of sums per used entry, and
`PARTS` x `ENTRIES` rows reach the driver.

Defined results: rows whose vector is null or holds a null or not finite component are left
out. All vectors should have one length that is a multiple of `PARTS`; the one of the
smallest id whose length is a positive multiple counts, and rows of any other length stay
with a null code and a null error. Repeated rows and ids are vectors of their own (of equal
ids the smaller vector starts an entry first), a null id starts no entry. With fewer vectors than
entries every vector starts one. Without any vector the result is empty, and without one of a
fitting length every code is null and the digest is that of an empty text. Labels that are
null count as equal; a label without a code has a null sum. Further columns are ignored.
`whole` tells which components are too large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.sizes import is_small
from .common import stage
from .vectors import floored_means, packed, partial_sums, unpacked, usable, whole

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK = 16384
#: Slices of a label's rows where the sums of labels are too many to broadcast.
SALTS = 16


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """x = sum of limb[i] * 2^(bits * i) in float64; all limbs lie in [0, 2^bits) but the last
    one, which has the sign and lies in [-2^bits, 2^bits)."""
    out = []
    while x.size and max(-int(x.min()), int(x.max()) + 1) > 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def products(a: np.ndarray, b: np.ndarray, bits: int | None = None) -> np.ndarray:
    """a @ b.T of whole numbers, modulo 2^64 and so exact where the true value fits."""
    bits = bits or (53 - max(1, a.shape[1]).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.uint64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            if bits * (i + j) < 64:
                out += (x @ y.T).astype(np.int64).view(np.uint64) << np.uint64(bits * (i + j))
    return out.view(np.int64)


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry and its squared distance for each row."""
    own, other = np.einsum("ij,ij->i", rows, rows), np.einsum("ij,ij->i", book, book)
    d = own[:, None] + other[None, :] - 2 * products(rows, book)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(d)), best]


@dataclass
class Stored:
    """Vectors as whole numbers (`vec_id, label, q`; null `q` where the length is another one)
    and the codebooks to start from (parts x entries x width)."""

    rows: DataFrame
    books: np.ndarray
    dims: int


def build(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> Stored:
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    kept = vectors.select("vec_id", label, F.col("embedding").cast("array<double>").alias("v")).filter(usable("v"))
    fits = kept.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0))
    found = fits.orderBy("vec_id", "v").select(F.size("v").alias("n")).first()
    dims = found["n"] if found else 0
    start = fits.filter(F.size("v") == dims).orderBy("vec_id", "v").limit(entries).select("v").collect() if dims else []
    first = whole(pa.array([r["v"] for r in start], pa.list_(pa.float64())), scale, dims)
    books = np.stack(np.split(first, parts, axis=1)) if dims else np.zeros((parts, 0, 0), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed(whole(part.column(2), scale, dims).astype(np.int32))],
                                             names=["vec_id", "label", "q"])

    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, q binary"
    good = F.size("v") == F.lit(dims or -1)
    rows = kept.filter(good).mapInArrow(run, schema).unionByName(
        kept.filter(~good).select("vec_id", "label", F.lit(None).cast("binary").alias("q")))
    return Stored(stage(rows), books, dims)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def refine(stored: Stored, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after so many rounds of assignment and floored means."""
    books, dims = stored.books, stored.dims
    parts, entries, width = books.shape
    for _ in range(rounds if dims else 0):
        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(now.shape, np.int64), np.zeros(now.shape[:2], np.int64)
            for part in _blocks(batches):
                q = unpacked(part.column(0), "<i4", dims).astype(np.int64)
                for p in range(parts):
                    own = np.ascontiguousarray(q[:, p * width:(p + 1) * width])
                    partial_sums(nearest(own, now[p])[0], own, total[p], count[p])
            at, entry = np.nonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[at, entry]),
                 pa.array(list(total[at, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

        sums = stored.rows.filter(F.col("q").isNotNull()).select("q").mapInArrow(run, "part int, entry int, n long, sums array<long>")
        books = books.copy()
        for (p, e), mean in floored_means(sums, ["part", "entry"], width).items():
            books[p, e] = mean
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def assign(stored: Stored, books: np.ndarray) -> DataFrame:
    """`vec_id, label, code, error` of every row."""
    dims, (parts, _entries, width) = stored.dims, books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            q = unpacked(part.column(2), "<i4", dims).astype(np.int64)
            code, error = np.zeros((len(q), parts), np.uint8), np.zeros(len(q), np.int64)
            for p in range(parts):
                code[:, p], d = nearest(np.ascontiguousarray(q[:, p * width:(p + 1) * width]), books[p])
                error += d
            text = code.tobytes().hex()
            size = 2 * parts
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([text[i:i + size] for i in range(0, len(text), size)], pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"])

    kinds = {c: stored.rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    coded = stored.rows.filter(F.col("q").isNotNull())
    rest = stored.rows.filter(F.col("q").isNull()).select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return (coded.mapInArrow(run, schema) if dims else coded.select(*rest.columns[:2], F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))).unionByName(rest)


def encode(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Codes, errors, the sum of errors of each label and the digest of all codebooks."""
    stored = build(vectors)
    books = refine(stored, rounds)
    rows = stage(assign(stored, books))
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    if is_small(sums):
        joined = rows.join(F.broadcast(sums.withColumnRenamed("label", "_of")), F.col("label").eqNullSafe(F.col("_of")))
    else:  # a label with very many rows is met in SALTS slices
        salted = sums.withColumnRenamed("label", "_of").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        slot = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("_slot", slot).join(salted, F.col("label").eqNullSafe(F.col("_of")) & (F.col("_slot") == F.col("_salt")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL, for tables whose vectors have 64 components."""
    width = 64 // PARTS
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))""",
             f"""p AS MATERIALIZED (SELECT vec_id, label, j AS part, q[j * {width} + 1:j * {width} + {width}] AS q
        FROM (SELECT *, unnest(range({PARTS})) AS j FROM v))""",
             f"""c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS c, q FROM p
        WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT * FROM (
            SELECT p.vec_id, p.label, p.part, p.q, k.c, list_sum(list_transform(list_zip(p.q, k.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
            FROM p JOIN c{r} k USING (part)) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, c) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS MATERIALIZED (SELECT part, c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM (
                SELECT part, c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
                FROM (SELECT part, c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY part, c, i) GROUP BY part, c)""")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT k.part, k.c, coalesce(m.q, k.q) AS q FROM c{r} k LEFT JOIN m{r} m USING (part, c))")
    return f"""WITH {', '.join(steps)},
        coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', c), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
            FROM a{rounds} GROUP BY vec_id),
        book AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, c)) AS h FROM c{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM book) AS codebooks_sha256
        FROM coded"""
